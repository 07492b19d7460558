"""The prefix trie against a plain trie of whole turns."""

import collections
import hashlib
import random
import zlib

import pytest

from tessera.llm.queries import QUERIES
from tessera.llm.trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, base long, k1 long, members string"


def _plain(rows):
    """Rows of the result as tuples, by walking every subtree; ties in turn are the caller's to avoid."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return collections.Counter(out)


def _got(df):
    return collections.Counter((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_against_plain(spark, seed):
    rnd = random.Random(seed)
    said = ["", "a", "ab", "née 😀", None, "x" * 500]
    rows = []
    for c in [*range(-130, -90), *range(-20, 30), *range(199, 260), 300, 401, 402, 700]:
        if rnd.random() < 0.15:
            continue
        turns = rnd.sample([None, *range(12)], rnd.choice([1, 2, 3, 6, 9]))
        rows += [(c, t, rnd.choice(["user", None]), rnd.choice(said)) for t in turns]
    rows += [(None, 1, "user", "lost"), (900, 0, None, None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, 5, 6, "m") for r in rows], SCHEMA).repartition(5)
    assert _got(conversation_trie(df)) == _plain(rows)


def test_long_and_hot(spark):
    """A long conversation, and one first turn and one conversation that many families share."""
    rows = [(0, t, "user", f"t{t % 3}") for t in range(3000)]
    rows += [(100 * i, t, "system", "same") for i in range(1, 150) for t in range(2)]
    df = spark.createDataFrame([(*r, 5, 6, "m") for r in rows], SCHEMA)
    got = _got(conversation_trie(df))
    own = {}
    for c, t, r, x in rows:
        own.setdefault(c, []).append((r, x))
    assert sum(got.values()) == 1 + 3000 + 2  # base conversations stay as they are
    root = next(r for r in got if r[1] == 0)
    assert root[:6] == (0, 0, None, 150, 2, 2) and root[6] == 2 * 148 * 4
    last = next(r for r in got if r[0] == 100 and r[1] == 2)
    assert last[2:7] == (100, 149, 0, 1, 148 * 4) and last[7] == hashlib.sha256(",".join(str(100 * i) for i in range(1, 150)).encode()).hexdigest()


def test_odd_tables(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 > 1)
    alone = _got(conversation_trie(spark.createDataFrame([(c, 3, "user", "gone", 1, 1, "")], SCHEMA)))
    assert alone == collections.Counter([(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())])
    # Rows that repeat and turns that tie give one result in any order.
    rows = [(0, 1, "a", "x"), (0, 1, "a", "x"), (0, 1, "b", "y"), (200, 1, "b", "y"), (200, 1, "a", "x"), (200, 1, "a", "x")]
    frames = [spark.createDataFrame([(*r, 1, 1, "") for r in x], SCHEMA) for x in (rows, rows[::-1])]
    assert _got(conversation_trie(frames[0])) == _got(conversation_trie(frames[1]))
    assert sum(_got(conversation_trie(frames[0])).values()) == 4


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert _got(QUERIES["op12_conversation_trie"](spark, sf)) == _plain(rows)
