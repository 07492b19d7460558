"""b-bit MinHash dedup against all pairs, on near copies, chains of them, and blocks of few rows."""

import random
import re

import numpy as np
import pytest

from tessera.llm import minhash
from tessera.llm.common import id_filter, in_filter
from tessera.llm.minhash import least_similarity, minima, near_duplicates, packed, similarity

SCHEMA = "doc_id long, text string, rep long, n long, part string, tile string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _plain(rows, k=5, percent=85):
    """{(doc_id): (n_shingles, component_id)} by all pairs."""
    sets = {}
    for d, t in rows:
        w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def _check(df, rows):
    got = near_duplicates(df).collect()
    want = _plain([r for r in rows if r[0] is not None])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert len(got) == len(rows)
    return want


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "p", "t") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("seed,blocks", [(0, (2048, 256)), (1, (8, 4)), (2, (3, 2))])
def test_against_all_pairs(spark, monkeypatch, seed, blocks):
    monkeypatch.setattr(minhash, "SIGNATURE_ROWS", blocks[0])
    monkeypatch.setattr(minhash, "SET_ROWS", blocks[1])
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    rows = []
    for size in (1, 2, 3, 40, 60):
        base = [word() for _ in range(rnd.choice([30, 120, 300]))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4]) * len(base) // 120):
                copy[rnd.randrange(len(copy))] = word().upper()
            rows.append((len(rows) * 7 % 1009, rnd.choice([" ", "\n", "  "]).join(copy)))
    # A chain: each text is near the next one only.
    chain = [word() for _ in range(200)]
    for i in range(12):
        chain = [*chain[8:], *(word() for _ in range(8))]
        rows.append((2000 + i * 31 % 13, " ".join(chain)))
    want = _check(_frame(spark, rows), rows)
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_odd_rows(spark):
    odd = [(0, None), (1, ""), (2, " \n"), (3, "one two"), (4, "ONE two"), (5, "a b c d e"), (6, "a b c d e f"), (7, "x " * 5000), (8, "x x x x x x"), (None, "a b c d e"), (None, None), (9, "é " * 7), (10, "É " * 7)]
    got = near_duplicates(_frame(spark, [*odd, odd[5]])).collect()
    assert len(got) == len(odd) + 1
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {
        (0, 0, 0, True), (1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False), (5, 1, 5, True), (6, 2, 6, True),
        (7, 1, 7, True), (8, 1, 7, False), (9, 1, 9, True), (10, 1, 10, True), (None, 1, None, True), (None, 0, None, True),
    }
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimates():
    """Estimates are right on average, and linked pairs don't fall below the least one."""
    rnd = np.random.default_rng(1)
    for j in (0.5, 0.85):
        got = []
        for _ in range(300):
            a = rnd.integers(0, 1 << 63, 1000, np.int64).view(np.uint64)
            shared = round(2000 * j / (1 + j))
            b = np.concatenate((a[:shared], rnd.integers(0, 1 << 63, 1000 - shared, np.int64).view(np.uint64)))
            s = packed(minhash.mix(minima(np.concatenate((a, b)), np.array([0, 1000]))))
            x = s[:, 0] ^ s[:, 1]
            got.append(similarity(minhash.MINIMA - int(np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(minhash._EACH)).sum())))
        assert abs(np.mean(got) - j) < 0.01
        assert j < 0.85 or min(got) > least_similarity(85)


def test_id_filter(spark):
    ids = spark.range(0, 3000).selectExpr("id * 7 AS id")
    words = id_filter(ids, "id")
    assert in_filter(words, np.arange(3000) * 7).all()
    assert in_filter(words, np.arange(100_000) * 7 + 3).mean() < 0.2
    assert in_filter(id_filter(ids.where("id < 0"), "id"), np.arange(9)).sum() == 0 and in_filter(None, np.arange(9)).all()
