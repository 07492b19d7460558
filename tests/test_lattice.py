"""Lines cut by a made-up dictionary, against all ways to cut them."""

import random

import pytest

from tessera.operators import lattice
from tessera.operators.lattice import EACH, NO_CLASS, UNKNOWN, dictionary, lattice_tagger
from tessera.plans import queries
from tessera.sources.mart import tagged_lines

ENTRY, PAIR = "s string, l string, p string, left int, right int, cost int", "right int, left int, cost int"


def _all_costs(text, entries, pairs):
    """The least cost of each way to cut a text of one kind of letters into words, runs to its end, and letters."""

    def go(at, before):
        if at == len(text):
            return pairs.get((before, NO_CLASS), 0)
        steps = [(len(s), left, right, cost) for s, _, _, left, right, cost in entries if text.startswith(s, at)]
        steps += [(n, NO_CLASS, NO_CLASS, UNKNOWN + EACH * n) for n in {1, len(text) - at}]
        return min(pairs.get((before, left), 0) + cost + go(at + n, right) for n, left, right, cost in steps)

    return go(0, NO_CLASS)


def test_cheapest_of_all_ways(spark):
    r = random.Random(5)
    entries = sorted({("".join(r.choices("abc", k=r.randrange(1, 4))), "x", f"p{i}", r.randrange(1, 4), r.randrange(1, 4), r.randrange(-500, 9000)) for i in range(14)})
    pairs = {(a, b): r.randrange(-800, 3000) for a in range(4) for b in range(4) if r.random() < 0.8}
    texts = ["".join(r.choices("abcd", k=r.randrange(0, 10))) for _ in range(60)] + ["", "d" * 9]
    tag = lattice_tagger(spark.createDataFrame(entries, ENTRY), spark.createDataFrame([(*k, v) for k, v in pairs.items()], PAIR))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, line string")
    cost_of = {(s, p): (left, right, cost) for s, _, p, left, right, cost in entries}
    rows = tagged_lines(df, tag).collect()
    assert len(rows) == len(texts) and any(t.p for row in rows for t in row.tok)
    for row in rows:
        assert "".join(t.s for t in row.tok) == row.line and all(row.line[t.b : t.e] == t.s for t in row.tok)
        total, before = 0, NO_CLASS
        for t in row.tok:
            left, right, cost = cost_of[t.s, t.p] if t.p else (NO_CLASS, NO_CLASS, UNKNOWN + EACH * len(t.s))
            total, before = total + pairs.get((before, left), 0) + cost, right
        assert total + pairs.get((before, NO_CLASS), 0) == _all_costs(row.line, entries, pairs), row


def test_spaces_kinds_and_nulls(spark):
    entries = spark.createDataFrame([("夜", None, None, None, None, None), ("夜空", "夜空", "名詞", 1, 1, -5), ("夜空", "夜空", "名詞", 1, 1, -5)], ENTRY)
    df = spark.createDataFrame([("夜空  abcx12",), ("\u3000",), ("",), (None,), ("12 \u3000夜",), ("🌙ab" + "c" * 5000,)], "line string")
    got = [[(t.s, t.l, t.p, t.b, t.e) for t in r.tok] for r in tagged_lines(df, lattice_tagger(entries, spark.createDataFrame([], PAIR))).collect()]
    assert got[0] == [("夜空", "夜空", "名詞", 0, 2), ("abcx", "abcx", "", 4, 8), ("12", "12", "", 8, 10)]
    assert got[1:5] == [[], [], [], [("12", "12", "", 0, 2), ("夜", "夜", "", 4, 5)]]
    assert "".join(t[0] for t in got[5]) == "🌙ab" + "c" * 5000 and len(got[5]) < 90


@pytest.mark.parametrize("bad", ["", None, "a b", "x" * 65])
def test_bad_surfaces_fail(spark, bad):
    with pytest.raises(ValueError, match="surface"):
        dictionary(spark.createDataFrame([(bad, "l", "p", 1, 1, 1), ("a", "l", "p", 1, 1, 1)], ENTRY), spark.createDataFrame([], PAIR))


def test_a_character_is_named_once(monkeypatch):
    """The kind of a character is worked out once, not at each of its places."""
    named = []
    monkeypatch.setattr(lattice.unicodedata, "name", lambda c, d: named.append(c) or "LATIN")
    lattice._kind.cache_clear()
    lattice.cheapest("abab" * 50, {}, {})
    lattice._kind.cache_clear()
    assert sorted(named) == ["a", "b"]


def test_more_turns_are_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(queries, "_TASK_TURNS", 10)
    cut = queries.lattice_tokens(spark, "/root/testdata/sf0.001")
    assert cut.rdd.getNumPartitions() > max(spark.sparkContext.defaultParallelism, cut.count() // 10 - 1)
