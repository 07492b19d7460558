import json
import random

from pyspark.sql import functions as F

from tessera.operators.sequence import greedy, matches, regex_spans, rule_spans, seq_spans

TOKEN = "array<struct<s:string,l:string,p:string,p2:string,k:string,f:string,b:int,e:int>>"


def _tokens(*words):
    at, out = 0, []
    for w in words:
        s, p = w.split("/")
        out.append({"s": s, "l": s.lower(), "p": p, "p2": "", "k": None, "f": "", "b": at, "e": at + len(s)})
        at += len(s)
    return json.dumps(out)


def _eval(spark, words, f):
    df = spark.createDataFrame([(_tokens(*words), "".join(w.split("/")[0] for w in words))], "j string, text string").select(F.from_json("j", TOKEN).alias("t"), "text")
    return df.select(f(F.col("t"), F.col("text")).alias("x")).first().x


def _pairs(spans):
    return [(x.s, x.e) for x in spans]


def test_windows_overlap(spark):
    assert _pairs(_eval(spark, ["a/n", "b/n", "c/n"], lambda t, _: seq_spans(t, [{"p": "n"}, {"p": "n"}]))) == [(0, 2), (1, 3)]
    assert _pairs(_eval(spark, ["a/n"], lambda t, _: seq_spans(t, [{"p": "n"}, {"p": "n"}]))) == []


def test_neighbours(spark):
    at = lambda cond, i: _eval(spark, ["a/n", "b/v"], lambda t, _: matches(t, F.lit(i), cond))
    assert at({"s": "a", "next": {"p": "v"}}, 0) and not at({"s": "b", "next": {"p": "v"}}, 1)
    assert at({"!prev": {"p": "n"}}, 0) and not at({"!prev": {"p": "n"}}, 1)
    assert at({"p": ["!x", "n"]}, 0) and not at({"p": "!n"}, 0)
    assert at({"k": ""}, 0) and not at({"s": "aa?b"}, 0)
    # A neighbour's own neighbours are not followed.
    assert at({"next": {"p": "v", "prev": {"p": "q"}}}, 0)


def test_greedy_keeps_the_shortest(spark):
    rule = {"any": [{"tok": [{"p": "n"}, {"p": "n"}]}, {"tok": [{"p": "n"}]}]}
    assert _pairs(_eval(spark, ["a/n", "b/n", "c/n"], lambda t, x: rule_spans(x, t, rule))) == [(0, 1), (1, 2), (2, 3)]
    spans = F.from_json(F.lit('[{"s":2,"e":5},{"s":0,"e":3},{"s":3,"e":4}]'), "array<struct<s:int,e:int>>")
    assert _pairs(spark.range(1).select(greedy(spans).alias("x")).first().x) == [(0, 3), (3, 4)]


def test_regex_spans_count_code_points(spark):
    df = spark.createDataFrame([("😀ab ab", ), ("", ), (None, )], "t string")
    assert [None if r.x is None else _pairs(r.x) for r in df.select(regex_spans(F.col("t"), "ab").alias("x")).collect()] == [[(1, 3), (4, 6)], [], None]


def test_kept_in_turn(spark):
    """Greedy over arrays longer than a block, against a plain loop."""
    rnd = random.Random(3)
    rows = []
    for n in (0, 1, 5, 63, 64, 65, 400):
        starts = [rnd.randrange(2 * n + 1) for _ in range(n)]
        rows.append((n, [(s, s + rnd.randrange(1, 9)) for s in starts]))
    got = {r.n: [tuple(x) for x in r.x] for r in spark.createDataFrame(rows, "n int, x array<struct<s:int,e:int>>").select("n", greedy(F.col("x")).alias("x")).collect()}
    for n, spans in rows:
        kept = []
        for x in sorted(set(spans)):
            if not kept or x[0] >= kept[-1][1]:
                kept.append(x)
        assert got[n] == kept
