"""Letter runs by arrays against the expressions over a line, and phrases by a trie that all places walk."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.operators.lexicon import Automaton, Trie
from tessera.operators.sequence import regex_spans
from tessera.sources import letters
from tessera.sources.letters import held_tokens, token_lines, word_totals
from tessera.sources.mart import token_array

ODD = [None, "", " ", "a", "ab c", "İX ΟΔΟΣ Σ", "é éx", "😀a😀😀bc", "夜空 駆", "𝒜x y𐐀", "don't_stop", "Ǆa ǅ Ω", "x1y2", "a­b", "ſßẞ", "\t\r z"]


@pytest.mark.parametrize("at_once", [1, 10, 4_000_000])
def test_same_tokens_as_the_expressions(spark, monkeypatch, at_once):
    monkeypatch.setattr(letters, "TEXT_BYTES", at_once)
    rnd = random.Random(at_once)
    texts = ODD + ["".join(rnd.choice("aB é夜😀.1Σ") for _ in range(rnd.randrange(40))) for _ in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, line string").repartition(2)
    want = {r.id: [tuple(x) for x in r.t or []] for r in df.select("id", token_array(F.col("line")).alias("t")).collect()}
    got = {r.id: r.tok for r in token_lines(df).collect()}
    assert {i: [(x.s, x.l, x.b, x.e) for x in t] for i, t in got.items()} == want
    assert all(x.p == ("cap" if x.s[0].isupper() else "short" if len(x.s) <= 3 else "word") for t in got.values() for x in t if x.s[0] != "ǅ")
    assert all([(x.b, x.e) for x in r.tok] == [(i, i + 1) for i in range(len(r.tok))] for r in token_lines(df, places=False).collect())


def test_tokens_inside_of_hits(spark):
    texts = [*ODD, "Ab cd Ef gh ij", "x Ab cd", "Éa éb Éa éb", "Ab cde Ab", "Ab cd." * 50]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, line string").coalesce(1)
    rows = df.withColumn("hits", regex_spans(F.col("line"), r"\p{Lu}\p{Ll}+ \p{Ll}+"))
    got = sorted(tuple(r) for r in held_tokens(rows, "id").collect())
    want: dict = {}
    for r in rows.withColumn("t", token_array(F.col("line"))).collect():
        for x in r.t or []:
            key = (r.id, x.lemma, any(h.s <= x.c_start and x.c_end <= h.e for h in r.hits))
            want[key] = want.get(key, 0) + 1
    assert got == sorted((i, w, n, held) for (i, w, held), n in want.items()) and any(g[3] for g in got)


@pytest.mark.parametrize("seed", range(4))
def test_trie_finds_what_the_automaton_finds(seed):
    rnd = random.Random(seed)
    phrases = [(str(i), [rnd.choice("abc") for _ in range(rnd.randrange(5))]) for i in range(25)]
    lines = [[rnd.choice(["a", "b", "c", "d", None]) for _ in range(rnd.randrange(12))] for _ in range(40)]
    machine, trie = Automaton(phrases), Trie(phrases)
    want = sorted((r, w, s, e) for r, line in enumerate(lines) for w, s, e in machine.find(line))
    sizes = [len(x) for x in lines]
    starts = [sum(sizes[:r]) for r in range(len(sizes))]
    ends = [starts[r] + sizes[r] for r in range(len(sizes)) for _ in range(sizes[r])]
    row = [r for r in range(len(sizes)) for _ in range(sizes[r])]


    entry, x, y = trie.find(pa.array([w for line in lines for w in line], pa.string()), np.array(ends))
    got = sorted((row[i], trie.entries[int(k)].as_py(), int(i) - starts[row[i]], int(j) + 1 - starts[row[i]]) for k, i, j in zip(entry, x, y, strict=True))
    assert got == want


@pytest.mark.parametrize("at_once,ids", [(1, "once"), (4_000_000, "once"), (10, "again"), (4_000_000, "null")])
def test_word_totals(spark, monkeypatch, at_once, ids):
    """Different keys of each word, nulls not counted, and how often it comes, as rows of tokens give them."""
    monkeypatch.setattr(letters, "TEXT_BYTES", at_once)
    texts = [*ODD, "a b a\nA", "B a", "", "ab ab"] * 3
    key = {"once": lambda i: i, "again": lambda i: i % 7, "null": lambda i: None if i % 2 else i}[ids]
    docs = spark.createDataFrame([(key(i), t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    rows = token_lines(docs.withColumnRenamed("text", "line"), places=False).select("doc_id", F.explode("tok.l").alias("lemma"))
    want = rows.groupBy("lemma").agg(F.countDistinct("doc_id").alias("songs"), F.count("*").alias("total"))
    got = word_totals(docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_songs_are_counted_before_the_shuffle(spark):
    """df_tiers shuffles a batch's lemmas, not a row for each lemma of each document."""
    from tessera.plans.queries import QUERIES

    plan = QUERIES["df_tiers"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and plan.count("Aggregate") == 2
