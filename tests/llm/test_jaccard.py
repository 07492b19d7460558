"""The Jaccard join: what it sends for near copies, and clusters of many tiles against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard


def test_near_copies_send_no_pairs(spark):
    """96 shared n-grams of each of 20 groups of 12 near copies: fewer rows than documents, where all pairs of all columns would be 6336 a group."""
    rows = spark.range(20 * 96).selectExpr("id AS gram", "id DIV 96 AS g").withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(11))))
    entries = rows.select("gram", (F.col("g") * 100 + F.col("v")).alias("rep"), F.lit(480).cast("long").alias("n"))
    got = jaccard.shared_counts(entries).collect()
    assert len(got) < 240 and {(r.a // 100, r.a, r.b) for r in got} == {(g, g * 100, g * 100 + v) for g in range(20) for v in range(1, 12)}


@pytest.mark.parametrize("seed,pivots", [(1, 16), (2, 2), (3, 0)])
def test_clusters_of_many_tiles(spark, monkeypatch, seed, pivots):
    """One frequent passage makes one cluster of copies in several families, some of which link and some don't."""
    monkeypatch.setattr(jaccard, "TILE_ROWS", 8)
    monkeypatch.setattr(jaccard, "PIVOTS", pivots)
    rnd = random.Random(seed)
    common = [f"c{i}" for i in range(40)]
    texts = []
    for family in range(4):
        own = [f"f{family}w{i}" for i in range(rnd.choice([4, 12, 30]))]
        for _ in range(30):
            words = common + own
            for _ in range(rnd.choice([0, 1, 1, 2])):
                words[rnd.randrange(len(words))] = f"x{rnd.random()}"
            texts.append(" ".join(words))
    sets = []
    for t in texts:
        w = t.split(" ")
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)})
    up = list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()}
    assert got == {i: root(i) for i in range(len(texts))}


def test_large_part_is_not_multiplied_again(spark):
    """Of a cluster whose rows are one part but for one, only that one meets all again."""
    large = spark.range(3000).selectExpr("id AS rep", "0L AS cluster", "100L AS n", "28L AS s")
    links = spark.range(1, 2999).selectExpr("0L AS a", "id AS b")
    got = jaccard._open_tiles(large, links)
    assert got.count() < 3100 and got.select("rep").distinct().count() == 3000
