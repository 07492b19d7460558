import collections
import os
import random
import re

import duckdb
import pytest

import corpus_pipeline
from tessera.llm.importance import resample
from tessera.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        left = {r.doc_id for r in docs.collect()}
        assert docs.columns == columns and left <= before, name
        before = left
    out = corpus_pipeline.sentencepiece_encoding(spark, docs, SF)
    assert {r.doc_id for r in out.collect()} == before and all(r.decoded for r in out.collect())


WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def _tables(spark, folder, documents, labels, items):
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, __lines int"
    spark.createDataFrame(documents, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return f"file://{folder}"


def _fixture():
    rnd = random.Random(21)
    good, bad = [f"k{i}" for i in range(300)], [f"z{i}" for i in range(40)]
    line = lambda vocab, n: " ".join(rnd.choice(vocab) for _ in range(n))
    shared = [line(good, 14) for _ in range(3)]
    item = line(good, 30)
    texts = []
    for i in range(90):
        lines = [line(bad if i % 6 == 5 else good, rnd.randrange(4, 25)) for _ in range(rnd.randrange(1, 5))]
        if i % 7 == 1:
            w = rnd.choice(shared).split()
            w[rnd.randrange(len(w))] = "other"
            lines.insert(rnd.randrange(len(lines) + 1), " ".join(w))
        if i % 11 == 3:
            lines.append("A note: " + item.upper())
        texts.append("\n".join(lines))
    for i in range(12):  # near copies, of lines that differ in two words
        out = []
        for x in texts[4 * i].split("\n"):
            w = x.split(" ")
            if len(w) > 15:
                w[1] = w[-2] = "changed"
            out.append(" ".join(w))
        texts.append("\n".join(out))
    long = line(good, 120).split(" ")
    texts.append(" ".join(long))
    for i in range(6):  # near by shingles, not by lines
        w = list(long)
        w[10 + i] = w[90 + i] = f"k{i}0"
        texts.append(" ".join(w))
    texts += [shared[0], "k1 k2", texts[2] + "\n" + texts[2]]
    documents = [(i, t, "en", "s", len(t), "x", 1) for i, t in enumerate(texts)]
    documents += [documents[0], documents[0], (500, None, None, None, None, None, None), (501, "", "en", "s", 0, "", 2), (502, " \n\t", "en", "s", 3, "", 2), (None, texts[7], "en", "s", 1, "", 2), (None, "x " + item, "en", "s", 1, "", 2)]
    labels = [(i, int(i > 90 or i % 6 != 5), 0) for i in (*range(0, 90, 2), *range(102, 109))]
    return documents, labels, [(1, item), (None, "k5 " * 9), (2, None)]


def _near(a, b):
    def distance(x, y):
        p = list(range(len(y) + 1))
        for i, u in enumerate(x, 1):
            c = [i]
            for j, v in enumerate(y, 1):
                c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (u != v)))
            p = c
        return p[-1]

    n, m = sorted((len(a), len(b)))
    if a == b or m - n <= min(2, n // 10) and distance(a, b) <= min(2, n // 10):
        return True
    v, w = WORDS.findall(a), WORDS.findall(b)
    return min(len(v), len(w)) >= 10 and distance(v, w) <= 1


def _plain_lines(docs):
    """Later lines that are near an earlier one go, and documents without a word left."""
    places = sorted({(d, n, x) for d, t, *_ in docs if d is not None for n, x in enumerate(t.split("\n")) if WORDS.search(x)})
    gone = {(d, n) for i, (d, n, x) in enumerate(places) if any(_near(x, y) for _, _, y in places[:i])}
    out = []
    for d, t, *rest in docs:
        if d is not None and any((d, n) in gone for n in range(t.count("\n") + 1)):
            t = "\n".join(x for n, x in enumerate(t.split("\n")) if (d, n) not in gone)
            if not WORDS.search(t):
                continue
        out.append((d, t, *rest[:2], len(t), *rest[3:]))
    return out


def _plain_copies(docs):
    """One of each group of 80 % by five-word shingles stays, the one with the smallest doc_id."""
    sets = {}
    for d, t, *_ in docs:
        w = WORDS.findall("".join(c.lower() if c.isascii() else c for c in t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    comp = {d: d for d in sets if d is not None}
    moved = True
    while moved:
        moved = False
        for a in comp:
            for b in comp:
                if comp[a] < comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[b], moved = comp[a], True
    return [x for x in docs if x[0] is None or comp[x[0]] == x[0]]


def _plain_leaks(docs, items):
    words = lambda t: re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", (t or "").lower()).split()
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    wanted = [(grams(w, min(5, len(w))), min(5, len(w))) for _, t in items if (w := words(t))]
    return [x for x in docs if not any(100 * len(s & grams(words(x[1]), k)) >= 80 * len(s) for s, k in wanted)]


def test_against_brute_force(spark, tmp_path):
    documents, labels, items = _fixture()
    folder = _tables(spark, tmp_path, documents, labels, items)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = lambda df: collections.Counter(map(tuple, df.collect()))
    kept = {(r.doc_id, r.perturbed) for r in resample(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect() if r.kept}
    ids = {d for d, _ in kept}
    by_stage = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), "test")
        by_stage.append(rows(docs))
    first = [x for x in documents if x[0] in ids and WORDS.search(x[1] or "")]
    assert by_stage[0] == collections.Counter(first) and 60 < len(first) < 110
    second = _plain_lines(first)
    assert by_stage[1] == collections.Counter(second) and 0 < len(second) < len(first) and second != first
    third = _plain_copies(second)
    assert by_stage[2] == collections.Counter(third) and len(third) < len(second)
    fourth = _plain_leaks(third, items)
    assert by_stage[3] == collections.Counter(fourth) and len(fourth) < len(third)
    out = corpus_pipeline.run(spark, folder).collect()
    assert all(r.decoded for r in out) and collections.Counter(r.doc_id for r in out if r.sample == 1) == collections.Counter(x[0] for x in fourth)


def test_empty_tables(spark, tmp_path):
    folder = _tables(spark, tmp_path / "none", [], [], [])
    assert corpus_pipeline.run(spark, folder).count() == 0
    documents, _, _ = _fixture()
    folder = _tables(spark, tmp_path / "few", documents[:5], [], [])
    assert {r.doc_id for r in corpus_pipeline.run(spark, folder).collect()} <= set(range(5))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    df, want = QUERIES[name](spark, SF), con.sql(SQL[name])
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())
