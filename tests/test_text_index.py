"""Search through the index of grams against a scan of every column."""

import random

from pyspark.sql import functions as F

from tessera.operators import text_index
from tessera.operators.text_index import add_to_index, grams, indexed_search, lookup, open_index, wanted_grams

SCHEMA = "id long, kanji string, kana string, romaji string, meaning string"


def _rows():
    rnd = random.Random(8)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 9)))
    rows = [(i * 40_000, word("夜空駆言葉😀"), word("よるそらか"), word("yorusaka "), rnd.choice([None, "", word("夜ab ")])) for i in range(120)]
    return [*rows, (None, "夜", "よる", "yoru", "night"), (7, None, None, None, None)]


def _scan(rows, text):
    return {(r[0], c) for r in rows if r[0] is not None for c, x in zip(["kanji", "kana", "romaji", "meaning"], r[1:], strict=True) if x is not None and text and text in x}


def test_same_as_a_scan(spark, tmp_path):
    """In two increments, one of which comes again; a row that changes is found by its new text."""
    rows = _rows()
    df, path = spark.createDataFrame(rows, SCHEMA), f"file://{tmp_path}/index"
    columns = ["kanji", "kana", "romaji", "meaning"]
    add_to_index(df.where("id < 2000000 OR id IS NULL"), path, "id", columns, "one")
    add_to_index(df.where("id >= 2000000"), path, "id", columns, "two")
    add_to_index(df.where("id < 90000"), path, "id", columns, "again")
    index = open_index(spark, path)
    for text in ["夜", "夜空", "駆言葉", "よるそら", "yo", "u", "a", "rusa", " ", "😀", "none", "", "夜" * 12, "ab"]:
        got = [tuple(r) for r in indexed_search(index, df, "id", text).collect()]
        assert len(got) == len(set(got)) and set(got) == _scan(rows, text), text
    changed = spark.createDataFrame([(40_000, "海", "うみ", "umi", "sea")], SCHEMA)
    add_to_index(changed, path, "id", columns, "three")
    now = df.where("id <> 40000").unionAll(changed)
    assert [tuple(r) for r in indexed_search(open_index(spark, path), now, "id", "うみ").collect()] == [(40_000, "kana")]
    old = rows[1][3]
    new = [(40_000, "海", "うみ", "umi", "sea") if r[0] == 40_000 else r for r in rows]
    assert {tuple(r) for r in indexed_search(open_index(spark, path), now, "id", old).collect()} == _scan(new, old)


def test_reads_only_its_folders(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    add_to_index(spark.createDataFrame(_rows(), SCHEMA), path, "id", ["kanji", "romaji"], "x")
    index = open_index(spark, path)
    plan = lookup(index, "yor")._jdf.queryExecution().toString()
    assert "PartitionFilters: [folder" in plan.replace("isnotnull(folder#", "folder") or "PartitionFilters: [isnotnull(folder" in plan
    assert "PushedFilters" in lookup(index, "yor")._sc._jvm.PythonSQLUtils.explainString(lookup(index, "yor")._jdf.queryExecution(), "formatted")


def test_blocks_and_grams(spark, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_IDS", 10)
    got = text_index.postings(spark.range(95).selectExpr("id", "'ab' AS x"), "id", ["x"]).collect()
    assert sorted((r.gram, r.block, len(r.ids)) for r in got) == sorted((g, b, 10 if b < 9 else 5) for g in ("a", "b", "ab") for b in range(10))
    assert all(r.ids == sorted(r.ids) for r in got)
    one = lambda x: spark.createDataFrame([(x,)], "x string").select(grams(F.col("x")).alias("g")).first().g
    assert sorted(one("aba😀")) == sorted({"a", "b", "😀", "ab", "ba", "a😀", "aba", "ba😀"}) and one("") == [] and one(None) == [] and one("a") == ["a"]
    assert wanted_grams("abcd") == ["abc", "bcd"] and wanted_grams("ab") == ["ab"] and wanted_grams("") == []


def test_postings_are_the_grams_of_each_row(spark):
    """Pieces of a batch are lists of ids, so that not each gram of each row is shuffled."""
    rows = spark.createDataFrame([(i, ["夜空😀", "ab\0a", "", None, "aaaa", "é"][i % 6], "ab") for i in range(-30, 60)], "id long, x string, y string").repartition(3)
    want = {(r.g, c, r.id) for c in ("x", "y") for r in rows.select("id", F.explode(grams(F.col(c))).alias("g")).collect()}
    got = [(r.gram, r.col, i) for r in text_index.postings(rows, "id", ["x", "y"]).collect() for i in r.ids]
    assert len(got) == len(set(got)) and set(got) == want
    pieces = rows.selectExpr("id", "'y' AS col", "y AS text").mapInArrow(text_index._pieces(1 << 16), "gram string, col string, block long, ids array<long>")
    assert pieces.count() <= 2 * 3 * rows.rdd.getNumPartitions()
