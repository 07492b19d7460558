"""The library's JSON documents as DataFrames, the relational mart made of them, and its sinks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.lexicon import table_hits

_TOKEN = "struct<s:string,l:string,k:string,lk:string,p:string,p2:string,f:string,i:array<int>>"
#: The documents' fields. Rules stay JSON text, as their shape differs.
SCHEMAS = {
    "song": f"id string, album string, ja string, zh string, lines array<struct<t:int,ja:string,zh:string,tok:array<{_TOKEN}>,gram:array<array<string>>>>",
    "catalog": "bands array<struct<id:string,ja:string,zh:string>>, albums array<struct<id:string,band:string,ja:string,zh:string,year:string,type:string,note:string,done:boolean,dir:string,short:string,cover:string,badge:string>>, songs array<struct<id:string,album:string,ja:string,zh:string,track:int,file:string,dup_of:string,lib_ja:string,links:map<string,string>>>",
    "lexicon": "w string, k string, r string, m string, ex array<string>, match array<string>",
    "grammar": "id string, g string, r string, m string, ex array<string>, rule string",
    "corrections": "tok string, line string, k string, l string, lk string, p string, p2 string, note string",
    "map": "bands array<struct<lib:string,id:string,ja:string,zh:string>>, albums array<struct<lib:string,id:string>>",
}


def read_json(spark: SparkSession, path: str | list[str], kind: str) -> DataFrame:
    """Whole JSON files by an explicit schema; a file that is a list gives a row for each item. What a document lacks is null."""
    return spark.read.schema(SCHEMAS[kind]).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(lemma, note) of a JSON map."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("lemma", "note"))


def mart(songs: DataFrame, catalog: DataFrame, lexicon: DataFrame, grammar: DataFrame) -> dict[str, DataFrame]:
    """The mart's tables by name."""
    part = lambda name: catalog.select(F.explode(name).alias("x")).select("x.*")
    example = lambda: [F.get("ex", F.lit(i)).alias(n) for i, n in enumerate(("ex_ja", "ex_romaji", "ex_zh"))]
    lines = songs.join(part("songs").select(F.col("id").alias("_known")), F.col("id") == F.col("_known"), "left_semi").select(F.col("id").alias("song_id"), F.posexplode("lines").alias("idx", "x")).select("song_id", "idx", "x.*")
    tokens = lines.select("song_id", F.col("idx").alias("line_idx"), F.posexplode("tok").alias("pos", "x"))
    span = lambda x: [F.get(x, F.lit(i)).cast("int").alias(n) for i, n in enumerate(("c_start", "c_end"))]
    placed = F.transform("tok", lambda t: t.withField("b", F.get(t["i"], F.lit(0))).withField("e", F.get(t["i"], F.lit(1))))
    hits = table_hits(lines.select("song_id", F.col("idx").alias("line_idx"), "ja", placed.alias("tok")), lexicon, ["song_id", "line_idx"], "ja")
    return {
        "bands": part("bands"),
        "albums": part("albums").select("id", "band", "ja", "zh", "year", "type", "note", F.coalesce("done", F.lit(False)).alias("done")),
        "songs": part("songs").select("id", "album", "track", "ja", "zh", "dup_of"),
        "lines": lines.select("song_id", "idx", F.col("t").alias("t_ms"), "ja", "zh"),
        "tokens": tokens.select("song_id", "line_idx", "pos", F.col("x.s").alias("surface"), F.col("x.l").alias("lemma"), F.col("x.k").alias("kana"), F.col("x.lk").alias("lemma_kana"), F.col("x.p").alias("pos1"), F.col("x.p2").alias("pos2"), F.col("x.f").alias("cform"), *span(F.col("x.i"))),
        "entries": lexicon.select("w", F.col("k").alias("kana"), F.col("r").alias("romaji"), F.col("m").alias("meaning"), *example()),
        "entry_hits": hits.select("w", "song_id", "line_idx", F.col("s").alias("c_start"), F.col("e").alias("c_end")),
        "grammar": grammar.select("id", F.col("g").alias("pattern"), F.col("r").alias("romaji"), F.col("m").alias("meaning"), *example()),
        "grammar_hits": lines.select("song_id", F.col("idx").alias("line_idx"), F.explode("gram").alias("g")).select(F.get("g", F.lit(0)).alias("grammar_id"), "song_id", "line_idx", F.get("g", F.lit(1)).cast("int").alias("c_start"), F.get("g", F.lit(2)).cast("int").alias("c_end")),
        "known": lexicon.sparkSession.createDataFrame([], "w string"),
    }


def register(tables: dict[str, DataFrame]) -> None:
    """Temporary views of the tables, and the two that count: counted_songs and lemma_song_counts."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    counted = tables["songs"].where("dup_of IS NULL")
    counted.createOrReplaceTempView("counted_songs")
    counts = tables["tokens"].join(counted.select(F.col("id").alias("song_id")), "song_id").groupBy("lemma", "pos1", "song_id").agg(F.count("*").alias("n"))
    counts.createOrReplaceTempView("lemma_song_counts")


def write_mart(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as Parquet under the folder, in place of what is there."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_json(df: DataFrame, folder: str) -> None:
    """A JSON document a line, compact and without nulls."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(folder)


def picked(df: DataFrame, keys: dict[str, str]) -> DataFrame:
    """The listed columns, as far as df has them, under their new names."""
    return df.select(*(F.col(k).alias(v) for k, v in keys.items() if k in df.columns))


def document(**parts: DataFrame) -> DataFrame:
    """One row (value) of JSON text: an object whose parts are the rows of each DataFrame, in the order of its `ord`. Each part must fit one task."""

    def rows(name: str, df: DataFrame) -> DataFrame:
        fields = [c for c in df.columns if c != "ord"]
        return df.agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("x")))).alias("a")).select(F.transform("a", lambda r: r["x"]).alias(name))

    one = reduce(lambda a, b: a.crossJoin(b), (rows(n, df) for n, df in parts.items()))  # a row each
    return one.select(F.to_json(F.struct(*parts)).alias("value"))


def conditional_copy(new: DataFrame, old: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(files to write, files kept) of new and old files (path, content): a file that differs from the old one of its path is kept, unless forced."""
    both = new.join(old.select("path", F.sha2(F.col("content").cast("binary"), 256).alias("_old")), "path", "left")
    same: Column = F.coalesce(F.col("_old") == F.sha2(F.col("content").cast("binary"), 256), F.lit(True))
    if force:
        same = F.lit(True)
    return both.where(same).drop("_old"), both.where(~same).select("path")
