"""Annotated-text facts of the driver's tables: lines and tokens of documents."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tessera.operators.sequence import regex_spans

#: The built-in tokenizer back-end: runs of letters.
LETTERS = r"\p{L}+"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that has fewer splits than there are cores, as all is in one row group, say, is dealt out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in _SPREAD and df.rdd.getNumPartitions() < cores else df


#: Tables whose rows are long, or give many rows.
_SPREAD = ("documents", "pages", "conversations")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local master without it gets one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "tessera-shared")
    return at.rstrip("/")


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, line_idx, line): \\n-split lines, 0-based."""
    return docs.select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n", -1)).alias("line_idx", "line"))


def tokens(text_lines: DataFrame) -> DataFrame:
    """One row for each letter run: pos, surface, lemma (lower case); no shuffle."""
    return text_lines.select("doc_id", "source", "lang", "line_idx", F.posexplode(F.regexp_extract_all("line", F.lit(LETTERS), 0)).alias("pos", "surface")).withColumn("lemma", F.lower("surface"))


TOKEN = "struct<s:string,l:string,p:string,p2:string,k:string,lk:string,f:string,b:int,e:int>"


def tagged_lines(text_lines: DataFrame, tagger: Callable[[], Callable[[str], list[dict]]]) -> DataFrame:
    """text_lines with tok, an array of tokens by a back-end of the caller's choice.

    tagger() is called once for each task and gives a function from a line to its tokens,
    dicts with s and whatever else TOKEN has. Tokens without a place get the next one
    where the surface is found, l defaults to s. Null lines have no tokens.
    """

    def place(line: str, found: list[dict]) -> list[dict]:
        at, out = 0, []
        for t in found:
            b = t["b"] if "b" in t else max(line.find(t["s"], at), at)
            at = t.get("e", b + len(t["s"]))
            out.append({"l": t["s"], **t, "b": b, "e": at})
        return out

    schema = StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in text_lines.schema) + f", tok array<{TOKEN}>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tag, kind = tagger(), to_arrow_type(schema["tok"].dataType)
        for b in batches:
            rows = [place(x, tag(x)) if x is not None else [] for x in b.column("line").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, kind)], [*b.schema.names, "tok"])

    return text_lines.mapInArrow(run, schema)


def token_array(line: Column) -> Column:
    """The letter runs of a line: array of surface, lemma, c_start and c_end (half-open, in code points)."""
    spans = regex_spans(line, LETTERS)
    words = F.regexp_extract_all(line, F.lit(LETTERS), 0)
    return F.zip_with(words, spans, lambda w, x: F.struct(w.alias("surface"), F.lower(w).alias("lemma"), x["s"].cast("long").alias("c_start"), x["e"].cast("long").alias("c_end")))


def placed_tokens(text_lines: DataFrame) -> DataFrame:
    """tokens with c_start and c_end; places are summed within the line's array, without a shuffle."""
    return text_lines.select("doc_id", "source", "lang", "line_idx", F.posexplode(token_array(F.col("line"))).alias("pos", "x")).select("doc_id", "source", "lang", "line_idx", "pos", "x.*")


def counted(docs: DataFrame) -> DataFrame:
    """Documents that aren't later versions of another: the first doc_id of each (source, text) stays."""
    keyed = docs.withColumn("_h", F.sha2("text", 256))
    # The smallest id is summed before the shuffle, so a text with very many copies is no task of its own.
    firsts = keyed.groupBy(F.col("source").alias("_s"), F.col("_h").alias("_k")).agg(F.min("doc_id").alias("_first"))
    same = F.col("source").eqNullSafe(F.col("_s")) & F.col("_h").eqNullSafe(F.col("_k"))
    return keyed.join(firsts, same).withColumn("dup_of", F.nullif("_first", F.col("doc_id"))).drop("_h", "_s", "_k", "_first")
