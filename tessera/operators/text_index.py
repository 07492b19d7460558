"""An inverted index of short runs of characters, for substring search in any column.

Every run of one to three characters of a column is a gram; its postings are the ids of
the rows that have it, as sorted arrays of one block of ids each, so that no row grows
with the table. The index is a table in folders by a hash of the gram: a search reads
the folders of its own grams. It finds the blocks that all grams share, intersects their
arrays, and looks at the rows that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.arrays import let
from tessera.sources.letters import parts

#: Characters of the longest gram, ids of a block, and folders.
GRAM, BLOCK_IDS, FOLDERS = 3, 1 << 16, 64

SCHEMA = "gram string, col string, block long, ids array<long>, batch string, folder int"


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def grams(text: Column) -> Column:
    """The distinct runs of 1 to GRAM characters of a text; null has none."""

    def runs(chars: Column) -> Column:
        of = lambda n: F.transform(F.slice(chars, F.lit(1), F.greatest(F.size(chars) - (n - 1), F.lit(0))), lambda c, i: F.concat(c, *(F.get(chars, i + k) for k in range(1, n))))
        return F.array_distinct(F.flatten(F.array(*(of(n) for n in range(1, GRAM + 1)))))

    return F.when(F.length(text) > 0, let(F.filter(F.split(text, ""), lambda x: x != ""), runs)).otherwise(F.array().cast("array<string>"))


def _pieces(block_ids: int):
    """Postings of a part of a batch at a time: (gram, col, block, ids) of (id, col, text)."""

    def gram(code: int) -> str:
        return "".join(chr((code >> 21 * i & 0x1FFFFF) - 1) for i in range(GRAM) if code >> 21 * i)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in parts(whole, "text"):
                texts = ["" if x is None else x for x in b.column("text").to_pylist()]
                points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64) + 1
                if not len(points):
                    continue
                row = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
                code, at = [points], [row]  # 21 bits a character, so 0 is none
                for n in range(1, GRAM):
                    same = row[n:] == row[:-n]
                    code.append(sum(points[k : len(points) - n + k] << 21 * k for k in range(n + 1))[same])
                    at.append(row[n:][same])
                code, at = np.concatenate(code), np.concatenate(at)
                id_, col = b.column("id").to_numpy(), b.column("col").dictionary_encode()
                kind = col.indices.to_numpy().astype(np.int64)[at]
                order = np.lexsort((id_[at], kind, code))
                code, kind, id_ = code[order], kind[order], id_[at][order]
                block = id_ // block_ids
                new = np.concatenate(([True], (code[1:] != code[:-1]) | (kind[1:] != kind[:-1]) | (block[1:] != block[:-1])))
                once = new | np.concatenate(([True], id_[1:] != id_[:-1]))
                first = np.flatnonzero(new)
                offsets = np.append(np.cumsum(once)[first] - 1, once.sum())
                known, which = np.unique(code[first], return_inverse=True)
                names = pa.array([gram(x) for x in known.tolist()], pa.string()).take(pa.array(which))
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(id_[once], pa.int64()))
                yield pa.RecordBatch.from_arrays([names, col.dictionary.take(pa.array(kind[first])), pa.array(block[first]), ids], ["gram", "col", "block", "ids"])

    return run


def postings(rows: DataFrame, key: str, columns: list[str], batch: str = "") -> DataFrame:
    """The index of rows: (gram, col, block, ids, batch, folder); ids are sorted and stand once. Rows with a null key aren't indexed.

    What is shuffled are lists of ids, of all rows of a part of a batch.
    """
    each = F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("text")) for c in columns))
    texts = rows.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.explode(each).alias("x")).select("id", "x.*")
    pieces = texts.mapInArrow(_pieces(BLOCK_IDS), "gram string, col string, block long, ids array<long>")
    blocks = pieces.groupBy("gram", "col", "block").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("ids"))
    return blocks.withColumn("batch", F.lit(batch)).withColumn("folder", _folder(F.col("gram")))


def add_to_index(rows: DataFrame, path: str, key: str, columns: list[str], batch: str) -> None:
    """Adds rows to the index at path, as files of their own. A row whose text changes is added again: a search looks at its present text."""
    made = postings(rows, key, columns, batch)
    made.repartition(F.col("folder")).sortWithinPartitions("gram", "col", "block").write.mode("append").partitionBy("folder").parquet(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def wanted_grams(text: str) -> list[str]:
    """Grams that a row must have to contain the text: its runs of GRAM characters, or a shorter text itself."""
    return sorted({text[i : i + GRAM] for i in range(max(1, len(text) - GRAM + 1))} - {""})


def lookup(index: DataFrame, text: str) -> DataFrame:
    """(id, col) of rows that have all grams of the text. One that has them may not contain it; an empty text finds none."""
    want = wanted_grams(text)
    spark = index.sparkSession
    # Folders are worked out here, so that the scan reads no others.
    folders = sorted({r.f for r in spark.createDataFrame([(g,) for g in want], "g string").select(_folder(F.col("g")).alias("f")).collect()}) if want else []
    some = index.where(F.col("folder").isin(folders) & F.col("gram").isin(want))
    # Batches may hold parts of a block.
    whole = some.groupBy("col", "block", "gram").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("ids"))
    shared = whole.groupBy("col", "block").agg(F.collect_list("ids").alias("lists")).where(F.size("lists") == len(want))
    both = F.aggregate(F.slice("lists", F.lit(2), F.size("lists")), F.get("lists", F.lit(0)), F.array_intersect)
    return shared.select("col", F.explode(both).alias("id")).select("id", "col")


def indexed_search(index: DataFrame, rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, col) of the rows of which an indexed column contains the text, as a scan finds them; rows are read by key only where the index has them."""
    found = lookup(index, text)
    said = F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("text")) for c in rows.columns if c != key))
    texts = rows.join(found.select(F.col("id").alias(key)).distinct(), key, "left_semi").select(F.col(key).alias("id"), F.explode(said).alias("x")).select("id", "x.*")
    return texts.join(found, ["id", "col"]).where(F.contains("text", F.lit(text))).select(F.col("id").alias(key), "col").distinct()
