"""Shared pieces of the corpus operators: bytes in numpy, scratch tables, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.sources.mart import load

#: Bytes of text that one round of numpy work holds; a longer document is a round of its own.
CHUNK_BYTES = 1 << 19
#: Rows of an Arrow batch.
BATCH_ROWS = 1000
#: Odd multipliers of the polynomial hashes modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: 0x20 and 0x09-0x0D part words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of long rows with fewer splits than there are cores is dealt out."""
    return load(spark, sf_dir, name)


# --- scratch tables ---------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local master without it gets one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "tessera-shared")
    return at.rstrip("/")


def bound_batches(spark: SparkSession) -> None:
    """At most BATCH_ROWS rows go to a Python worker at a time: their texts are held on both sides of the pipe."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor costs a read."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark)}/tessera-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unused(df: DataFrame, name: str) -> str:
    """name, with underlines until df has no such column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


# --- text as bytes ----------------------------------------------------------------


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if len(col) and col.buffers()[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return (data[offsets[0] : offsets[-1]] if len(data) else data), offsets - offsets[0]


def chunks(data: np.ndarray, offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows that fit `most` bytes; every row comes in one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse, modulo 2**64, for i up to n."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 2)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, np.uint64)
            p[1:] = np.uint64(b)
            out.append(np.multiply.accumulate(p))
        have = _powers[base] = (out[0], out[1])
    return have


def prefix_hash(data: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """Sums of (value + 1) * base**i before each place, modulo 2**64."""
    p, _ = powers(base, len(data))
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=c[1:])
    return c


def span_hash(c: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    _, inverse = powers(base, len(c))
    return (c[ends] - c[starts]) * inverse[starts]


def mix(x: np.ndarray) -> np.ndarray:
    """Finishes a 64-bit hash (the splitmix64 output function)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word; words end where rows do."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    black = ~is_space[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = black.copy(), black.copy()
    first[1:] &= ~black[:-1] | edge[1:-1]
    last[:-1] &= ~black[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(span_hash(prefix_hash(data), starts, ends) + (ends - starts).astype(np.uint64))


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of k words; a row with 1 to k - 1 words gives its whole sequence once."""
    per_row = np.bincount(rows, minlength=n_rows)
    first = np.concatenate(([0], np.cumsum(per_row)))
    salt = [np.uint64((2 * i + 1) * 0xD6E8FEB86659FD93 % (1 << 64)) for i in range(k)]
    n = len(hashes)
    if n >= k:
        acc = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            acc = mix(acc + hashes[i : n - k + 1 + i] * salt[i])
        whole = rows[: n - k + 1] == rows[k - 1 :]
        out, at = acc[whole], rows[: n - k + 1][whole]
    else:
        out, at = np.zeros(0, np.uint64), np.zeros(0, rows.dtype if len(rows) else np.int64)
    short = np.flatnonzero((per_row > 0) & (per_row < k))
    if len(short):
        more = []
        for r in short:
            x = np.zeros(1, np.uint64)
            for i in range(per_row[r]):
                x = mix(x + hashes[first[r] + i : first[r] + i + 1] * salt[i])
            more.append(x[0] ^ np.uint64(per_row[r]))
        out, at = np.concatenate((out, np.array(more, np.uint64))), np.concatenate((at, short))
        order = np.argsort(at, kind="stable")
        out, at = out[order], at[order]
    return out, at


def unique_per_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), by row and then value."""
    if not len(values):
        return values, rows
    order = np.lexsort((values, rows))
    v, r = values[order], rows[order]
    keep = np.ones(len(v), bool)
    keep[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    return v[keep], r[keep]


def list_array(values: np.ndarray, rows: np.ndarray, n_rows: int, kind: pa.DataType) -> pa.Array:
    """Values, sorted by row, as a list for each row."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n_rows)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def over_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """f over every record batch of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from f(b)

    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches that come sorted by them; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cut = np.zeros(b.num_rows, bool)
        for k in keys:
            x = b.column(k).to_numpy(zero_copy_only=False)
            cut[1:] |= x[1:] != x[:-1]
        if held and any(held[-1].column(k)[-1].as_py() != b.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *np.flatnonzero(cut), b.num_rows]
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            if s:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


# --- connected components ---------------------------------------------------------


class Forest:
    """Union-find over positions; the smaller root stays."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def _thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning star of each component among the edges of a batch; sound in any grouping of the edges."""
    for b in batches:
        if not b.num_rows:
            continue
        a, c = b.column(0).to_numpy(), b.column(1).to_numpy()
        nodes, at = np.unique(np.concatenate((a, c)), return_inverse=True)
        forest = Forest(len(nodes))
        half = len(a)
        for x, y in zip(at[:half].tolist(), at[half:].tolist(), strict=True):
            forest.union(x, y)
        root = np.array([forest.find(i) for i in range(len(nodes))], np.int64)
        leaf = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[root[leaf]], pa.int64()), pa.array(nodes[leaf], pa.int64())], ["a", "b"])


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, comp) for every node of the edges (a, b, long): comp is the smallest node that links reach.

    Alternating large and small stars: each round joins every edge with the smallest
    neighbour of one end, by aggregates with partial sums and joins that adaptive
    execution can split, so a node with very many links burdens no task. Each round is
    a written table. No row leaves the executors but counts.
    """
    spark = edges.sparkSession
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    e = materialize(e.mapInArrow(_thin, "a long, b long").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        # Large star: every larger neighbour of u goes to the least of u and its neighbours.
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # Small star: the smaller neighbours of u, and u, go to the least of them.
        small_least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_least, "b").select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("s")).select("s.a", "s.b").where("a < b").distinct()
        e = materialize(small, "edges")
        now = e.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.hash("a", "b").cast("long")), F.lit(0)).alias("h"), F.countDistinct("b").alias("leaves"), F.coalesce(F.sum(F.xxhash64("a", "b") % 1000003), F.lit(0)).alias("x")).first()
        if now == seen or now.n == 0:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()
    return e.select(F.col("b").alias("node"), F.col("a").alias("comp")).union(roots)


# --- helpers of joins by hash -----------------------------------------------------


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]]:
    """Columns of rows that come sorted by key, with starts and ends of the runs of two rows or more.

    A run is never cut: the last one of a batch waits for the next batch.
    """
    held: dict[str, np.ndarray] = {}

    def cut(cols: dict[str, np.ndarray], end: int) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        k = cols[key][:end]
        edges = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1, [end]))
        many = np.flatnonzero(np.diff(edges) > 1)
        return cols, edges[many], edges[many + 1]

    for b in batches:
        if not b.num_rows:
            continue
        new = {c: b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names}
        cols = {c: np.concatenate((held[c], x)) for c, x in new.items()} if held else new
        end = int(np.searchsorted(cols[key], cols[key][-1], "left"))
        if end:
            yield cut(cols, end)
        held = {c: x[end:].copy() for c, x in cols.items()}
    if held:
        yield cut(held, len(held[key]))


def id_bitmap(df: DataFrame, col: str, bits: int = 23) -> np.ndarray:
    """A bitmap of 2**bits bits with one set for each id (long): fixed in size, it may say yes too often, never no.

    It only spares shuffles; an exact join must follow.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for b in batches:
            seen[_slots(b.column(0).to_numpy(zero_copy_only=False), bits)] = True
        words = np.packbits(seen, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(words[at])], ["w", "b"])

    words = df.select(F.col(col).cast("long")).coalesce(max(1, 8 * df.sparkSession.sparkContext.defaultParallelism)).mapInArrow(mark, "w int, b long")
    t = words.groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow()  # 2**(bits - 6) rows at most
    out = np.zeros((1 << bits) >> 6, np.int64)
    out[t["w"].to_numpy()] = t["b"].to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def _slots(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def in_bitmap(bitmap: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return bitmap[_slots(ids, len(bitmap).bit_length() - 1)]


#: Bits of a filter for each id, and the most ids that one is made for: 32 MB.
FILTER_BITS, MOST_FILTERED = 8, 1 << 25


def id_filter(df: DataFrame, col: str) -> np.ndarray | None:
    """Words of a filter with a bit set for each id (long), sized by their number; None, which lets all pass, beyond MOST_FILTERED.

    It only spares shuffles and may say yes too often, never no: an exact join must
    follow. df should be a written table, as it is read twice.
    """
    n = df.select(col).count()
    if n > MOST_FILTERED:
        return None
    bits = max(12, (FILTER_BITS * max(n, 1) - 1).bit_length())

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            slot = np.unique(_slots(b.column(0).to_numpy(zero_copy_only=False), bits))
            if len(slot):
                word, first = np.unique(slot >> 6, return_index=True)
                value = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (slot & 63).astype(np.uint64)), first)
                yield pa.RecordBatch.from_arrays([pa.array(word, pa.int32()), pa.array(value.view(np.int64))], ["w", "b"])

    words = df.select(F.col(col).cast("long")).where(F.col(col).isNotNull()).mapInArrow(mark, "w int, b long")
    t = words.groupBy("w").agg(F.expr("bit_or(b)").alias("b")).toArrow()  # 2**(bits - 6) rows at most
    out = np.zeros(1 << (bits - 6), np.int64)
    out[t["w"].to_numpy()] = t["b"].to_numpy()
    return out.view(np.uint64)


def in_filter(words: np.ndarray | None, ids: np.ndarray) -> np.ndarray:
    """Which ids may be in the filter."""
    if words is None:
        return np.ones(len(ids), bool)
    slot = _slots(ids, (len(words) << 6).bit_length() - 1)
    return (words[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
