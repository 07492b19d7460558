"""MinHash near-dedup with b-bit signatures.

Equal sets of shingles are one class. Of a class, 128 minima are taken; runs of four make
32 band keys, and of each minimum only the low bits are kept, packed into four longs.
Classes that share a band key are candidates; the share of equal low bits, corrected for
those that agree by chance, estimates their similarity, and pairs that are far below the
threshold go. What is left is confirmed on full sets, in two steps. First each class meets
the smallest one of its buckets, and the links found join them to parts. Then only
buckets that still hold several parts are open: their signatures are compared in blocks,
those outside of the bucket's largest part against all others, and the classes whose
estimate reaches the threshold across parts are multiplied out in tiles on full sets, again
those outside of the largest part against the others. So a group of near copies costs
its size, times the number of those that don't link to its first member.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import components, id_filter, in_filter, list_array, materialize, mix, over_arrow, partitions, runs
from tessera.llm.jaccard import _forest, _sets, _tile

SHINGLE_WORDS = 5
PERCENT = 85
#: Bands of minima: classes of the least similarity that links meet in one but for 5e-11 of the pairs.
BANDS, BAND_ROWS = 32, 4
MINIMA = BANDS * BAND_ROWS
#: Bits kept of a minimum; 64 // BITS of them are a long.
BITS = 2
LONGS = MINIMA * BITS // 64
#: Estimates may be so many standard deviations low.
DEVIATIONS = 6
#: Rows of a block of signatures, and rows and n-grams of a block of full sets.
SIGNATURE_ROWS, SET_ROWS, SET_GRAMS = 2048, 256, 400_000

_SALTS = mix(np.arange(1, MINIMA + 1, dtype=np.uint64))
_FACTORS = mix(np.arange(1, MINIMA + 1, dtype=np.uint64) + np.uint64(1 << 40)) | np.uint64(1)
#: One bit for each minimum.
_EACH = sum(1 << i for i in range(0, 64, BITS))


#: Low bits of different minima agree by chance.
CHANCE = 2.0**-BITS


def least_similarity(percent: int) -> float:
    """The lowest estimate that a pair at the threshold may have."""
    p = CHANCE + (1 - CHANCE) * percent / 100
    return percent / 100 - DEVIATIONS * float(np.sqrt(p * (1 - p) / MINIMA)) / (1 - CHANCE)


def similarity(matches):
    """The similarity that a number of agreeing low bits speaks for, corrected for those that agree by chance; of numbers, arrays and columns."""
    return (matches / float(MINIMA) - CHANCE) / (1 - CHANCE)


# --- signatures -------------------------------------------------------------------


def minima(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Minima of each run of v that begins at first, one row for each hash function."""
    out = np.empty((MINIMA, len(first)), np.uint64)
    for i in range(MINIMA):
        out[i] = np.minimum.reduceat((v ^ _SALTS[i]) * _FACTORS[i], first)
    return out


def packed(low: np.ndarray) -> np.ndarray:
    """Low bits of the minima (MINIMA, m) as LONGS rows of longs."""
    bits = low & np.uint64((1 << BITS) - 1)
    shifts = (np.arange(MINIMA, dtype=np.uint64) % np.uint64(64 // BITS)) * np.uint64(BITS)
    return np.bitwise_or.reduce((bits << shifts[:, None]).reshape(LONGS, 64 // BITS, -1), 1)


SIGNED = "doc_id long, n long, h1 long, h2 long, " + ", ".join(f"s{i} long" for i in range(LONGS)) + ", bands array<long>"


def _sign(b: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
    for i, j, v, rows in _sets(b.column("text"), k):
        m = j - i
        n = np.bincount(rows, minlength=m)
        whole = []
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            h = np.zeros(m, np.uint64)
            np.add.at(h, rows, mix(v * np.uint64(salt) + np.uint64(1)))
            whole.append(mix(h + n.astype(np.uint64)).view(np.int64))
        some = np.flatnonzero(n)
        signature, bands = np.zeros((LONGS, m), np.uint64), np.zeros((BANDS, len(some)), np.uint64)
        if len(some):
            least = mix(minima(v, (np.cumsum(n) - n)[some]))
            signature[:, some] = packed(least)
            by_band = least.reshape(BANDS, BAND_ROWS, -1)
            bands += np.arange(1, BANDS + 1, dtype=np.uint64)[:, None]
            for r in range(BAND_ROWS):
                bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + by_band[:, r])
        lists = list_array(bands.T.ravel().view(np.int64), np.repeat(some, BANDS), m, pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, m), pa.array(n, pa.int64()), *map(pa.array, whole), *(pa.array(s.view(np.int64)) for s in signature), lists], ["doc_id", "n", "h1", "h2", *(f"s{i}" for i in range(LONGS)), "bands"])


# --- blocks and tiles -------------------------------------------------------------


def dealt(members: DataFrame, most: int, grams: int | None = None) -> DataFrame:
    """(rep, part, tile) for members (group, rep, part, n) of groups of several parts: every two members of different parts meet in a tile.

    The group's largest part is its host; other members are guests. Both are dealt in
    blocks of about `most` rows, and of `grams` n-grams, and a tile is one block of guests with one of
    hosts or of guests. Blocks of hosts never meet.
    """
    each = members.groupBy("group", "part").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    blocks = lambda rows, size: F.greatest(F.ceil(rows / most), F.ceil(size / grams) if grams else F.lit(1).cast("long"), F.lit(1).cast("long"))
    groups = each.groupBy("group").agg(F.max(F.struct("rows", "part")).alias("top"), F.sum("rows").alias("rows"), F.sum("grams").alias("grams"), F.max_by("grams", F.struct("rows", "part")).alias("host_grams"), F.count("*").alias("parts")).where("parts > 1")
    host_rows = F.col("top.rows")
    groups = groups.select("group", F.col("top.part").alias("host"), blocks(host_rows, F.col("host_grams")).alias("nh"), blocks(F.col("rows") - host_rows, F.col("grams") - F.col("host_grams")).alias("ng"))
    groups = materialize(groups, "groups")
    at = members.join(groups, "group").withColumn("is_host", F.col("part") == F.col("host"))
    at = at.withColumn("i", F.pmod(F.xxhash64("rep", F.lit(3)), F.when(F.col("is_host"), F.col("nh")).otherwise(F.col("ng"))))
    name = lambda kind, i, j: F.xxhash64(F.col("group"), F.lit(kind), i, j)
    count = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    i = F.col("i")
    # With one block of each, guests meet each other in the tile where they meet the hosts.
    guests = F.when(F.col("ng") == 1, F.array().cast("array<bigint>")).otherwise(F.transform(count("ng"), lambda j: name("guests", F.least(i, j), F.greatest(i, j))))
    tiles = F.when(F.col("is_host"), F.transform(count("ng"), lambda j: name("host", i, j))).otherwise(F.concat(F.transform(count("nh"), lambda j: name("host", j, i)), guests))
    return at.select("rep", "part", F.explode(tiles).alias("tile"))


def _near(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges that span, in each tile of signatures, the classes of different parts that are estimated to be near."""
    each = np.uint64(_EACH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for t in runs(batches, ["tile"]):
            rep, part = t.column("rep").to_numpy(), t.column("part").to_numpy()
            s = [t.column(f"s{i}").to_numpy().view(np.uint64) for i in range(LONGS)]
            near = np.empty((len(rep), len(rep)), bool)
            for x in range(0, len(rep), 256):
                differ = np.zeros((len(rep[x : x + 256]), len(rep)), np.uint8)
                for column in s:
                    y = column[x : x + 256, None] ^ column[None, :]
                    y = (y | (y >> np.uint64(1))) & each
                    differ += np.bitwise_count(y)
                near[x : x + 256] = (similarity(MINIMA - differ.astype(np.float32)) >= least) & (part[x : x + 256, None] != part[None, :])
            if near.any():
                out += [(int(rep[x]), int(rep[y])) for x, y in _forest(near)]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return run


def _exact(k: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between full sets in each tile, enough to span them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["tile"]):
            ids = t.column("doc_id").to_numpy()
            sets = list(_sets(t.column("text").combine_chunks(), k))
            v, rows = np.concatenate([s[2] for s in sets]), np.concatenate([s[3] + s[0] for s in sets])
            linked = _tile(v, rows, np.bincount(rows, minlength=len(ids)), percent)
            out = [(int(ids[x]), int(ids[y])) for x, y in _forest(linked)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return run


def _against_first(k: int, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of each tile's first row, which comes first, with the others; rows are streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, own, first = None, None, np.zeros(0, np.uint64)
        for b in batches:
            a, c = [], []
            tiles, ids = b.column("tile").to_numpy(), b.column("doc_id").to_numpy()
            for i, j, v, rows in _sets(b.column("text"), k):
                edge = np.searchsorted(rows, np.arange(j - i + 1))
                for r in range(j - i):
                    mine = v[edge[r] : edge[r + 1]]
                    if tiles[i + r] != tile:
                        tile, own, first = tiles[i + r], ids[i + r], mine.copy()
                        continue
                    at = np.minimum(np.searchsorted(first, mine), max(0, len(first) - 1))
                    shared = int((first[at] == mine).sum()) if len(first) else 0
                    if (100 + percent) * shared >= percent * (len(first) + len(mine)):
                        a.append(own)
                        c.append(ids[i + r])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], ["a", "b"])

    return run


def _with_texts(docs: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tiles (tile, rep, ...) with the texts of their documents, of which few others are shuffled."""
    some = docs.sparkSession.sparkContext.broadcast(id_filter(tiles, "rep"))
    docs = over_arrow(docs, lambda b: iter([b.filter(pa.array(in_filter(some.value, b.column("doc_id").to_numpy())))]), docs.schema)
    return docs.join(tiles, docs["doc_id"] == tiles["rep"]).select("tile", "doc_id", "text", *(c for c in tiles.columns if c not in ("tile", "rep")))


# --- links ------------------------------------------------------------------------


def _matches(left: str, right: str) -> Column:
    """How many low bits of two signatures agree."""
    differ = [F.bit_count(F.expr(f"(({left}{i} ^ {right}{i}) | shiftrightunsigned({left}{i} ^ {right}{i}, 1)) & {_EACH}L")) for i in range(LONGS)]
    return F.lit(MINIMA) - sum(differ[1:], differ[0])


def near_links(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(signed, links): each row's set size, class and smallest doc_id of the class; and confirmed edges (a, b) between classes that span their links."""
    spark = docs.sparkSession
    parts = partitions(spark)
    known = docs.select("doc_id", "text")
    signed = materialize(over_arrow(known, lambda b: _sign(b, k), SIGNED), "signed")
    real = signed.where("n > 0 AND doc_id IS NOT NULL")
    fields = ["n", *(f"s{i}" for i in range(LONGS)), "bands"]
    classes = materialize(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), *(F.first(c).alias(c) for c in fields)), "classes")
    signatures = classes.select("rep", "n", *(f"s{i}" for i in range(LONGS)))
    least = least_similarity(percent)

    # Buckets of several classes; the smallest class of each is its first.
    entries = classes.select(F.explode("bands").alias("key"), "rep")
    buckets = entries.groupBy("key").agg(F.min("rep").alias("first"), F.max("rep").alias("last")).where("first < last").select("key", "first")
    shared = materialize(entries.join(buckets, "key").select("key", "first", "rep"), "buckets")
    named = lambda p, rep: signatures.select(F.col("rep").alias(rep), F.col("n").alias(f"{p}n"), *(F.col(f"s{i}").alias(f"{p}{i}") for i in range(LONGS)))
    pairs = shared.where("rep <> first").select("first", "rep").distinct().join(named("a", "first"), "first").join(named("b", "rep"), "rep")
    sized = 100 * F.least("an", "bn") >= percent * F.greatest("an", "bn")
    pairs = materialize(pairs.where(sized & (similarity(_matches("a", "b")) >= least)).select("first", "rep"), "pairs")
    # A first meets its candidates in tiles of about SET_ROWS; it comes first in each.
    counts = pairs.groupBy("first").agg(F.count("*").alias("rows")).select("first", F.ceil(F.col("rows") / SET_ROWS).alias("blocks"))
    others = pairs.join(counts, "first").select(F.xxhash64("first", F.pmod(F.xxhash64("rep"), "blocks")).alias("tile"), "rep", F.lit(1).alias("place"), "first")
    firsts = others.select("tile", F.col("first").alias("rep"), F.lit(0).alias("place")).distinct()
    texts = known.where(F.col("doc_id").isNotNull())
    tiles = materialize(others.drop("first").unionAll(firsts), "tiles")
    stars = _with_texts(texts, tiles).repartition(parts, "tile").sortWithinPartitions("tile", "place").select("tile", "doc_id", "text").mapInArrow(_against_first(k, percent), "a long, b long")
    stars = materialize(stars.distinct(), "stars")

    # Buckets of several parts are open.
    comp = components(stars)
    part = signatures.join(comp, signatures["rep"] == comp["node"], "left").select("rep", F.coalesce("comp", "rep").alias("part"), "n", *(f"s{i}" for i in range(LONGS)))
    placed = materialize(shared.select("key", "rep").distinct().join(part, "rep").withColumnRenamed("key", "group"), "placed")
    # Two classes have met as first and other. Buckets of the same classes are one.
    many = placed.groupBy("group").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")).where("p < q AND c > 2")
    several = many.groupBy("c", "x", "y").agg(F.min("group").alias("group")).select("group")
    opened = materialize(placed.join(several, "group"), "open")
    met = dealt(opened.select("group", "rep", "part", "n"), SIGNATURE_ROWS).distinct().join(signatures.drop("n"), "rep")
    near = materialize(met.repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(_near(least), "a long, b long").distinct(), "near")
    # The classes that may link across parts, with all they may link to, are a cluster.
    clusters = components(near)
    members = clusters.select(F.col("comp").alias("group"), F.col("node").alias("rep")).join(part.select("rep", "part", "n"), "rep")
    exact = materialize(dealt(members.select("group", "rep", "part", "n"), SET_ROWS, SET_GRAMS).select("tile", "rep").distinct(), "exact")
    links = _with_texts(texts, exact).repartition(parts, "tile").sortWithinPartitions("tile").mapInArrow(_exact(k, percent), "a long, b long")
    names = classes.select("h1", "h2", "rep")
    return signed.select("doc_id", "n", "h1", "h2").join(names, ["h1", "h2"], "left"), materialize(stars.unionAll(links), "links")


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row.

    A document's set: distinct k-word shingles of the text with A-Z lower-cased, the whole
    sequence if it has fewer words. Two documents link when percent of the union is
    shared, at least; component_id is the smallest doc_id that links reach, and kept says
    that it is the row's own. Null text, empty text and text without words have an empty
    set and stand alone, as do rows with a null doc_id, whose component is null and which
    are kept. Rows with one doc_id are one document and give a row each. Texts
    of any length are compared whole, by 64-bit hashes of their shingles. An empty table
    gives none. Other columns are not read.
    """
    signed, links = near_links(docs, k, percent)
    comp = components(links)
    joined = signed.join(comp, signed["rep"] == comp["node"], "left")
    own = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("comp", "rep", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
