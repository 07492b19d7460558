"""N-gram Jaccard join by blocked sparse products of documents and n-grams.

Equal sets are one class. Of each class, a prefix of its n-grams under one global order
goes into the product: long enough that linked classes share a number of prefix entries
that follows from their sizes. N-grams that many documents hold come last in the order.
Overlap counts of classes are accumulated over the columns (n-grams) of each block, and
pairs below the bound of their sizes are discarded. Columns with too many rows to be
multiplied out, and n-grams known to be frequent, only say that their rows belong to one
cluster. Within each cluster the full incidence matrix is multiplied in tiles of bounded
rows, between size classes that can link, which gives exact overlaps; a tile returns a
spanning forest of its links. Of a cluster of many tiles, blocks of rows meet some pivots
first, and what isn't in its largest part then meets all. Components of the links are the
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import (
    ASCII_LOWER,
    Forest,
    chunks,
    components,
    id_filter,
    in_filter,
    list_array,
    materialize,
    mix,
    over_arrow,
    partitions,
    runs,
    shingles,
    text_bytes,
    unique_per_row,
    whole_runs,
    word_hashes,
    word_spans,
)

SHINGLE_WORDS = 4
PERCENT = 85
#: A column with more rows than this makes a cluster instead of pairs.
COLUMN_ROWS = 64
#: N-grams seen so often, by the counts of partitions that saw them twice, come last in the order ...
HOT = 16
#: ... as long as they are so few; else only the more frequent of them (8 bytes each are broadcast).
MAX_HOT = 1_000_000
#: Rows, and n-grams, of a tile's side.
TILE_ROWS, TILE_GRAMS = 256, 400_000
#: Rows of a size class, about, that meet all others of a cluster of several tiles first.
PIVOTS = 16
#: Columns of a dense block within a tile.
BLOCK = 8192


def _sets(text: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, hashes, rows): the distinct shingles of rows i to j, by row and hash."""
    for i, j, data, offsets in chunks(*text_bytes(text)):
        low = ASCII_LOWER[data]
        starts, ends, rows = word_spans(low, offsets)
        yield i, j, *unique_per_row(*shingles(word_hashes(low, starts, ends), rows, j - i, k))


def _slack(n: np.ndarray) -> np.ndarray:
    """By how much the shared prefix entries of linked sets exceed one, at least."""
    return n // 20


def _prefix(n: np.ndarray, percent: int) -> np.ndarray:
    return np.minimum(n, n - -(-percent * n // 100) + 1 + _slack(n))


def _frequent(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """N-grams that several documents of this partition hold, copies of whole sets aside."""
    seen: set[int] = set()
    held: list[np.ndarray] = []

    def out() -> Iterator[pa.RecordBatch]:
        v, n = np.unique(np.concatenate(held), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(v[n > 1].view(np.int64)), pa.array(n[n > 1])], ["gram", "n"])

    for b in batches:
        for i, j, v, rows in _sets(b.column("text"), k):
            whole = np.zeros(j - i, np.uint64)
            np.add.at(whole, rows, mix(v))
            fresh = np.zeros(j - i, bool)
            for r, w in enumerate(whole.tolist()):
                if w not in seen:
                    seen.add(w)
                    fresh[r] = True
            held.append(v[fresh[rows]])
        if sum(map(len, held)) > 4_000_000:
            yield from out()
            held, seen = [], set()
    if held:
        yield from out()


def _hot_grams(docs: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent n-grams by hash, and their place in the order (1 and up, rarer first)."""
    counts = materialize(docs.select("text").mapInArrow(lambda it: _frequent(it, k), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT), "hot")
    least = HOT
    while counts.where(F.col("n") >= least).count() > MAX_HOT:
        least *= 2
    t = counts.where(F.col("n") >= least).toArrow()  # MAX_HOT rows at most
    gram, n = t["gram"].to_numpy().astype(np.int64).view(np.uint64), t["n"].to_numpy().astype(np.int64)
    order = np.argsort(gram)
    gram, n = gram[order], n[order]
    rank = np.empty(len(n), np.int32)
    rank[np.lexsort((gram, n))] = np.arange(1, len(n) + 1)
    return gram, rank


SIGNED = "doc_id long, n long, h1 long, h2 long, cold array<long>, hot array<long>"


def _sign(b: pa.RecordBatch, gram: np.ndarray, rank: np.ndarray, k: int, percent: int) -> Iterator[pa.RecordBatch]:
    for i, j, v, rows in _sets(b.column("text"), k):
        m = j - i
        n = np.bincount(rows, minlength=m)
        whole = []
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            h = np.zeros(m, np.uint64)
            np.add.at(h, rows, mix(v * np.uint64(salt) + np.uint64(1)))
            whole.append(mix(h + n.astype(np.uint64)).view(np.int64))
        place = np.zeros(len(v), np.int32)
        if len(gram) and len(v):
            at = np.minimum(np.searchsorted(gram, v), len(gram) - 1)
            place = np.where(gram[at] == v, rank[at], 0).astype(np.int32)
        order = np.lexsort((v, place, rows))
        first = np.concatenate(([0], np.cumsum(n)))
        keep = np.arange(len(v)) - first[rows] < _prefix(n, percent)[rows]  # rows are sorted either way
        v, place = v[order][keep], place[order][keep]
        at = rows[keep]
        lists = [list_array(v[x].view(np.int64), at[x], m, pa.int64()) for x in (place == 0, place > 0)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, m), pa.array(n, pa.int64()), *map(pa.array, whole), *lists], ["doc_id", "n", "h1", "h2", "cold", "hot"])


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns of two rows or more, as lists under their smallest row; one with too many rows is cut into lists without sizes, each with the smallest row."""
    for cols, starts, ends in whole_runs(batches, "gram"):
        keys, reps, sizes = [], [], []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            order = np.argsort(cols["rep"][s:e])
            r, n = cols["rep"][s:e][order], cols["n"][s:e][order]
            if e - s <= COLUMN_ROWS:
                keys.append(r[0])
                reps.append(r)
                sizes.append(n)
                continue
            for at in range(1, e - s, COLUMN_ROWS):
                part = r[at : at + COLUMN_ROWS]
                keys.append(part[0])
                reps.append(np.concatenate((r[:1], part)))
                sizes.append(part[:0])
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *(list_array(np.concatenate(x), np.repeat(np.arange(len(x)), [len(y) for y in x]), len(x), pa.int64()) for x in (reps, sizes))], ["key", "reps", "sizes"])


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole keys, from batches that come sorted by key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column("key").to_numpy()
        end = int(np.searchsorted(k, k[-1], "left"))
        if end:
            yield pa.Table.from_batches([*held, b.slice(0, end)])
            held = []
        elif held and held[-1].column("key")[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(b.slice(end))
    if held:
        yield pa.Table.from_batches(held)


def _summed(p: np.ndarray) -> np.ndarray:
    """Columns (a, b, na, nb, c), with c summed for equal a and b."""
    p = p[:, np.lexsort((p[1], p[0]))]
    edge = np.flatnonzero(np.concatenate(([True], (p[0, 1:] != p[0, :-1]) | (p[1, 1:] != p[1, :-1]))))
    return np.concatenate((p[:4, edge], [np.add.reduceat(p[4], edge)]))


def _multiply(percent: int):
    """Overlap counts by lists of rows: (a, b, na, nb, c); c is 0 where a and b only share a cluster.

    Pairs that reach their bound among the lists of a key become a spanning forest, and
    pairs within its parts are left out, so copies of one text don't give all their pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_keys(batches):
            reps, sizes = t.column("reps").combine_chunks(), t.column("sizes").combine_chunks()
            rep, n = reps.flatten().to_numpy(), sizes.flatten().to_numpy()
            length, known = reps.value_lengths().to_numpy(), sizes.value_lengths().to_numpy() > 0
            first = np.cumsum(length) - length
            inner = np.cumsum(np.where(known, length, 0)) - np.where(known, length, 0)
            stars, pairs = [], []
            for f, m in zip(first[~known].tolist(), length[~known].tolist(), strict=True):
                stars.append(np.stack((np.full(m - 1, rep[f]), rep[f + 1 : f + m])))
            for m in np.unique(length[known]).tolist():
                at, of = first[known & (length == m)], inner[known & (length == m)]
                x, y = np.triu_indices(m, 1)
                for i in np.array_split(np.arange(len(at)), max(1, len(at) * len(x) // 2_000_000)):
                    a, b = (at[i][:, None] + x).ravel(), (at[i][:, None] + y).ravel()
                    na, nb = n[(of[i][:, None] + x).ravel()], n[(of[i][:, None] + y).ravel()]
                    ok = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (rep[a] != rep[b])
                    if ok.any():
                        pairs.append(_summed(np.stack((rep[a[ok]], rep[b[ok]], na[ok], nb[ok], np.ones(int(ok.sum()), np.int64)))))
            if pairs:
                p = _summed(np.concatenate(pairs, 1))
                sure = p[4] >= np.minimum(np.minimum(1 + p[2] // 20, 1 + p[3] // 20), -(-percent * (p[2] + p[3]) // (100 + percent)))
                if sure.any():
                    nodes, at = np.unique(p[:2], return_inverse=True)
                    at = at.reshape(2, -1)
                    forest = Forest(len(nodes))
                    for x, y in at[:, sure].T.tolist():
                        forest.union(x, y)
                    root = np.array([forest.find(i) for i in range(len(nodes))], np.int64)
                    leaf = np.flatnonzero(root != np.arange(len(nodes)))
                    stars.append(np.stack((nodes[root[leaf]], nodes[leaf])))
                    p = p[:, root[at[0]] != root[at[1]]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in p], ["a", "b", "na", "nb", "c"])
            if stars:
                a, b = np.concatenate(stars, 1)
                zero = pa.array(np.zeros(int((a != b).sum()), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b]), zero, zero, zero], ["a", "b", "na", "nb", "c"])

    return run


def shared_counts(entries: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b, na, nb, c) from entries (gram, rep, n), a < b: partial counts of shared n-grams of rows whose sizes can link; c is 0 where two rows are in one cluster whatever the other counts.

    Columns of an n-gram go to their smallest row, so that those of near copies meet, and
    what is sent doesn't grow with the square of a column.
    """
    parts = partitions(entries.sparkSession)
    columns = entries.repartition(parts, "gram").sortWithinPartitions("gram").mapInArrow(_columns, "key long, reps array<long>, sizes array<long>")
    return columns.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_multiply(percent), "a long, b long, na long, nb long, c long")


def _forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that span the components of a symmetric boolean matrix."""
    todo = np.ones(len(linked), bool)
    for root in range(len(linked)):
        if not todo[root]:
            continue
        todo[root] = False
        front = [root]
        while front:
            x = front.pop()
            new = np.flatnonzero(linked[x] & todo)
            todo[new] = False
            for y in new.tolist():
                yield x, y
            front += new.tolist()


def _tile(v: np.ndarray, rows: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which of the tile's rows link, by the product of the incidence matrix and its transpose."""
    m = len(n)
    _, col, df = np.unique(v, return_inverse=True, return_counts=True)
    number = np.cumsum(df > 1) - 1
    keep = df[col] > 1
    col, rows = number[col[keep]], rows[keep]
    shared = np.zeros((m, m), np.float32)  # exact: counts stay under 2**24
    if len(col):
        order = np.argsort(col, kind="stable")
        col, rows = col[order], rows[order]
        width = min(BLOCK, max(64, 16_000_000 // m))
        for lo in range(0, int(col[-1]) + 1, width):
            s, e = np.searchsorted(col, (lo, lo + width))
            block = np.zeros((m, width), np.float32)
            block[rows[s:e], col[s:e] - lo] = 1
            shared += block @ block.T
    linked = (100 + percent) * shared.astype(np.int64) >= percent * (n[:, None] + n[None, :])
    np.fill_diagonal(linked, False)
    return linked


def _multiply_tiles(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for t in runs(batches, ["tile"]):
            ids = t.column("doc_id").to_numpy()
            sets = list(_sets(t.column("text").combine_chunks(), k))
            v, rows = np.concatenate([s[2] for s in sets]), np.concatenate([s[3] + s[0] for s in sets])
            linked = _tile(v, rows, np.bincount(rows, minlength=len(ids)), percent)
            out += [(int(ids[x]), int(ids[y])) for x, y in _forest(linked)]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return run


def _leveled(members: DataFrame, percent: int) -> DataFrame:
    """members (rep, cluster, n) with s: size classes are powers of 100 / percent, so that only equal and adjacent ones can link."""
    return members.withColumn("s", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9))


def _blocks(leveled: DataFrame, *keys: str) -> DataFrame:
    """Rows, and blocks (nb) that they make, of each of the keys."""
    stats = leveled.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    return stats.withColumn("nb", F.greatest(F.ceil(F.col("rows") / TILE_ROWS), F.ceil(F.col("grams") / TILE_GRAMS)))


def _first_tiles(leveled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rep, tile): small clusters are a tile, of others each block of rows of a size class is one, with some pivots of the classes that can link; and the rows (rep, cluster, n, s) of these others."""
    stats = _blocks(leveled, "cluster", "s")
    total = stats.groupBy("cluster").agg(F.sum("rows").alias("all_rows"), F.sum("grams").alias("all_grams"))
    small = (F.col("all_rows") <= 2 * TILE_ROWS) & (F.col("all_grams") <= 2 * TILE_GRAMS)
    blocks = materialize(stats.join(total, "cluster").select("cluster", "s", "rows", "nb", small.alias("small")), "blocks")
    at = leveled.join(blocks, ["cluster", "s"])
    whole = at.where("small").select("rep", F.xxhash64("cluster").alias("tile"))
    large = at.where("NOT small")
    name = lambda s, i: F.xxhash64("cluster", s, i)
    own = large.select("rep", name(F.col("s"), F.pmod(F.xxhash64("rep"), "nb")).alias("tile"))
    pivots = large.where(F.pmod(F.xxhash64("rep", F.lit(1)), "rows") < PIVOTS).select("rep", "cluster", F.explode(F.array(*(F.col("s") + i for i in (-1, 0, 1)))).alias("s"))
    spread = pivots.join(blocks.select("cluster", "s", "nb"), ["cluster", "s"]).select("rep", "cluster", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("i"))
    return whole.unionAll(own.unionAll(spread.select("rep", name(F.col("s"), F.col("i")).alias("tile"))).distinct()), large.select("rep", "cluster", "n", "s")


def _open_tiles(large: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, tile) of what first tiles leave open: in each cluster, each two blocks whose size classes can link, but for those of two blocks of its largest part."""
    comp = components(links)
    parted = materialize(large.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "cluster", "n", "s", F.coalesce("comp", "rep").alias("part")), "parted")
    largest = parted.groupBy("cluster", "part").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("part", F.struct("n", "part")).alias("most"))
    rows = parted.join(largest, "cluster").withColumn("big", F.col("part") == F.col("most"))
    blocks = materialize(_blocks(rows, "cluster", "s", "big").select("cluster", "s", "big", "nb"), "blocks")
    other = blocks.select("cluster", F.col("s").alias("t"), F.col("big").alias("of"), F.col("nb").alias("count"))
    near = blocks.join(other, "cluster").where((F.abs(F.col("s") - F.col("t")) <= 1) & ~(F.col("big") & F.col("of"))).drop("nb")
    dealt = rows.join(blocks, ["cluster", "s", "big"]).withColumn("i", F.pmod(F.xxhash64("rep"), "nb")).drop("nb")
    pairs = dealt.join(near, ["cluster", "s", "big"]).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)))
    me, you = F.struct("s", "big", "i"), F.struct(F.col("t").alias("s"), F.col("of").alias("big"), F.col("j").alias("i"))
    return pairs.select("rep", F.xxhash64("cluster", F.least(me, you), F.greatest(me, you)).alias("tile"))


def _tile_links(known: DataFrame, tiles: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges (a, b) that span the links within each tile."""
    tiles = materialize(tiles, "tiles")
    some = _only(known.where(F.col("doc_id").isNotNull()), tiles, "rep")
    placed = some.join(tiles, some["doc_id"] == tiles["rep"]).select("tile", "doc_id", "text")
    return materialize(placed.repartition(partitions(known.sparkSession), "tile").sortWithinPartitions("tile").mapInArrow(_multiply_tiles(k, percent), "a long, b long"), "links")


def _only(df: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Rows of df whose doc_id may be among the ids, by a filter that spares a shuffle."""
    words = df.sparkSession.sparkContext.broadcast(id_filter(ids, col))
    return df.mapInArrow(lambda it: (b.filter(pa.array(in_filter(words.value, b.column("doc_id").to_numpy()))) for b in it if b.num_rows), df.schema)


def jaccard_links(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(signed, links): each row's set size, class and smallest doc_id of the class; and edges between classes that span their links."""
    spark = docs.sparkSession
    known = docs.select("doc_id", "text")
    hot = spark.sparkContext.broadcast(_hot_grams(known, k))
    signed = materialize(over_arrow(known, lambda b: _sign(b, *hot.value, k, percent), SIGNED), "signed")
    real = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = materialize(real.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "classes")
    # Prefixes aren't shuffled: rows that the filter lets through and aren't the first of their class are in no cluster's members.
    firsts = _only(real.select("doc_id", "n", "cold", "hot"), classes, "rep").withColumnRenamed("doc_id", "rep")
    counted = shared_counts(firsts.select(F.explode("cold").alias("gram"), "rep", "n"), percent)
    share = counted.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("c").alias("least"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    overlap = F.ceil(percent * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    bound = F.least(1 + F.floor(F.col("na") / 20), 1 + F.floor(F.col("nb") / 20), overlap)
    pairs = share.where((F.col("least") == 0) | (F.col("c") >= bound)).select("a", "b")
    frequent = firsts.select(F.explode("hot").alias("gram"), "rep")
    stars = frequent.join(frequent.groupBy("gram").agg(F.min("rep").alias("a")), "gram").where("a <> rep").select("a", F.col("rep").alias("b")).distinct()
    clusters = components(materialize(pairs.unionAll(stars), "candidates"))
    members = clusters.join(classes.select(F.col("rep").alias("node"), "n"), "node").select(F.col("node").alias("rep"), F.col("comp").alias("cluster"), "n").distinct()
    tiles, large = _first_tiles(materialize(_leveled(members, percent), "members"))
    links = _tile_links(known, tiles, k, percent)
    if not large.isEmpty():
        links = links.unionAll(_tile_links(known, _open_tiles(large, links), k, percent))
    names = classes.select("h1", "h2", "rep")
    return signed.select("doc_id", "n", "h1", "h2").join(names, ["h1", "h2"], "left"), links


def jaccard_components(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row.

    A document's set: distinct k-word shingles of the text with A-Z lower-cased, the
    whole sequence if it has fewer words. Two documents link when percent of the union
    is shared, at least; component_id is the smallest doc_id that links reach. Null
    text, empty text and text without words have an empty set and stand alone, as do
    rows with a null doc_id, whose component is null. Rows with one doc_id and text are
    one document and give a row each. Texts of any length are compared whole, by 64-bit
    hashes of their shingles. An empty table gives none. Other columns are not read.
    """
    signed, links = jaccard_links(docs, k, percent)
    comp = components(links)
    joined = signed.join(comp, signed["rep"] == comp["node"], "left")
    own = F.when(F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.coalesce("comp", "rep", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def keep_one_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is its component's, and those without words or doc_id; all columns stay."""
    gone = jaccard_components(docs, k, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone["__gone"], "left_anti")
