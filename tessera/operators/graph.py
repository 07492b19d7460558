"""Co-occurrence graphs: pairs in a line, weights, top-k edges, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.sources.mart import shared_dir


#: A line with more words is cut into blocks of about BLOCK_WORDS, and each two blocks are a task's.
HOT_WORDS, BLOCK_WORDS = 1000, 500
#: Pairs that a task makes of other lines, about; it sums those of a kind in memory.
TASK_PAIRS = 500_000
#: Rows of items that a task holds to find what repeats, about.
TASK_ROWS = 500_000


def line_pairs(items: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(line, a, b), a < b, of every two words of distinct (line, w).

    Words of a line of more than HOT_WORDS are dealt into blocks by a hash, and meet in
    the triangle of pairs of blocks: its pairs are spread over as many keys. Other lines
    are dealt into as many parts as their pairs ask for, so a task's pairs don't grow with
    the table. nodes (w), if given, are the only words that count.
    """
    return _pairs(items if nodes is None else items.join(nodes.select("w"), "w", "left_semi"))[0]


def _parts(df: DataFrame, rows: int, size: int) -> int:
    """Tasks that hold about `size` rows each, one for each core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, rows // size + 1)


def _pairs(d: DataFrame) -> tuple[DataFrame, int]:
    """line_pairs of distinct (line, w), and how many there are."""
    held = Observation()
    d = written(d.select("line", "w").observe(held, F.count("*").alias("rows")), "words")
    seen, n = Observation(), F.col("n")
    # Dealt by their number before they are counted: a split of the table holds more lines the larger it is.
    sizes = d.select("line").repartition(_parts(d, held.get["rows"], TASK_ROWS), "line").groupBy("line").agg(F.count("*").alias("n"))
    every = n * (n - 1) / 2
    sizes = sizes.observe(seen, F.sum(F.when(n <= HOT_WORDS, every)).alias("pairs"), F.sum(every).alias("all"))
    hot = written(sizes.where(n > HOT_WORDS).select("line", F.ceil(n / BLOCK_WORDS).alias("blocks")), "hot")
    parts = _parts(d, int(seen.get["pairs"] or 0), TASK_PAIRS)
    cold = d.repartition(parts, "line").join(hot, "line", "left_anti")
    few = cold.alias("x").join(cold.alias("y"), (F.col("x.line") == F.col("y.line")) & (F.col("x.w") < F.col("y.w"))).select("x.line", F.col("x.w").alias("a"), F.col("y.w").alias("b"))
    placed = d.join(hot, "line").withColumn("i", F.pmod(F.xxhash64("w"), "blocks"))
    each = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("i", j).alias("p"), F.greatest("i", j).alias("q")))
    tiled = placed.select("line", "w", "i", F.explode(each).alias("t")).select("line", "w", "i", "t.p", "t.q")
    # The number is given, as small inputs would be put together, and what comes of them is large.
    tiled = tiled.repartition(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), "line", "p", "q")
    x, y = tiled.alias("x"), tiled.alias("y")
    same = (F.col("x.line") == F.col("y.line")) & (F.col("x.p") == F.col("y.p")) & (F.col("x.q") == F.col("y.q"))
    # Two words of one block meet in its own tile only.
    once = (F.least("x.i", "y.i") == F.col("x.p")) & (F.greatest("x.i", "y.i") == F.col("x.q"))
    many = x.join(y, same & once & (F.col("x.w") < F.col("y.w"))).select("x.line", F.col("x.w").alias("a"), F.col("y.w").alias("b"))
    return few.unionAll(many), int(seen.get["all"] or 0)


def cooccurrence(items: DataFrame, line: str, word: str, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(edges, nodes) of distinct (line, word): pairs of words with how many lines hold both, from `least` on; words with their lines.

    Words of fewer than `least` lines are in no pair, and go before pairs are made. Rows
    with a null line or word are no items. Pairs are dealt by their number before they are
    counted, so that a task's don't grow with the table; a pair has no more rows than the
    rarer word has lines, and where two words have more than TASK_PAIRS, pairs are counted by
    parts of the lines first.
    """
    d = items.select(F.col(line).alias("line"), F.col(word).alias("w")).where("line IS NOT NULL AND w IS NOT NULL")
    d = d.repartition(_parts(d, items.count(), TASK_ROWS), "line", "w").distinct()
    nodes = written(d.groupBy("w").agg(F.count("*").alias("lines")), "nodes")
    pairs, total = _pairs(d.join(nodes.where(F.col("lines") >= least).select("w"), "w", "left_semi"))
    parts = _parts(d, total, 2 * TASK_PAIRS)
    edges = pairs.select("a", "b", F.lit(1).cast("long").alias("n"))
    if nodes.where(F.col("lines") > TASK_PAIRS).count() > 1:
        edges = pairs.withColumn("_part", F.pmod(F.xxhash64("line"), F.lit(parts))).repartition(parts, "a", "b", "_part").groupBy("a", "b", "_part").agg(F.count("*").alias("n"))
    edges = edges.repartition(parts, "a", "b").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return edges.where(F.col("n") >= least), nodes


def references(edges: DataFrame, items: DataFrame, lines: DataFrame, order: list[str], most: int = 20) -> DataFrame:
    """(a, b, n, refs) of edges (a, b), a < b: how many lines hold both words of items (line, w), and the first lines.

    lines are (line, song, text, ...) with the columns of `order`; those of one song with
    equal text are one reference, its first line by order, and how often it comes. refs
    is an array of (line, times), by order, of `most` references. An edge meets the lines
    of its rarer word, of which those stay that hold the other one, and what repeats is
    one row before edges are grouped.
    """
    kept = written(edges.select("a", "b").where("a < b").distinct(), "edges")
    ends = kept.select(F.col("a").alias("w")).unionAll(kept.select(F.col("b").alias("w"))).distinct()
    d = written(items.select("line", "w").where("line IS NOT NULL AND w IS NOT NULL").join(ends, "w", "left_semi").distinct(), "words")
    count = d.groupBy("w").agg(F.count("*").alias("n"))
    both = kept.join(count.select(F.col("w").alias("a"), F.col("n").alias("na")), "a").join(count.select(F.col("w").alias("b"), F.col("n").alias("nb")), "b")
    few = F.col("na") <= F.col("nb")
    rare = both.select("a", "b", F.when(few, F.col("a")).otherwise(F.col("b")).alias("w"), F.when(few, F.col("b")).otherwise(F.col("a")).alias("other"))
    pairs = rare.join(d, "w").join(d.withColumnRenamed("w", "other"), ["line", "other"], "left_semi").select("line", "a", "b")
    place = F.struct(*order, "line")
    once = pairs.join(lines, "line").groupBy("a", "b", "song", "text").agg(F.min(place).alias("at"), F.count("*").alias("times"))
    first = Window.partitionBy("a", "b").orderBy("at")
    top = once.withColumn("i", F.row_number().over(first)).where(F.col("i") <= most).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("i", "at.line", "times"))).alias("refs"))
    n = once.groupBy("a", "b").agg(F.sum("times").alias("n"))
    return n.join(top, ["a", "b"]).select("a", "b", "n", F.transform("refs", lambda r: F.struct(r["line"].alias("line"), r["times"].alias("times"))).alias("refs"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, near): each node's neighbours (other, score), the heaviest first, then the smallest."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"), "score").unionAll(edges.select(F.col("b").alias("node"), F.col("a").alias("other"), "score"))
    sorted_ = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("m"), "other")))
    return both.groupBy("node").agg(F.transform(sorted_, lambda x: F.struct(x["other"].alias("other"), (-x["m"]).alias("score"))).alias("near"))


def song_rows(lines: DataFrame, words: DataFrame, song: str, idx: str, text: list[str], word: str) -> DataFrame:
    """(song, rows): each song's lines in turn, as (idx, the text columns, words): the sorted distinct words of (song, idx, word), empty without any."""
    found = words.select(song, idx, word).where(F.col(word).isNotNull()).distinct().groupBy(song, idx).agg(F.array_sort(F.collect_set(word)).alias("_w"))
    row = F.struct(idx, *text, F.coalesce("_w", F.array().cast(found.schema["_w"].dataType)).alias("words"))
    return lines.select(song, idx, *text).join(found, [song, idx], "left").groupBy(song).agg(F.array_sort(F.collect_list(row)).alias("rows"))


def weighted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with score n / sqrt(lines of a * lines of b)."""
    a, b = nodes.select(F.col("w").alias("a"), F.col("lines").alias("la")), nodes.select(F.col("w").alias("b"), F.col("lines").alias("lb"))
    return edges.join(a, "a").join(b, "b").withColumn("score", F.col("n") / F.sqrt(F.col("la").cast("double") * F.col("lb")))


def top_edges(edges: DataFrame, k: int = 6) -> DataFrame:
    """Edges that are among the k best of either end, by score and then the other end's id, both descending."""
    both = edges.select("a", "b", "score", F.col("a").alias("me"), F.col("b").alias("you")).unionByName(edges.select("a", "b", "score", F.col("b").alias("me"), F.col("a").alias("you")))
    w = Window.partitionBy("me").orderBy(F.desc("score"), F.desc("you"))
    return both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= k).select("a", "b", "score").distinct()


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written to the shared folder and read back: its lineage ends here, and a lost executor costs a read."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Edges that one task joins to components.
LOCAL_EDGES = 1_000_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (least node, node) of the components among LOCAL_EDGES edges at a time; nodes alone come with themselves."""
    up: dict = {}
    seen, kind = 0, None

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def out() -> pa.RecordBatch:
        nodes = list(up)
        return pa.RecordBatch.from_arrays([pa.array([root(x) for x in nodes], kind), pa.array(nodes, kind)], ["a", "b"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = root(up.setdefault(a, a)), root(up.setdefault(b, b))
            up[max(x, y)] = min(x, y)
        seen += batch.num_rows
        if seen > LOCAL_EDGES:
            yield out()
            up, seen = {}, 0
    if up:
        yield out()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, comp): the smallest node that edges (a, b) reach.

    Each partition's edges become stars about the least nodes, which no round needs to
    find again. LOCAL_EDGES of these, or fewer, are joined in one task; else labels spread,
    and jump to their labels' labels, until none changes. A written table is one step of
    two spreads and jumps. Edges with a null end count for nothing.
    """
    e = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL")
    schema = e.withColumn("b", F.col("b").cast(e.schema["a"].dataType)).schema
    thin = written(e.mapInArrow(_stars, schema).distinct(), "stars")
    if thin.count() <= LOCAL_EDGES:
        return written(thin.coalesce(1).mapInArrow(_stars, schema).select(F.col("b").alias("node"), F.col("a").alias("comp")), "components")
    both = written(thin.union(thin.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "both")
    labels = both.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct()

    def step(labels: DataFrame) -> DataFrame:
        spread = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        lower = labels.join(spread, "node").select("node", F.least("comp", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("comp").alias("far"))
        return lower.join(jump, "low").select("node", F.least("low", "far").alias("comp"))

    for _ in range(rounds):
        new = step(step(labels)).join(labels.select("node", F.col("comp").alias("was")), "node")
        new = written(new.select("node", "comp", (F.col("comp") != F.col("was")).alias("moved")), "spread")
        labels = new.select("node", "comp")
        if new.where("moved").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
