"""Communities of a weighted graph by modularity, on DataFrames.

While a graph has more arcs than a task may hold, levels of parallel moves make it
smaller: in a round each node of one half, dealt by a hash of node and round, weighs the
communities of its neighbours and moves to the best one, so that two nodes don't trade
places for ever; communities become the nodes of the next level. What is left goes
through one task, which moves nodes in turn until none gains, refines communities into
parts that hang together, merges parts and begins anew, until neither moves, merges nor
splits gain. Its result is spread over the nodes, and rounds at the finest level follow
where levels came before it.
"""

from __future__ import annotations

import random
from collections import defaultdict, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.graph import components, written

#: Arcs that one task holds.
LOCAL_ARCS = 1_000_000
#: Gains under this are rounding.
LEAST_GAIN = 1e-10


# --- in one task ------------------------------------------------------------------


class _Graph:
    """Neighbours and weights of each node, and the sum of its arcs' weights with loops."""

    def __init__(self, near: list[dict[int, float]], weight: list[float]) -> None:
        self.near, self.weight, self.total = near, weight, sum(weight)

    def move(self, comm: list[int], resolution: float, order: list[int], within: list[int] | None = None) -> bool:
        """Moves nodes in turn to what raises modularity most, until none gains; only next to nodes of the same `within`, if given."""
        near, weight, total = self.near, self.weight, self.total
        sums = defaultdict(float)
        for v, c in enumerate(comm):
            sums[c] += weight[v]
        free = max(comm, default=0) + 1
        todo, waits, moved = deque(order), [True] * len(comm), False
        while todo:
            v = todo.popleft()
            waits[v] = False
            own, d = comm[v], weight[v]
            to = defaultdict(float)
            for u, w in near[v].items():
                if within is None or within[u] == within[v]:
                    to[comm[u]] += w
            sums[own] -= d
            best, most = own, to[own] - resolution * d * sums[own] / total
            if within is None and most < -LEAST_GAIN * total:
                best, most = free, 0.0  # alone it is better off
            for c, w in to.items():
                gain = w - resolution * d * sums[c] / total
                if gain > most + LEAST_GAIN * total or (c < best and abs(gain - most) <= LEAST_GAIN * total and best != own):
                    best, most = c, gain
            sums[best] += d
            if best != own:
                comm[v], moved = best, True
                free += best == free
                for u in near[v]:
                    if not waits[u] and comm[u] != best:
                        waits[u] = True
                        todo.append(u)
        return moved

    def parts(self, comm: list[int]) -> list[int]:
        """The connected parts of communities."""
        out = [-1] * len(comm)
        n = 0
        for v in range(len(comm)):
            if out[v] < 0:
                out[v] = n
                front = [v]
                while front:
                    x = front.pop()
                    for u in self.near[x]:
                        if out[u] < 0 and comm[u] == comm[x]:
                            out[u] = n
                            front.append(u)
                n += 1
        return out

    def merged(self, part: list[int]) -> _Graph:
        """The graph of parts, which are numbered from 0."""
        n = max(part) + 1
        near: list[dict[int, float]] = [defaultdict(float) for _ in range(n)]
        weight = [0.0] * n
        for v, p in enumerate(part):
            weight[p] += self.weight[v]
            for u, w in self.near[v].items():
                if part[u] != p:
                    near[p][part[u]] += w
        return _Graph(near, weight)


def _numbered(labels: list[int]) -> list[int]:
    names: dict[int, int] = {}
    return [names.setdefault(x, len(names)) for x in labels]


def _settle(graph: _Graph, resolution: float, seed: int) -> list[int]:
    """Communities in which no move of a node, no merge and no split into connected parts gains."""
    rnd = random.Random(seed)

    def shuffled(n: int) -> list[int]:
        order = list(range(n))
        rnd.shuffle(order)
        return order

    comm = list(range(len(graph.near)))
    while True:
        changed = graph.move(comm, resolution, shuffled(len(comm)))
        comm = graph.parts(comm)
        # Levels: parts of communities that hang together are nodes, each first in its community.
        level, at, place = graph, comm, list(range(len(comm)))
        while True:
            refined = list(range(len(at)))
            level.move(refined, resolution, shuffled(len(at)), within=at)
            refined = level.parts(refined)
            if max(refined, default=-1) + 1 == len(refined):  # no two go together
                refined = level.parts(at)
            up = [0] * (max(refined, default=-1) + 1)
            for v, r in enumerate(refined):
                up[r] = at[v]
            level, place = level.merged(refined), [refined[x] for x in place]
            at = _numbered(up)
            level.move(at, resolution, shuffled(len(at)))
            at = level.parts(at)
            if len(set(at)) == len(at):
                break
        now = _numbered([at[x] for x in place])
        if not changed and now == _numbered(comm):
            return now
        before, comm = comm, now
        if _quality(graph, now, resolution) <= _quality(graph, before, resolution) + LEAST_GAIN:
            comm = before
            if not graph.move(comm, resolution, shuffled(len(comm))) and graph.parts(comm) == _numbered(comm):
                return _numbered(comm)


def _quality(graph: _Graph, comm: list[int], resolution: float) -> float:
    sums, inside = defaultdict(float), 0.0
    for v, c in enumerate(comm):
        sums[c] += graph.weight[v]
        inside += graph.weight[v] - sum(w for u, w in graph.near[v].items() if comm[u] != c)
    return inside / graph.total - resolution * sum(x * x for x in sums.values()) / graph.total**2


def _settled(resolution: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[int, int] = {}
        near: list[dict[int, float]] = []
        weight: list[float] = []
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for a, b, w in rows:
            for x in (a, b):
                if x not in names:
                    names[x] = len(near)
                    near.append({})
                    weight.append(0.0)
            weight[names[a]] += w
            if a != b:
                near[names[a]][names[b]] = w
        if rows:
            comm = _settle(_Graph(near, weight), resolution, seed)
            yield pa.RecordBatch.from_arrays([pa.array(list(names), pa.int64()), pa.array(comm, pa.int64())], ["node", "comm"])

    return run


# --- on DataFrames ----------------------------------------------------------------


def modularity(arcs: DataFrame, labels: DataFrame, resolution: float) -> float:
    """Of arcs (a, b, w), both ways, self-loops at double weight, and labels (node, comm)."""
    la, lb = labels.select(F.col("node").alias("a"), F.col("comm").alias("ca")), labels.select(F.col("node").alias("b"), F.col("comm").alias("cb"))
    by = arcs.join(la, "a").join(lb, "b").groupBy("ca").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"), F.sum("w").alias("all"))
    row = by.agg(F.sum("inside").alias("inside"), F.sum(F.col("all") * F.col("all")).alias("squares"), F.sum("all").alias("total")).first()
    return row.inside / row.total - resolution * row.squares / row.total**2 if row.total else 0.0


def _weights(arcs: DataFrame, labels: DataFrame) -> DataFrame:
    """labels (node, comm) with d, the sum of the node's arcs."""
    return labels.join(arcs.groupBy(F.col("a").alias("node")).agg(F.sum("w").alias("d")), "node").select("node", "comm", "d")


def _choices(arcs: DataFrame, labels: DataFrame, total: float, resolution: float) -> DataFrame:
    """(node, comm, score, now, d): what each node gains by being in its own community, in those of its neighbours, and alone (null), of labels (node, comm, d)."""
    sums = labels.groupBy("comm").agg(F.sum("d").alias("weight"))
    near = arcs.where("a <> b").join(labels.select(F.col("node").alias("b"), "comm"), "b").groupBy(F.col("a").alias("node"), "comm").agg(F.sum("w").alias("w"))
    own = labels.select("node", "comm", F.lit(0.0).alias("w"))
    each = near.unionByName(own).groupBy("node", "comm").agg(F.sum("w").alias("w")).join(sums, "comm").join(labels.withColumnRenamed("comm", "now"), "node")
    others = F.col("weight") - F.when(F.col("comm") == F.col("now"), F.col("d")).otherwise(0.0)
    # Rounded, so that equal sums in another order tie.
    return each.select("node", "comm", F.round(F.col("w") - resolution * F.col("d") * others / total, 12).alias("score"), "now", "d")


def gaining(arcs: DataFrame, labels: DataFrame, resolution: float) -> DataFrame:
    """(node, gain): nodes of labels (node, comm) for which going to a neighbour's community, or alone, raises modularity."""
    total = arcs.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()["w"]
    if not total:
        return labels.select("node", F.lit(0.0).alias("gain")).limit(0)
    each = _choices(arcs, _weights(arcs, labels), total, resolution).groupBy("node")
    best = each.agg(F.max(F.when(F.col("comm") == F.col("now"), F.col("score"))).alias("stay"), F.greatest(F.max("score"), F.lit(0.0)).alias("most"))
    return best.select("node", ((F.col("most") - F.col("stay")) * 2 / total).alias("gain")).where(F.col("gain") > 1e-9)


def _half(i: int, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed + i), "node"), F.lit(2)) == 0


def _moved(arcs: DataFrame, labels: DataFrame, total: float, resolution: float, turn: Column) -> DataFrame:
    """Labels (node, comm, d) after the nodes of one turn moved to what raises modularity most; ties go to the smallest community."""
    best = _choices(arcs, labels, total, resolution).groupBy("node").agg(F.min_by("comm", F.struct(-F.col("score"), "comm")).alias("best"), F.first("now").alias("now"), F.first("d").alias("d"))
    return best.select("node", F.when(turn, F.col("best")).otherwise(F.col("now")).alias("comm"), "d")


def _rounds(arcs: DataFrame, labels: DataFrame, total: float, resolution: float, seed: int, few: float, rounds: int) -> DataFrame:
    """labels (node, comm, d) after pairs of rounds, up to the one in which a share of `few`, or less, moved."""
    nodes = labels.count()
    for i in range(rounds):
        turn = _half(2 * i, seed)
        tried = _moved(arcs, _moved(arcs, labels, total, resolution, turn), total, resolution, ~turn)
        now = written(tried.join(labels.select("node", F.col("comm").alias("was")), "node").select("node", "comm", "d", (F.col("comm") != F.col("was")).alias("moved")), "labels")
        labels = now.drop("moved")
        if now.where("moved").count() <= few * nodes:
            break
    return labels


def louvain(edges: DataFrame, resolution: float = 1.0, seed: int = 7, gain: float = 1e-4, few: float = 0.02, rounds: int = 5, levels: int = 20) -> DataFrame:
    """(node, comm) for every end of edges (a, b, score), long; comm is the smallest node of its community.

    Repeated edges add up; null ends, and weights of null or 0, count for nothing. An
    empty graph gives no rows. Communities hang together, and with LOCAL_ARCS arcs or
    fewer no move of one node raises modularity. Larger graphs go through levels of at
    most `rounds` pairs of parallel rounds, until they are as small or a level gains less
    than `gain`. Communities follow from the data and the seed; another implementation's
    seeded result differs, so compare modularity.
    """
    e = edges.where("a IS NOT NULL AND b IS NOT NULL AND score > 0").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), F.col("score").cast("double").alias("w"))
    arcs = fine = written(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w")), "arcs")
    membership = arcs.select(F.col("a").alias("node"), F.col("a").alias("comm")).distinct()
    total = arcs.agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()["w"]
    best = None
    onto = lambda found: written(membership.join(found.select(F.col("node").alias("comm"), F.col("comm").alias("next")), "comm").select("node", F.col("next").alias("comm")), "members")
    for level in range(levels):
        if arcs.count() <= LOCAL_ARCS:
            break
        alone = arcs.select(F.col("a").alias("node"), F.col("a").alias("comm")).distinct()
        best = modularity(arcs, alone, resolution) if best is None else best
        labels = _rounds(arcs, written(_weights(arcs, alone), "labels"), total, resolution, seed + level, few, rounds)
        q = modularity(arcs, labels, resolution)
        if q - best < gain:
            break
        best = q
        membership = onto(labels)
        la, lb = labels.select(F.col("node").alias("a"), F.col("comm").alias("ca")), labels.select(F.col("node").alias("b"), F.col("comm").alias("cb"))
        arcs = written(arcs.join(la, "a").join(lb, "b").groupBy(F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")), "arcs")
    if arcs.count() <= LOCAL_ARCS:
        membership = onto(written(arcs.coalesce(1).mapInArrow(_settled(resolution, seed), "node long, comm long"), "settled"))
    if best is not None:
        polished = _rounds(fine, written(_weights(fine, membership), "labels"), total, resolution, seed - 1, 0.0, 2 * rounds).select("node", "comm")
        if modularity(fine, polished, resolution) > modularity(fine, membership, resolution):
            membership = polished
        # A community that fell apart is several.
        inside = fine.join(membership.select(F.col("node").alias("a"), F.col("comm").alias("x")), "a").join(membership.select(F.col("node").alias("b"), F.col("comm").alias("y")), "b").where("x = y").select("a", "b")
        membership = components(inside).select("node", "comp").join(membership, "node", "right").select("node", F.coalesce("comp", "node").alias("comm"))
    names = membership.groupBy("comm").agg(F.min("node").alias("least"))
    return membership.join(names, "comm").select("node", F.col("least").alias("comm"))


def top_groups(communities: DataFrame, least: int = 8, most: int = 10) -> DataFrame:
    """(node, g): the largest communities of `least` nodes or more are 0, 1, ... below `most`; all other nodes are -1."""
    sizes = communities.groupBy("comm").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    top = sizes.orderBy(F.desc("n"), "comm").limit(most)  # at most `most` rows from here on
    ranked = top.withColumn("g", F.row_number().over(Window.orderBy(F.desc("n"), "comm")) - 1)
    return communities.join(ranked.select("comm", "g"), "comm", "left").select("node", F.coalesce("g", F.lit(-1)).alias("g"))


def group_names(groups: DataFrame, words: DataFrame, most: int = 3) -> DataFrame:
    """(g, name): of each group of (node, g) from 0 on, its words in most songs, then with most occurrences, then first, joined by "・"; words are (node, w, songs, total)."""
    order = Window.partitionBy("g").orderBy(F.desc("songs"), F.desc("total"), "node")
    top = groups.where("g >= 0").join(words, "node").withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= most)
    shown = F.struct("_i", F.element_at(F.split("w", " / "), 1).alias("w"))
    return top.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["w"]), "・").alias("name"))
