"""Suffix-array dedup: every byte that a repeated 400-byte string covers, and passages of words that documents share.

Strings that are equal must meet in one shard. Each 400-byte string is dealt by its
anchor, the least hash among its 32-byte windows (leftmost of equals): equal strings
have equal anchors at equal places. The starts that follow one another with one anchor
in one part of their strings make a piece, their strings' bytes, dealt by the bytes
around the anchor that all of them hold. Pieces whose key the corpus has once are
unique. Where all pieces of a key are the same bytes, all their starts repeat. The
other keys' different pieces, one copy of each, go to shards whose suffix arrays are
built by induced sorting: suffixes are classified, leftmost-smaller substrings sorted and
named, the shorter string of names sorted in turn, and the array induced from it in
linear passes over buckets. Common prefixes of neighbours, permuted to text order, then
say which starts repeat. A key with more different pieces than a shard may hold is
settled by counting 128-bit hashes of its strings instead.

The same goes for strings of 50 words, of which many are shorter than 400 bytes: a word
counts as one unit, whatever white space is around it, and is spelled by a few bytes of
its hash in the suffix arrays. Such a string counts where another document has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BASES, chunks, id_filter, in_filter, materialize, mix, partitions, prefix_hash, runs, span_hash, text_bytes, word_hashes, word_spans


@dataclass(frozen=True)
class Unit:
    """What strings are made of, and when they repeat."""

    length: int  # of a string, in units
    anchor: int  # of a window
    parts: int  # strings make separate pieces by the part of them that the anchor starts in
    width: int = 1  # bytes that spell a unit
    words: bool = False  # units are words, and only another document's string counts

    @property
    def span(self) -> int:
        """Places of the anchor."""
        return self.length - self.anchor + 1

    @property
    def step(self) -> int:
        return -(-self.span // self.parts)


BYTES = Unit(400, 32, 4)
WORDS = Unit(50, 4, 2, width=3, words=True)
LENGTH = BYTES.length
#: Bytes of a shard's pieces; a key with more is counted by hashes.
SHARD_BYTES = 1 << 20
#: No UTF-8 text has this byte.
SEPARATOR = 0xFF


# --- suffix arrays ----------------------------------------------------------------


def _types(t: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than the next one; the last one is the least."""
    n = len(t)
    small = np.ones(n, bool)
    differs = np.flatnonzero(t[:-1] != t[1:])
    at = np.searchsorted(differs, np.arange(n - 1))  # the next place that differs from its successor
    small[:-1] = (t[:-1] < t[1:])[differs[at]]
    return small


def _spread(sa: np.ndarray, t: np.ndarray, j: np.ndarray, free: np.ndarray, step: int) -> None:
    """Puts suffixes j, in order, at the free ends of their buckets, which move by step."""
    c = t[j]
    order = np.argsort(c, kind="stable")
    c, j = c[order], j[order]
    first = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    rank = np.arange(len(c)) - np.repeat(first, np.diff(np.concatenate((first, [len(c)]))))
    sa[free[c] + step * rank] = j
    free[c[first]] += step * np.diff(np.concatenate((first, [len(c)])))


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The order of all suffixes that follows from that of the leftmost-smaller ones.

    Each bucket is taken in waves: what is in it induces what goes to later buckets, and
    to itself, at once.
    """
    n, k = len(t), len(counts)
    ends = np.cumsum(counts)
    heads = ends - counts
    sa = np.full(n, -1, np.int64)
    tails = ends - 1
    _spread(sa, t, lms[::-1], tails, -1)
    seeds = tails.copy()  # seeds of bucket c: seeds[c] + 1 to ends[c]
    used = np.flatnonzero(counts)
    free = heads.copy()
    for c in used:
        done = heads[c]
        while done < free[c]:
            j, done = sa[done : free[c]], free[c]
            j = j[j > 0] - 1
            j = j[~small[j]]
            if len(j):
                _spread(sa, t, j, free, 1)
        j = sa[seeds[c] + 1 : ends[c]]
        j = j[j > 0] - 1
        j = j[~small[j]]
        if len(j):
            _spread(sa, t, j, free, 1)
    free = ends - 1
    for c in used[::-1]:
        done = ends[c] - 1
        while done > free[c]:
            j, done = sa[free[c] + 1 : done + 1][::-1], free[c]
            j = j[j > 0] - 1
            j = j[small[j]]
            if len(j):
                _spread(sa, t, j, free, -1)
        larger = sa[heads[c] : free[c] + 1]
        j = larger[(larger >= 0)][::-1]
        j = j[~small[j]]
        j = j[j > 0] - 1
        j = j[small[j]]
        if len(j):
            _spread(sa, t, j, free, -1)
    if small[n - 1]:
        sa[heads[t[n - 1]]] = n - 1  # the end is the least of its bucket
    return sa


def _rank(names: np.ndarray) -> np.ndarray:
    """Suffix array of a string over many names, by doubling what is compared; only ties are sorted again."""
    n = len(names)
    order = np.argsort(names, kind="stable")
    new = np.concatenate(([True], names[order][1:] != names[order][:-1]))
    first = np.flatnonzero(new)[np.cumsum(new) - 1]  # where the ties of each place begin
    rank = np.empty(n, np.int64)
    rank[order] = first
    k = 1
    tied = np.flatnonzero(np.bincount(first, minlength=n)[first] > 1)
    while len(tied):
        i, start = order[tied], first[tied]
        after = np.where(i + k < n, rank[np.minimum(i + k, n - 1)], -1)
        by = np.lexsort((after, start))
        i, after = i[by], after[by]  # starts are sorted, and stay so
        new = np.concatenate(([True], (start[1:] != start[:-1]) | (after[1:] != after[:-1])))
        begin = tied[np.flatnonzero(new)[np.cumsum(new) - 1]]
        order[tied], first[tied], rank[i] = i, begin, begin
        tied = tied[np.bincount(begin, minlength=n)[begin] > 1]
        k *= 2
    return order


#: A string over more letters than this has too many buckets for passes over them.
_MOST_LETTERS = 4096


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Start of every suffix of t in order; t is of small whole numbers and ends with its only 0."""
    n = len(t)
    if n <= 2:
        return np.arange(n)[::-1].copy()
    if t.max() >= _MOST_LETTERS:
        return _rank(t)
    small = _types(t)
    counts = np.bincount(t)
    is_lms = small.copy()
    is_lms[0] = False
    is_lms[1:] &= ~small[:-1]
    lms = np.flatnonzero(is_lms)
    sa = _induce(t, small, lms, counts)
    ordered = sa[is_lms[sa]]  # by their substrings
    # Neighbours with equal substrings, up to and with the next leftmost-smaller suffix, share a name.
    size = np.full(n, 1, np.int64)
    size[lms[:-1]] = np.diff(lms) + 1
    a, b = ordered[:-1], ordered[1:]
    same = size[a] == size[b]
    alive = np.flatnonzero(same)
    i = 0
    while len(alive):
        ok = t[a[alive] + i] == t[b[alive] + i]
        same[alive[~ok]] = False
        i += 1
        alive = alive[ok]
        alive = alive[size[a[alive]] > i]
    name = np.empty(n, np.int64)
    name[ordered] = np.concatenate(([0], np.cumsum(~same)))
    names = name[lms]
    if names.max() + 1 < len(lms):
        order = suffix_array(names)
    else:
        order = np.argsort(names)
    return _induce(t, small, lms[order], counts)


def repeated_starts(data: np.ndarray, length: int = LENGTH, owner: np.ndarray | None = None) -> np.ndarray:
    """Starts of strings of `length` bytes, none with SEPARATOR, that data has again elsewhere; with owner, at a place of another owner."""
    n = len(data)
    if n <= length:
        return np.zeros(n, bool)
    t = np.zeros(n + 1, np.int64)
    t[:-1] = data.astype(np.int64) + 1
    sa = suffix_array(t)[1:]
    before = np.full(n, -1, np.int64)  # the neighbour before each suffix, in text order
    before[sa[1:]] = sa[:-1]
    # Common prefixes with that neighbour, up to `length`, by words of 8 bytes and a rest.
    room = np.zeros(n + length + 8, np.uint8)
    room[:n] = data
    room[n:] = SEPARATOR
    word = np.lib.stride_tricks.sliding_window_view(room, 8)
    alive = np.flatnonzero((before >= 0) & (np.maximum(before, np.arange(n)) + length <= n))
    for at in (*range(0, length - 7, 8), *([length - 8] if length % 8 else [])):
        if not len(alive):
            break
        alive = alive[(word[alive + at] == word[before[alive] + at]).all(1)]
    out = np.zeros(n, bool)
    out[alive] = True
    if owner is None:
        out[before[alive]] = True
    else:
        # Neighbours with equal strings are a group; it counts if it has two owners.
        first = np.flatnonzero(~out[sa])
        mine = owner[sa]
        two = np.minimum.reduceat(mine, first) < np.maximum.reduceat(mine, first)
        out[sa] = np.repeat(two, np.diff(np.append(first, n)))
    cuts = np.concatenate(([0], np.cumsum(data == SEPARATOR)))
    whole = np.zeros(n, bool)
    whole[: n - length + 1] = cuts[length:] == cuts[: n - length + 1]
    return out & whole


# --- pieces -----------------------------------------------------------------------


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w values that follow one another."""
    n = len(x)
    pad = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[:n] = x
    rows = pad.reshape(-1, w)
    left = np.minimum.accumulate(rows, 1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


PLACE = "h long, p1 long, p2 long, doc long, row long, l long, more long"


def _word_units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and where each row's begin."""
    starts, ends, rows = word_spans(data, offsets)
    return word_hashes(data, starts, ends), np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(offsets) - 1))))


def _pieces(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    length, anchor_size, span, step = unit.length, unit.anchor, unit.span, unit.step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, row = (b.column(c).to_numpy() for c in ("doc", "row"))
            for i, _, data, offsets in chunks(*text_bytes(b.column("text"))):
                if unit.words:
                    data, offsets = _word_units(data, offsets)
                if len(data) < length:
                    continue
                c = prefix_hash(data)
                at = np.arange(len(data) - anchor_size + 1)
                gram = mix(span_hash(c, at, at + anchor_size))
                key = gram & np.uint64(0xFFFFFFFF00000000) | at.astype(np.uint64)
                anchor = (_least(key, span) & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of each start
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
                valid = np.arange(len(anchor)) + length <= offsets[1:][owner]
                starts = np.flatnonzero(valid)
                if not len(starts):
                    continue
                new = np.ones(len(starts), bool)
                part = (anchor[starts] - starts) // step  # the part of its string that the anchor starts in
                new[1:] = (anchor[starts[1:]] != anchor[starts[:-1]]) | (owner[starts[1:]] != owner[starts[:-1]]) | (part[1:] != part[:-1])
                l = starts[new]
                r = starts[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(starts) - 1]))]
                p = anchor[l]
                shape = (p - l).astype(np.uint64) * np.uint64(1 << 20) + (r - l).astype(np.uint64)
                h2 = prefix_hash(data, BASES[1])
                own = owner[l]
                part = (p - l) // step
                # All strings with the anchor in this part hold these units.
                h = mix(span_hash(c, p - part * step, p - np.minimum((part + 1) * step, span) + 1 + length) + part.astype(np.uint64))
                cols = (h.view(np.int64), mix(span_hash(c, l, r + length) + shape).view(np.int64), mix(span_hash(h2, l, r + length, BASES[1]) ^ shape).view(np.int64), doc[i + own], row[i + own], l - offsets[own], r - l)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["h", "p1", "p2", "doc", "row", "l", "more"])

    return run


def _spelled(text: str, unit: Unit) -> bytes:
    """The text with unit.width bytes for each unit, none of them SEPARATOR."""
    data = text.encode()
    if not unit.words:
        return data
    h, _ = _word_units(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    return np.stack([h // np.uint64(SEPARATOR**i) % np.uint64(SEPARATOR) for i in range(unit.width)], 1).astype(np.uint8).tobytes()


PIECE = "shard long, h long, p1 long, p2 long, doc long, many boolean, data binary"


def _cut(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Bytes of the pieces that each document is to give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, want in zip(b.column("text").to_pylist(), b.column("want").to_pylist(), strict=True):
                data = _spelled(t, unit)
                rows += [(s["shard"], s["h"], s["p1"], s["p2"], s["doc"], s["many"], data[s["l"] * unit.width : (s["l"] + s["more"] + unit.length) * unit.width]) for s in want]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["shard", "h", "p1", "p2", "doc", "many", "data"])

    return run


FOUND = "h long, p1 long, p2 long, starts array<struct<a:long,z:long>>"
_FOUND = pa.schema([("h", pa.int64()), ("p1", pa.int64()), ("p2", pa.int64()), ("starts", pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())])))])


def _ranges(flags: np.ndarray) -> list[dict[str, int]]:
    """First and last of each run of set flags."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return [{"a": int(a), "z": int(z) - 1} for a, z in zip(edge[::2], edge[1::2], strict=True)]


def _shards(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    length = unit.length * unit.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["shard"]):
            pieces = t.column("data").to_pylist()
            data = np.frombuffer(bytes([SEPARATOR]).join(pieces), np.uint8)
            many = t.column("many").to_pylist()
            owner = None
            if unit.words:
                # A piece that several documents have makes what equals it repeat, so it is an owner of its own.
                size = np.array([len(p) + 1 for p in pieces])
                docs = np.unique(t.column("doc").to_numpy(), return_inverse=True)[1]
                owner = np.repeat(np.where(many, len(pieces) + np.arange(len(pieces)), docs), size)[: len(data)]
            again = repeated_starts(data, length, owner)
            rows, at = [], 0
            for h, p1, p2, all_, piece in zip(*(t.column(c).to_pylist() for c in ("h", "p1", "p2")), many, pieces, strict=True):
                own = again[at : at + len(piece) - length + 1 : unit.width]
                if all_:
                    own = np.ones(len(own), bool)
                if own.any():
                    rows.append({"h": h, "p1": p1, "p2": p2, "starts": _ranges(own)})
                at += len(piece) + 1
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _FOUND)

    return run


def _strings(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Hashes of all strings of the pieces."""
    length = unit.length * unit.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, p1, p2, doc, many, piece in zip(*(b.column(c).to_pylist() for c in ("h", "p1", "p2", "doc", "many", "data")), strict=True):
                data = np.frombuffer(piece, np.uint8)
                s = np.arange(0, len(data) - length + 1, unit.width)
                f1, f2 = (mix(span_hash(prefix_hash(data, base), s, s + length, base)).view(np.int64) for base in BASES)
                same = [pa.array(np.full(len(s), x), k) for x, k in ((h, pa.int64()), (p1, pa.int64()), (p2, pa.int64()), (doc, pa.int64()), (many, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([pa.array(f1), pa.array(f2), *same, pa.array(s // unit.width)], ["f1", "f2", "h", "p1", "p2", "doc", "many", "s"])

    return run


def repeated_ranges(docs: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """(doc, row, ranges): ranges (start, end), in units, of each document that repeated strings cover, from docs (doc, row, text)."""
    spark = docs.sparkSession
    parts = partitions(spark)
    #: Whether copies of one piece make its strings repeat.
    several = F.min("doc") != F.max("doc") if unit.words else F.count("*") > 1
    places = materialize(docs.mapInArrow(_pieces(unit), PLACE), "places")
    anchors = places.groupBy("h").agg(several.alias("several"), F.min("p1").alias("a1"), F.max("p1").alias("z1"), F.min("p2").alias("a2"), F.max("p2").alias("z2")).where("several")
    anchors = materialize(anchors.select("h", F.expr("a1 = z1 AND a2 = z2").alias("same")), "anchors")
    some = spark.sparkContext.broadcast(id_filter(anchors, "h"))
    likely = places.mapInArrow(lambda it: (b.filter(pa.array(in_filter(some.value, b.column("h").to_numpy()))) for b in it if b.num_rows), places.schema)
    shared = materialize(likely.join(anchors, "h"), "shared")
    mixed = shared.where("NOT same")
    kinds = mixed.groupBy("h", "p1", "p2").agg(several.alias("many"), F.min(F.struct("doc", "row", "l", "more")).alias("at"))
    kinds = materialize(kinds.select("h", "p1", "p2", "many", "at.*"), "kinds")
    size = kinds.groupBy("h").agg(F.sum((F.col("more") + unit.length) * unit.width + 1).alias("bytes"))
    total = size.where(F.col("bytes") <= SHARD_BYTES).agg(F.sum("bytes")).first()[0] or 0
    shards = 1 + 2 * total // SHARD_BYTES
    dealt = kinds.join(size, "h").withColumn("shard", F.when(F.col("bytes") <= SHARD_BYTES, F.pmod(F.xxhash64("h"), F.lit(shards))).otherwise(F.lit(-1)))
    wanted = materialize(dealt.groupBy("doc", "row").agg(F.collect_list(F.struct("shard", "h", "p1", "p2", "doc", "many", "l", "more")).alias("want")), "wanted")
    texts = _only(docs, wanted).join(wanted.hint("shuffle_hash"), ["doc", "row"]).select("text", "want")
    pieces = materialize(texts.mapInArrow(_cut(unit), PIECE), "pieces")
    sharded = pieces.where("shard >= 0").repartition(max(parts, int(shards)), "shard").sortWithinPartitions("shard").mapInArrow(_shards(unit), FOUND)
    strings = pieces.where("shard < 0").repartition(parts).mapInArrow(_strings(unit), "f1 long, f2 long, h long, p1 long, p2 long, doc long, many boolean, s long")
    strings = materialize(strings, "strings")
    twice = strings.groupBy("f1", "f2").agg((F.bool_or("many") | several).alias("again")).where("again").drop("again")
    hot = strings.join(twice, ["f1", "f2"]).groupBy("h", "p1", "p2").agg(F.collect_list(F.struct(F.col("s").alias("a"), F.col("s").alias("z"))).alias("starts"))
    found = materialize(sharded.unionAll(hot), "found")
    covered = mixed.join(found, ["h", "p1", "p2"]).select("doc", "row", F.explode("starts").alias("s"), "l").select("doc", "row", (F.col("l") + F.col("s.a")).alias("s"), (F.col("l") + F.col("s.z") + unit.length).alias("e"))
    plain = shared.where("same").select("doc", "row", F.col("l").alias("s"), (F.col("l") + F.col("more") + unit.length).alias("e"))
    return materialize(covered.unionAll(plain).groupBy("doc", "row").agg(F.collect_set(F.struct("s", "e")).alias("ranges")), "ranges")


def _only(docs: DataFrame, rows: DataFrame, inside: bool = True) -> DataFrame:
    """Rows of docs that may be, or surely aren't, among `rows`; it spares shuffles of texts."""
    some = docs.sparkSession.sparkContext.broadcast(id_filter(rows, "row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(in_filter(some.value, b.column("row").to_numpy()) == inside))

    return docs.mapInArrow(run, docs.schema)


def _joined(ranges: list[dict[str, int]] | None) -> list[tuple[int, int]]:
    """Maximal runs (start, end) of what the ranges cover."""
    out: list[tuple[int, int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in ranges or ()):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ranges = b.column("ranges").to_pylist() if "ranges" in b.schema.names else [None] * b.num_rows
        counts, digests = [], []
        for text, gone in zip(b.column("text").to_pylist(), ranges, strict=True):
            data = (text or "").encode()
            spans = _joined(gone)
            kept = [data[s:e] for s, e in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(data)], strict=True)]
            counts.append((len(data), sum(e - s for s, e in spans), len(spans)))
            digests.append(hashlib.sha256(b"".join(kept)).hexdigest())
        n = [pa.array(x, pa.int64()) for x in zip(*counts, strict=True)] or [pa.array([], pa.int64())] * 3
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *n, pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        runs_ = [_joined(r) for r in b.column("ranges").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(r) for r in runs_], pa.int64()), pa.array([sum(e - s for s, e in r) for r in runs_], pa.int64())], ["doc_id", "n_passages", "n_passage_words"])


def _named(docs: DataFrame) -> DataFrame:
    """Rows with a name of their own; rows with equal doc_id and text share one, as each is the other's copy."""
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(-1)).cast("long").alias("doc"), F.xxhash64("doc_id", "text").alias("row"))


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for every row of docs.

    Null text counts as empty. A byte goes if a 400-byte string that covers it starts
    anywhere else too, in this document or another; overlaps count, all is judged on the
    input, and no string crosses documents. Texts are processed whole. Rows with equal
    doc_id and text lose the same bytes, as each is the other's copy. Texts under 400
    bytes lose none. An empty table gives none. Other columns are not read.
    """
    named = _named(docs)
    ranges = repeated_ranges(named.where(F.octet_length("text") >= BYTES.length).select("doc", "row", "text"))
    hit = _only(named, ranges).join(ranges.hint("shuffle_hash"), ["doc", "row"], "left").select("doc_id", "text", "ranges")
    rest = _only(named, ranges, inside=False).select("doc_id", "text")
    return hit.mapInArrow(_remove, SCHEMA).unionAll(rest.mapInArrow(_remove, SCHEMA))


def shared_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, n_passages, n_passage_words) for every row of docs.

    Passages are the maximal runs of words that strings of 50 words cover which another
    document (by doc_id) has too, whatever white space parts the words. Words that differ
    count as equal with a chance of one in 255**3. Rows without any, among them null and
    short texts, have 0. Rows with equal doc_id and text count as one document. An empty
    table gives none. Other columns are not read.
    """
    named = _named(docs)
    ranges = repeated_ranges(named.where(F.octet_length("text") >= 2 * WORDS.length - 1).select("doc", "row", "text"), WORDS)
    return named.select("doc_id", "doc", "row").join(ranges, ["doc", "row"], "left").select("doc_id", "ranges").mapInArrow(_count, "doc_id long, n_passages long, n_passage_words long")
