"""Line dedup by a segment-partition edit join.

Two lines are near within one edit for each CHARS_PER_EDIT code points of the shorter,
``edits`` at most. Then they share, if one is split into threshold-plus-one even
segments, at least one segment as a substring of the other, at a place that the
difference of the lengths bounds. Every line is indexed by its segments (keyed by
threshold, length, segment number and content) and probes the indexes of its own and the
next smaller lengths with the substrings at those places. Rows of one key meet in a
sorted run. Pairs whose letter counts differ too much for the edits are discarded there;
the rest are verified on the lines themselves by a banded bit-parallel edit distance.

The longer a line, the more one changed word costs of those edits. So the same join is
made on words: two lines are also near within one word's edit for each WORDS_PER_EDIT
words of the shorter, ``word_edits`` at most, whatever white space parts the words. There
segments are runs of words, and counts are those of words.

A line goes if it, or a line near it, stands earlier in the corpus, by doc_id and place;
the first stays. So one near line that stands earlier settles a line: of each run, a line
first meets only the earliest candidates before it, and the next ones in later rounds as
long as none of them was near. The last round takes all that are left. That way a group
of near copies costs a few pairs a line, not all pairs. Blank lines stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import IS_SPACE, chunks, id_bitmap, in_bitmap, materialize, mix, partitions, prefix_hash, span_hash, text_bytes, unused, whole_runs, word_hashes, word_spans

EDITS = 2
#: Code points of a line for each edit.
CHARS_PER_EDIT = 10
#: How many candidates of a run each line meets in each round; the last takes all.
WIDTHS = (2, 16, None)
#: Words of a line for each edit of words.
WORD_EDITS, WORDS_PER_EDIT = 1, 10
#: Bins and bits of a line's letter counts, or word counts.
_BINS, _BITS = 16, 4
#: Runs of so many rows are held against each other by the whole batch, all pairs at once.
_SMALL = 64
#: Rows of a larger run that are held against each other at a time.
_TILE = 1024


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, row and number in the row of each \\n-split line of UTF-8 bytes."""
    breaks = np.flatnonzero(data == 10)
    own = np.searchsorted(offsets, breaks, "right") - 1
    n = np.bincount(own, minlength=len(offsets) - 1) + 1
    rows = np.repeat(np.arange(len(n)), n)
    first = np.concatenate(([0], np.cumsum(n)))
    number = np.arange(len(rows)) - first[rows]
    starts = np.empty(len(rows), np.int64)
    starts[first[:-1]] = offsets[:-1]
    starts[number > 0] = breaks + 1
    ends = np.empty(len(rows), np.int64)
    ends[first[1:] - 1] = offsets[1:]
    inner = np.ones(len(rows), bool)
    inner[first[1:] - 1] = False
    ends[inner] = breaks
    return starts, ends, rows, number


class _Batch:
    """The lines of some rows that one edit or more is allowed, or all that aren't blank, with their hashes as code points."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, short: bool = False) -> None:
        starts, ends, rows, number = _lines(data, offsets)
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        s, e = lead[starts], lead[ends]
        long = e - s >= CHARS_PER_EDIT  # as have all lines of WORDS_PER_EDIT words
        if short:
            black = np.concatenate(([0], np.cumsum(~IS_SPACE[data])))
            long |= black[ends] > black[starts]
        self.bytes, self.offsets, self.byte_start, self.byte_end = data, offsets, starts[long], ends[long]
        self.rows, self.number, self.s, self.e = rows[long], number[long], s[long], e[long]
        self.points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        self.c = prefix_hash(self.points)
        self.n = self.e - self.s
        self.id = mix(span_hash(self.c, self.s, self.e) + self.n.astype(np.uint64)).view(np.int64)


    def split(self) -> None:
        """Hashes of the words, and where each line's begin and end."""
        starts, stops, _ = word_spans(self.bytes, self.offsets)
        self.words = word_hashes(self.bytes, starts, stops)
        self.cw = prefix_hash(self.words)
        self.ws, self.we = np.searchsorted(starts, self.byte_start), np.searchsorted(starts, self.byte_end)

    def counts(self, some: np.ndarray, words: bool) -> np.ndarray:
        """Letters, or words, by bin of the lines `some`, packed; every count is modulo 2**_BITS."""
        first, n = (self.ws[some], (self.we - self.ws)[some]) if words else (self.s[some], self.n[some])
        ends = np.cumsum(n)
        line = np.repeat(np.arange(len(some), dtype=np.int32), n)
        at = np.arange(ends[-1] if len(n) else 0) + np.repeat(first - ends + n, n)
        kind = (self.words[at] >> np.uint64(65 - _BINS.bit_length())).astype(np.uint32) if words else (self.points[at] * np.uint32(0x9E3779B1)) >> np.uint32(33 - _BINS.bit_length())
        c = np.bincount(line * _BINS + kind, minlength=len(some) * _BINS).reshape(-1, _BINS) & ((1 << _BITS) - 1)
        return (c.astype(np.uint64) << (np.arange(_BINS, dtype=np.uint64) * np.uint64(_BITS))).sum(1, dtype=np.uint64).view(np.int64)


def _keys(c: np.ndarray, s: np.ndarray, n: np.ndarray, line: np.ndarray, edits: int, per_edit: int, most: int, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(key, line, probes) under a threshold of `edits` for lines of n units from s on, of which c has prefix hashes; the shorter line of a pair has up to `most` units. Keys end in `kind`."""
    least = edits * per_edit
    some = (n >= least) & (n <= most + edits)
    s, n, line = s[some], n[some], line[some]

    def key(start: np.ndarray, end: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
        h = mix(span_hash(c, start, end) + (length * (edits + 1) + i).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return (h & ~np.uint64(15) | np.uint64(kind)).view(np.int64)

    def segment(length: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of segment i: the last ones are one longer where it isn't even."""
        short, longer = length // (edits + 1), length % (edits + 1)
        from_here = edits + 1 - longer
        return i * short + np.maximum(0, i - from_here), short + (i >= from_here)

    for i in range(edits + 1):
        at, size = segment(n, i)
        own = n <= most
        yield key(s + at, s + at + size, n, i)[own], line[own], False
        for gap in range(edits + 1):
            length = n - gap
            at, size = segment(length, i)
            # Shifts that some split of the edits to the left and right of the segment allows.
            low = max(-i, gap - (edits - i))
            high = min(i, gap + (edits - i))
            for shift in range(low, high + 1):
                if gap == shift == 0:
                    continue  # that is the segment itself: segments of one key meet too
                start = at + shift
                able = (length >= least) & (length <= most) & (start >= 0) & (start + size <= n)
                yield key((s + start)[able], (s + start + size)[able], length[able], i), line[able], True


def _all_keys(b: _Batch, edits: int, some: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool, np.ndarray]]:
    """(key, line, probes, counts) of the lines `some`; the last four bits of a key are twice its edits, and one more where they are of words."""
    b.split()
    for words, c, s, n, edits_, per_edit in ((False, b.c, b.s, b.n, edits, CHARS_PER_EDIT), (True, b.cw, b.ws, b.we - b.ws, WORD_EDITS, WORDS_PER_EDIT)):
        able = some[n[some] >= per_edit]
        counts = np.zeros(len(b.id), np.int64)
        counts[able] = b.counts(able, words)
        for e in range(1, edits_ + 1):
            most = (e + 1) * per_edit - 1 if e < edits_ else 1 << 40
            for key, line, probes in _keys(c, s[able], n[able], able, e, per_edit, most, 2 * e + words):
                yield key, line, probes, counts[line]


ENTRY = "key long, id long, counts long, doc long"


def _entries(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, docs = np.zeros(0, np.int64), np.zeros(0, np.int64)  # lines that were sent, by id, with the doc
        for x in batches:
            ids = x.column("doc_id").to_numpy(zero_copy_only=False)
            for i, _, data, offsets in chunks(*text_bytes(x.column("text"))):
                b = _Batch(data, offsets)
                doc = ids[i + b.rows]
                order = np.lexsort((doc, b.id))
                some = order[np.concatenate(([True], b.id[order][1:] != b.id[order][:-1]))[: len(order)]]  # the least doc of each line
                new, at = b.id[some], np.searchsorted(seen, b.id[some])
                known = seen[np.minimum(at, len(seen) - 1)] == new if len(seen) else np.zeros(len(new), bool)
                less = known.copy()
                less[known] = docs[at[known]] > doc[some[known]]
                docs[at[less]] = doc[some[less]]
                seen, docs = np.insert(seen, at[~known], new[~known]), np.insert(docs, at[~known], doc[some[~known]])
                some = some[~known | less]  # without copies nearby
                if len(seen) > 1_000_000:
                    seen, docs = seen[:0], docs[:0]
                for key, line, probes, bits in _all_keys(b, edits, some):
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(b.id[line] & ~np.int64(1) | np.int64(probes)), pa.array(bits), pa.array(doc[line])], ["key", "id", "counts", "doc"])

    return run


def _near(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Whether counts differ by 2 * edits at most, for each of a and of b."""
    gap = np.zeros((len(a), len(b)), np.uint8)
    for k in range(_BINS):
        shift = np.uint64(k * _BITS)
        x, y = ((v.view(np.uint64) >> shift).astype(np.uint8) & 15 for v in (a, b))
        d = (x[:, None] - y[None, :]) & 15
        gap += np.minimum(d, 16 - d)
    return gap <= 2 * edits


class _Rows:
    """Some rows of a run, by doc and line."""

    def __init__(self, line: np.ndarray, counts: np.ndarray, doc: np.ndarray) -> None:
        order = np.lexsort((line, doc))
        self.line, self.counts, self.doc = line[order], counts[order], doc[order]


def _earlier(x: _Rows, y: _Rows, alike, width: int | None) -> tuple[list[np.ndarray], np.ndarray]:
    """Pairs (line of x, line of y) of each x with the first `width` y of its doc or an earlier one that are alike; and which lines of x may have more."""
    found, more = [], []
    for i in range(0, len(x.line), _TILE):
        rows = np.arange(i, min(i + _TILE, len(x.line)))
        have = np.zeros(len(rows), np.int64)
        for j in range(0, len(y.line), _TILE):
            if not len(rows) or y.doc[j] > x.doc[rows[-1]]:
                break
            part = slice(j, j + _TILE)
            ok = alike(x.counts[rows], y.counts[part]) & (y.doc[part][None, :] <= x.doc[rows][:, None]) & (y.line[part][None, :] != x.line[rows][:, None])
            if width is not None:
                count = np.cumsum(ok, 1) + have[:, None]
                over = count[:, -1] > width
                ok &= count <= width
                more.append(x.line[rows[over]])
                have = count[:, -1]
            r, c = np.nonzero(ok)
            if len(r):
                found.append(np.stack((x.line[rows[r]], y.line[part][c])))
            if width is not None:
                rows, have = rows[~over], have[~over]
    return found, np.concatenate(more) if more else np.zeros(0, np.int64)


def _of_small_runs(cols: dict[str, np.ndarray], starts: np.ndarray, size: np.ndarray) -> Iterator[np.ndarray]:
    """All pairs of lines in runs of few rows that are alike."""
    entry, counts, kind = cols["id"], cols["counts"].view(np.uint64), cols["key"] & 15
    for length in np.unique(size).tolist():
        x, y = np.triu_indices(length, 1)
        at = starts[size == length]
        for part in np.array_split(at, max(1, len(at) * len(x) // 1_000_000)):
            a, b = (part[:, None] + x).ravel(), (part[:, None] + y).ravel()
            e, f = entry[a], entry[b]
            ok = e & f & 1 == 0  # not two probes
            ok &= e | 1 != f | 1
            if "open" in cols:
                ok &= cols["open"][a] | cols["open"][b]
            a, b = a[ok], b[ok]
            gap, most = np.zeros(len(a), np.uint8), kind[a] & 14
            for k in range(_BINS):
                if k % 4 == 0 and k:  # most pairs differ too much by now
                    ok = gap <= most
                    a, b, gap, most = a[ok], b[ok], gap[ok], most[ok]
                shift = np.uint64(k * _BITS)
                d = ((counts[a] >> shift) - (counts[b] >> shift)).astype(np.uint8) & 15
                gap += np.minimum(d, 16 - d)
            ok = gap <= most
            if ok.any():
                e, f = entry[a[ok]] & ~np.int64(1), entry[b[ok]] & ~np.int64(1)
                yield np.stack((np.minimum(e, f), np.maximum(e, f)))


CANDIDATE = "a long, b long, key long, counts long, doc long, more boolean"


def _candidates(edits: int, width: int | None):
    """Pairs (a, b) without a key, and, of large runs that some lines have more candidates in, the rows: a is the entry's id, more whether its line is such a one.

    Rows that come with `open` are of such runs; then only lines with open rows meet others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols, starts, ends in whole_runs(batches, "key"):
            size = ends - starts
            small = size <= _SMALL
            found, rest = list(_of_small_runs(cols, starts[small], size[small])), []
            for s, e in zip(starts[~small].tolist(), ends[~small].tolist(), strict=True):
                line = cols["id"][s:e]
                if line.min() | 1 == line.max() | 1:
                    continue
                order = np.lexsort((cols["doc"][s:e], line))
                at = order[np.concatenate(([True], line[order][1:] != line[order][:-1]))] + s  # of copies, the least doc
                entry, counts, doc = cols["id"][at], cols["counts"][at], cols["doc"][at]
                wants = cols["open"][at] if "open" in cols else np.ones(len(at), bool)
                line, probes, kind = entry & ~np.int64(1), (entry & 1) == 1, int(cols["key"][s]) & 15
                pick = lambda on: _Rows(line[on], counts[on], doc[on])  # noqa: B023, E731
                alike = lambda a, b, k=kind // 2: _near(a, b, k)
                more = []
                for x, y in ((probes, ~probes), (~probes, np.ones(len(line), bool))):
                    if y.any() and (x & wants).any():
                        pairs, left = _earlier(pick(x & wants), pick(y), alike, width)
                        found += pairs
                        more.append(left)
                more = np.concatenate(more) if more else line[:0]
                if len(more):
                    rest.append((entry, np.full(len(entry), cols["key"][s]), counts, doc, np.isin(line, more)))
            if found:
                pairs = np.unique(np.concatenate(found, 1), axis=1)
                none = pa.nulls(pairs.shape[1], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1]), none, none, none, none.cast(pa.bool_())], ["a", "b", "key", "counts", "doc", "more"])
            if rest:
                entry, key, counts, doc, more = (np.concatenate(c) for c in zip(*rest, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(entry), pa.nulls(len(entry), pa.int64()), pa.array(key), pa.array(counts), pa.array(doc), pa.array(more)], ["a", "b", "key", "counts", "doc", "more"])

    return run


def within(a: np.ndarray, b: np.ndarray, edits: int) -> bool:
    """Whether the edit distance of two arrays of code points is `edits` at most.

    Only the 2 * edits + 1 diagonals of the band are looked at. Each is a bit vector of
    matches, and a run of matches is followed by one operation on it.
    """
    gap = len(b) - len(a)
    if abs(gap) > edits:
        return False
    match = {}
    for d in range(-edits, edits + 1):  # bit i: a[i] == b[i + d]
        lo, hi = max(0, -d), min(len(a), len(b) - d)
        bits = np.packbits(a[lo:hi] == b[lo + d : hi + d], bitorder="little").tobytes() if hi > lo else b""
        match[d] = int.from_bytes(bits, "little") << lo
    far: dict[int, int] = {}
    for e in range(edits + 1):
        now = {}
        for d in range(-e, e + 1):
            if e == 0:
                i = 0
            else:
                i = max(far.get(d, -2) + 1, far.get(d - 1, -1), far.get(d + 1, -2) + 1)
                i = min(i, len(a), len(b) - d)
            if i < 0 or i + d < 0:
                continue
            x = match[d] >> i
            now[d] = i + (x ^ (x + 1)).bit_length() - 1
            if d == gap and now[d] >= len(a):
                return True
        far = now
    return False


def near(a: bytes, b: bytes, edits: int = EDITS) -> bool:
    """Whether two lines, as UTF-8, are near by code points or by words."""
    x, y = (np.frombuffer(t.decode("utf-8").encode("utf-32-le"), np.uint32) for t in (a, b))
    if within(x, y, min(edits, min(len(x), len(y)) // CHARS_PER_EDIT)):
        return True
    names: dict[bytes, int] = {}
    v, w = (np.array([names.setdefault(t, len(names)) for t in line.split()], np.int64) for line in (a, b))
    least = min(len(v), len(w))
    return least >= WORDS_PER_EDIT and within(v, w, min(WORD_EDITS, least // WORDS_PER_EDIT))


def _texts(bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for _, _, data, offsets in chunks(*text_bytes(x.column("text"))):
                b = _Batch(data, offsets)
                line = b.id & ~np.int64(1)
                _, some = np.unique(b.id, return_index=True)
                some = some[in_bitmap(bitmap.value, line[some])]
                texts = [data[b.byte_start[i] : b.byte_end[i]].tobytes() for i in some]
                yield pa.RecordBatch.from_arrays([pa.array(line[some]), pa.array(b.id[some]), pa.array(texts, pa.binary())], ["id", "whole", "line"])

    return run


def _verify(edits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = pa.array([near(a, b, edits) for a, b in zip(x.column("x").to_pylist(), x.column("y").to_pylist(), strict=True)], pa.bool_())
            yield x.select(["a", "b"]).filter(ok)

    return run


def _occurrences(short: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids = x.column("doc_id").to_numpy(zero_copy_only=False)
            for i, _, data, offsets in chunks(*text_bytes(x.column("text"))):
                b = _Batch(data, offsets, short)
                yield pa.RecordBatch.from_arrays([pa.array(b.id), pa.array(ids[i + b.rows], pa.int64()), pa.array(b.number, pa.int64())], ["id", "doc", "line"])

    return run


def _among(ids: Broadcast):
    """Rows whose id may be among those of a bitmap, but for the last bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(in_bitmap(ids.value, b.column("id").to_numpy() & ~np.int64(1))))

    return run


def _firsts(places: DataFrame) -> DataFrame:
    """(id, first, n) of every line: its first place and the number of places."""
    return places.groupBy("id").agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n"))


def near_lines(docs: DataFrame, places: DataFrame, edits: int = EDITS) -> tuple[DataFrame, DataFrame]:
    """(links, firsts): (a, b), ids of different lines that are near, of each line that has near lines before it one of them at least; and _firsts() of all lines in links, at least."""
    spark = docs.sparkSession
    parts = partitions(spark)
    text = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    entries = text.mapInArrow(_entries(edits), ENTRY)
    meet = lambda rows, width: materialize(rows.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_candidates(edits, width), CANDIDATE), "line-pairs")
    found = meet(entries, WIDTHS[0])
    runs = found.where("key IS NOT NULL").select("key", F.col("a").alias("id"), "counts", "doc", "more")
    # Ids lose their last bit in the join; lines that share the rest are all verified.
    line = F.expr("shiftleft(shiftright(id, 1), 1)")
    needed = found.where("key IS NULL").select(F.explode(F.array("a", "b")).alias("id")).unionAll(runs.select(line.alias("id")))
    bitmap = spark.sparkContext.broadcast(id_bitmap(needed, "id"))
    lines = text.select("text").mapInArrow(_texts(bitmap), "id long, whole long, line binary").groupBy("whole").agg(F.first("id").alias("id"), F.first("line").alias("line"))
    lines = materialize(lines.join(needed.distinct(), "id", "left_semi"), "line-texts")
    x = lines.select(F.col("id").alias("ia"), F.col("whole").alias("wa"), F.col("line").alias("x"))
    y = lines.select(F.col("id").alias("ib"), F.col("whole").alias("wb"), F.col("line").alias("y"))
    first = materialize(_firsts(places.mapInArrow(_among(bitmap), places.schema)), "line-firsts")
    links = None
    for width in WIDTHS[1:]:
        pairs = found.where("key IS NULL").select("a", "b").distinct()
        both = pairs.join(x, pairs["a"] == x["ia"]).join(y, pairs["b"] == y["ib"]).select(F.col("wa").alias("a"), F.col("wb").alias("b"), "x", "y")
        near = materialize(both.mapInArrow(_verify(edits), "a long, b long"), "line-links")
        links = near if links is None else links.unionAll(near)
        if not runs.where("more").head(1):
            return links, first
        # Lines with a near line before them need no more candidates.
        ends = links.join(first.select(F.col("id").alias("a"), F.col("first").alias("fa")), "a").join(first.select(F.col("id").alias("b"), F.col("first").alias("fb")), "b")
        settled = ends.select(F.when(F.col("fa") > F.col("fb"), F.col("a")).otherwise(F.col("b")).alias("id")).select(line.alias("settled")).distinct()
        left = runs.where("more").select("key", line.alias("line")).distinct().join(settled, F.col("line") == F.col("settled"), "left_anti")
        left = materialize(left.withColumnRenamed("key", "open_key"), "line-open")
        # Of the runs with such lines, all rows.
        keyed = runs.withColumn("line", line).join(left.select("open_key").distinct(), F.col("key") == F.col("open_key"), "left_semi")
        marked = keyed.join(left, (F.col("key") == F.col("open_key")) & (keyed["line"] == left["line"]), "left").select("key", "id", "counts", "doc", F.col("open_key").isNotNull().alias("open"))
        found = meet(marked, width)
        runs = found.where("key IS NOT NULL").select("key", F.col("a").alias("id"), "counts", "doc", "more")
    pairs = found.where("key IS NULL").select("a", "b").distinct()
    both = pairs.join(x, pairs["a"] == x["ia"]).join(y, pairs["b"] == y["ib"]).select(F.col("wa").alias("a"), F.col("wb").alias("b"), "x", "y")
    return links.unionAll(materialize(both.mapInArrow(_verify(edits), "a long, b long"), "line-links")), first


def removed_lines(docs: DataFrame, edits: int = EDITS, short_copies: bool = True) -> DataFrame:
    """(doc_id, lines): the numbers of the lines that go from each document that loses any."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    places = materialize(known.mapInArrow(_occurrences(short_copies), "id long, doc long, line long"), "line-places")
    links, few = near_lines(known, places, edits)
    place = F.struct("doc", "line")
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(few.select(F.col("id").alias("b"), "first"), "b").groupBy(F.col("a").alias("id")).agg(F.min("first").alias("near"))
    bound = _firsts(places).join(near, "id", "left").where("n > 1 OR near IS NOT NULL").select("id", F.least("first", F.coalesce("near", "first")).alias("keep"))
    bound = materialize(bound, "line-bound")
    some = docs.sparkSession.sparkContext.broadcast(id_bitmap(bound.select(F.expr("shiftleft(shiftright(id, 1), 1)").alias("id")), "id"))
    gone = places.mapInArrow(_among(some), places.schema).join(bound, "id").where(place > F.col("keep"))
    return materialize(gone.groupBy(F.col("doc").alias("doc_id")).agg(F.sort_array(F.collect_set("line")).alias("lines")), "line-gone")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Takes from each text the lines that the last column numbers."""
    for x in batches:
        at = x.schema.get_field_index("text")
        text, gone = x.column(at).to_pylist(), x.column(x.num_columns - 1).to_pylist()
        for i, lines in enumerate(gone):
            if lines:
                drop = set(lines)
                text[i] = "\n".join(t for n, t in enumerate(text[i].split("\n")) if n not in drop)
        yield x.set_column(at, x.schema.field(at), pa.array(text, x.column(at).type))


def dedup_lines(docs: DataFrame, edits: int = EDITS, short_copies: bool = True) -> DataFrame:
    """docs without later near copies of lines, and a last column, __lines: the numbers of those that went.

    Lines are split at \\n. Copies of any line that isn't blank go, without short_copies only
    of those of CHARS_PER_EDIT code points or more, and near lines as said above. Rows with
    a null doc_id or text stay as they are. Rows that repeat a doc_id and text
    count as the same place, so none loses lines to the other. Lines of any length are
    compared whole. A text that loses all its lines becomes empty. An empty table stays
    empty, and other columns are handed on; if one is called __lines, the last is __lines_.
    """
    doc, lines = unused(docs, "__doc"), unused(docs, "__lines")
    gone = removed_lines(docs, edits, short_copies).select(F.col("doc_id").alias(doc), F.col("lines").alias(lines))
    wide = docs.join(gone.hint("shuffle_hash"), docs["doc_id"] == gone[doc], "left").drop(doc)
    return wide.mapInArrow(_without, wide.schema)


def line_digest(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """(doc_id, n_removed, removed, kept_sha256): how many lines went, which, and the SHA-256 of what stays."""
    out = dedup_lines(docs.select("doc_id", "text"), edits)
    n = F.coalesce(F.size("__lines"), F.lit(0)).cast("long")
    return out.select("doc_id", F.when(F.col("__lines").isNull(), F.lit(0)).otherwise(n).cast("long").alias("n_removed"), F.coalesce(F.array_join("__lines", ","), F.lit("")).alias("removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
