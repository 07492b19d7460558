"""Benchmark decontamination: short test items inside long documents.

Containment search with size-partitioned MinHash sketches. The items are partitioned by
their number of shingles; an item's sketch is the bottom of its own shingles under a
hash order, as long as its partition's size asks for: floor((1 - t) * size) + 1 values,
so that a document which contains a share t of the item must hold one of them (by
counting, not by chance). Documents are partitioned by size too: an item is looked for
only in documents with room for t of its shingles. Candidates are then verified by
exact containment of the shingles' words.

Items go to executors in slices of at most ``SLICE_SHINGLES`` shingles; a larger
benchmark takes more passes over the documents, never a larger broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import IS_SPACE, chunks, over_arrow, shingles, text_bytes, unique_per_row, word_hashes, word_spans

SHINGLE_WORDS = 5
CONTAINMENT_PERCENT = 80
#: 16 bytes each on the driver and in the broadcast.
SLICE_SHINGLES = 2_000_000
SCHEMA = "doc_id long, item_id long, n_item_shingles long, n_shared long"

#: Case and ASCII punctuation don't count: all but letters, digits and bytes over 0x7F part words.
_PARTS = IS_SPACE.copy()
_PARTS[[i for i in range(128) if not chr(i).isalnum()]] = True


def _shingled(text: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, tuple]]:
    """For rows i to j: shingles' hashes and rows, words in each row, and what spells them."""
    for i, j, data, offsets in chunks(*text_bytes(pc.utf8_lower(text.cast(pa.large_string())))):
        starts, ends, rows = word_spans(data, offsets, _PARTS)
        h = word_hashes(data, starts, ends)
        out, at = shingles(h, rows, j - i, k)
        yield i, j, out, at, np.bincount(rows, minlength=j - i), (data, starts, ends, rows)


class _Index:
    """The sketches and shingles of one slice of the items."""

    def __init__(self, items: list[tuple[int | None, str]], percent: int) -> None:
        ids = [i for i, _ in items]
        texts = pa.array([t for _, t in items], pa.large_string())
        n_words = np.concatenate([n for *_, n, _ in _shingled(texts, SHINGLE_WORDS)] or [np.zeros(0, np.int64)])
        self.by_length = {}
        for k in sorted({int(min(n, SHINGLE_WORDS)) for n in n_words if n}):
            values, owners = [], []
            for i, _, h, at, n, _ in _shingled(texts, k):
                h, at = unique_per_row(h, at)
                mine = (n[at] >= k) if k == SHINGLE_WORDS else n[at] == k
                values.append(h[mine])
                owners.append(at[mine] + i)
            h, at = np.concatenate(values), np.concatenate(owners)  # by item, then hash
            sizes = np.bincount(at, minlength=len(ids))
            first = np.concatenate(([0], np.cumsum(sizes)))
            need = -(-percent * sizes // 100)
            keep = np.arange(len(h)) - first[at] < sizes[at] - need[at] + 1  # the bottom of each item
            order = np.argsort(h[keep], kind="stable")
            # Partitions of like size: an item of the partition needs least[p] shingles of a document at least.
            part = np.where(sizes > 0, np.ceil(np.log2(np.maximum(sizes, 1))).astype(int), -1)
            sketches = []
            for p in sorted(set(part[part >= 0].tolist())):
                mine = part[at[keep][order]] == p
                sketches.append((int(need[part == p].min()), h[keep][order][mine], at[keep][order][mine]))
            self.by_length[k] = (ids, h, first, sizes, need, sketches)
        self.texts, self.ids = texts, ids

    def words(self, item: int, k: int) -> set[bytes]:
        if not hasattr(self, "spelled"):
            self.spelled = {}
        if (item, k) not in self.spelled:
            (_, _, _, _, _, (data, starts, ends, _)), *_ = _shingled(self.texts.slice(item, 1), k)
            w = [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
            self.spelled[item, k] = {b" ".join(w[x : x + k]) for x in range(len(w) - k + 1)}
        return self.spelled[item, k]


def _matches(text: pa.Array, index: _Index) -> list[tuple[int, int, int, int]]:
    """(row, item's place, its shingles, shared ones) of every text that contains an item, by row and item."""
    found: list[tuple[int, int, int, int]] = []
    for k, (_, _, _, sizes, need, sketches) in index.by_length.items():
        for i, j, h, at, n_words, (data, starts, ends, _) in _shingled(text, k):
            room = np.maximum(n_words - k + 1, 0)  # at least as many as distinct shingles
            pairs = set()
            for least, values, owners in sketches:
                able = room[at] >= least
                x, rows = h[able], at[able]
                lo, hi = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
                for s in np.flatnonzero(hi > lo):
                    pairs.update((int(rows[s]), int(o)) for o in owners[lo[s] : hi[s]])
            spelled: dict[int, set[bytes]] = {}
            first = np.concatenate(([0], np.cumsum(n_words)))
            for row, item in sorted(pairs):
                if row not in spelled:
                    w = [data[s:e].tobytes() for s, e in zip(starts[first[row] : first[row + 1]], ends[first[row] : first[row + 1]], strict=True)]
                    spelled = {row: {b" ".join(w[x : x + k]) for x in range(len(w) - k + 1)}}
                shared = len(index.words(item, k) & spelled[row])
                if shared >= need[item]:
                    found.append((i + row, item, int(sizes[item]), shared))
    return sorted(found)


def _search(b: pa.RecordBatch, index: _Index) -> Iterator[pa.RecordBatch]:
    if found := _matches(b.column("text"), index):
        at, items, *rest = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at)), pa.array([index.ids[x] for x in items], pa.int64()), *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "item_id", "n_item_shingles", "n_shared"])


def _slices(benchmark: DataFrame, percent: int) -> Iterator[Broadcast]:
    """The items, indexed and broadcast in slices of bounded size; one slice at least."""
    spark = benchmark.sparkSession
    held: list[tuple[int | None, str]] = []
    size, sent = 0, False
    for row in benchmark.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        held.append((row.item_id, row.text))
        size += len(row.text) // 2 + 1
        if size > SLICE_SHINGLES:
            yield spark.sparkContext.broadcast(_Index(held, percent))
            held, size, sent = [], 0, True
    if held or not sent:
        yield spark.sparkContext.broadcast(_Index(held, percent))


def contained_items(docs: DataFrame, benchmark: DataFrame, percent: int = CONTAINMENT_PERCENT) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared): documents with percent of an item's distinct shingles, or more.

    Shingles are five words of the lower-cased text, without ASCII punctuation; an item
    of fewer words is one shingle of all its words. Items without words, and null or
    empty texts on either side, are in no pair; null ids are handed on. Repeated items and
    repeated documents each give their own rows. An empty table gives none. No column but
    the two ids and texts is read, so that clashing names don't matter.
    """
    found = [over_arrow(docs.select("doc_id", "text"), lambda b, shared=shared: _search(b, shared.value), SCHEMA) for shared in _slices(benchmark, percent)]
    return reduce(DataFrame.unionAll, found)


def decontaminate(docs: DataFrame, benchmark: DataFrame, percent: int = CONTAINMENT_PERCENT) -> DataFrame:
    """The rows of docs whose text contains no item, judged row by row, whatever their doc_id; all columns stay as they are.

    Null and empty texts stay, repeated rows go or stay alike, an empty table of either
    kind takes nothing away.
    """
    schema = docs.schema
    for shared in _slices(benchmark, percent):

        def clean(b: pa.RecordBatch, shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            keep = np.ones(b.num_rows, bool)
            keep[[row for row, *_ in _matches(b.column("text"), shared.value)]] = False
            yield b.filter(pa.array(keep))

        docs = over_arrow(docs, clean, schema)
    return docs
