"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted, one over the target (documents
labelled good) and one over the whole raw corpus. A document's log importance weight is
the sum of log(p / q) over its n-grams, for two families: words without case and ASCII
punctuation, where ratios within chance count as 1, and raw words with pairs of adjacent
ones. As the raw corpus is mostly good itself, each family's p is tilted by a constant an
n-gram, placed where held-out good documents hardly ever weigh less than nothing. The
lesser of the two weights is the document's, in nats. Standard Gumbel noise from the
row's key is added, and the k documents with the largest sums are kept: a sample without
replacement by weight, where k is the number of weights at or over 0 in this very corpus.
Documents whose weight is far from the last place's stay or go for sure, short ones and
odd ones by chance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tessera.llm.common import IS_SPACE, chunks, materialize, mix, over_arrow, text_bytes, unused, word_hashes, word_spans

_PARTS = IS_SPACE.copy()
_PARTS[[i for i in range(128) if not chr(i).isalnum()]] = True


@dataclass(frozen=True)
class Settings:
    bits: int = 18  # words have 2**bits buckets, raw words and pairs as many each; the models' size is fixed by this alone
    max_labelled: int = 200_000  # labelled rows used at most, least hashes of doc_id first; they are broadcast
    chance: float = 4.0  # a word's ratio counts from so many standard deviations
    prior: float = 0.5  # added to the target's counts, and to those that the raw model expects
    extra: int = 50  # n-grams of ratio 1 that every document is taken to have besides: short ones are judged less by their few
    good_below: float = 0.005  # share of held-out good documents under a family's zero
    seed: int = 9


def _features(text: pa.Array, bits: int) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]]:
    """For rows i to j: buckets and rows of the words, and of the raw words and their pairs (in two halves of the buckets)."""
    shift = np.uint64(64 - bits)
    for i, j, data, offsets in chunks(*text_bytes(text)):
        row_text = text.slice(i, j - i)
        low, low_offsets = text_bytes(pc.utf8_lower(row_text.cast(pa.large_string())))
        s, e, rows = word_spans(low, low_offsets, _PARTS)
        words = ((word_hashes(low, s, e) >> shift).astype(np.int64), rows)
        s, e, rows = word_spans(data, offsets)
        h = word_hashes(data, s, e)
        same = rows[1:] == rows[:-1]
        two = (mix(h[:-1] * np.uint64(3) + h[1:])[same] >> shift).astype(np.int64)
        grams = (np.concatenate(((h >> shift).astype(np.int64), two + (1 << bits))), np.concatenate((rows, rows[:-1][same])))
        yield i, j, words, grams


def _count(batches: Iterator[pa.RecordBatch], target: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """Counts of a whole partition: (family and bucket, raw, target), without zeros."""
    size = 1 << bits
    raw, good = np.zeros(3 * size, np.int64), np.zeros(3 * size, np.int64)
    for b in batches:
        is_target = np.isin(b.column("doc_id").to_numpy(zero_copy_only=False), target)
        for i, _, *families in _features(b.column("text"), bits):
            for k, (at, rows) in enumerate(families):
                own = slice(k * size, (1 + 2 * k) * size)
                raw[own] += np.bincount(at, minlength=own.stop - own.start)
                if (mine := is_target[i + rows]).any():
                    good[own] += np.bincount(at[mine], minlength=own.stop - own.start)
    for part in np.array_split(np.flatnonzero(raw), 8):
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(raw[part]), pa.array(good[part])], ["at", "raw", "good"])


def _score(text: pa.Array, weights: list[np.ndarray], settings: Settings) -> np.ndarray:
    """Each document's mean log ratio in both families, with the extra n-grams, and its numbers of n-grams with them; NaN without words."""
    out = np.full((len(text), 4), np.nan)
    for i, j, *families in _features(text, settings.bits):
        for k, (at, rows) in enumerate(families):
            n = np.bincount(rows, minlength=j - i)
            out[i:j, 2 + k] = np.where(n > 0, n + settings.extra, np.nan)
            out[i:j, k] = np.bincount(rows, weights[k][at], minlength=j - i) / out[i:j, 2 + k]
    return out


_PARTS_OF = ("words", "grams", "n_words", "n_grams")


@dataclass
class Model:
    weights: Broadcast
    zeros: tuple[float, float]
    settings: Settings

    def key(self, doc_id: Column, means: list[Column], sizes: list[Column]) -> tuple[Column, Column]:
        """(weight, weight with noise); without words both are null."""
        w = F.least(*((x - z) * n for x, n, z in zip(means, sizes, self.zeros, strict=True)))
        u = (F.pmod(F.xxhash64(F.lit(self.settings.seed), doc_id), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        return w, w - F.log(-F.log(u))


def _scores(docs: DataFrame, weights: Broadcast, settings: Settings) -> DataFrame:
    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = _score(b.column("text"), weights.value, settings)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(s[:, k], from_pandas=True) for k in range(4))], ["doc_id", *_PARTS_OF])

    return over_arrow(docs.select("doc_id", "text"), run, "doc_id long, " + ", ".join(f"{c} double" for c in _PARTS_OF))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> tuple[Model, DataFrame]:
    """The model, and the table (doc_id, words, grams, n_words, n_grams) of every document's mean log ratios by family, and numbers of n-grams.

    Half of the labelled good documents make the target model, the other half places the
    zeros. Without labelled good documents the raw corpus is its own target: all is kept.
    """
    sc = docs.sparkSession.sparkContext
    draw = F.xxhash64(F.lit(settings.seed + 1), "doc_id")
    rows = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(draw).limit(settings.max_labelled)
    good = np.sort(np.array([r.doc_id for r in rows.collect()], np.int64))  # at most max_labelled ids
    target, held_out = sc.broadcast(good[0::2]), sc.broadcast(good[1::2])
    bits = settings.bits
    few = docs.select("doc_id", "text").coalesce(max(8 * sc.defaultParallelism, 1))  # a task's counts are summed before they are sent
    counted = few.mapInArrow(lambda it: _count(it, target.value, bits), "at int, raw long, good long").groupBy("at").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    size = 1 << bits
    raw, hit = np.zeros(3 * size), np.zeros(3 * size)
    t = counted.toArrow()  # 3 * 2**bits rows at most
    raw[t["at"].to_numpy()], hit[t["at"].to_numpy()] = t["raw"].to_numpy(), t["good"].to_numpy()
    weights = [np.zeros(size), np.zeros(2 * size)]
    for k in (0, 1):
        own = slice(k * size, (1 + 2 * k) * size)
        r, h = raw[own], hit[own]
        if h.sum():
            expected = r / r.sum() * h.sum()
            w = np.log((h + settings.prior) / (expected + settings.prior))
            if k == 0:
                w[np.abs(h - expected) < settings.chance * np.sqrt(expected)] = 0
            w[r == 0] = 0
            weights[k] = w
    shared = sc.broadcast(weights)
    scores = materialize(_scores(docs, shared, settings), "weights")

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(np.isin(b.column("doc_id").to_numpy(zero_copy_only=False), held_out.value)))

    low = scores.mapInArrow(mine, scores.schema).agg(*(F.percentile_approx(c, settings.good_below, 20000).alias(c) for c in ("words", "grams"))).first()
    zeros = tuple(low[c] if low[c] is not None else -1e300 for c in ("words", "grams"))
    return Model(shared, zeros, settings), scores


def kth_largest(df: DataFrame, key: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of key, by histograms that narrow on it; the driver sees `bins` counts a round."""
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    left = k
    while lo is not None and lo < hi:
        width = (hi - lo) / bins
        if lo + width == lo or hi - width == hi:
            break
        at = F.least(F.floor((F.col(key) - lo) / width), F.lit(bins - 1)).alias("bin")
        for r in df.where(F.col(key).between(lo, hi)).groupBy(at).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).orderBy(F.desc("bin")).collect():
            if left <= r.n:
                lo, hi = r.lo, r.hi
                break
            left -= r.n
    return hi


def resample(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, log_weight, perturbed, kept) for every row of docs.

    Null and empty texts, and texts without words, have null weights and are not kept.
    Whole texts are counted and scored. Repeated rows score alike and each give a row;
    documents that tie at the last place are all kept. An empty table gives none. Columns
    of docs other than doc_id and text are not read.
    """
    model, scores = fit(docs, labels, settings)
    keyed, last = _cut(model, scores)
    return keyed.select("doc_id", "log_weight", "perturbed", F.coalesce(F.col("perturbed") >= last, F.lit(False)).alias("kept"))


def _cut(model: Model, scores: DataFrame) -> tuple[DataFrame, float]:
    w, p = model.key(F.col("doc_id"), [F.col("words"), F.col("grams")], [F.col("n_words"), F.col("n_grams")])
    keyed = scores.select("doc_id", w.alias("log_weight"), p.alias("perturbed"))
    k = keyed.where("log_weight >= 0").count()
    return keyed, kth_largest(keyed.where("perturbed IS NOT NULL"), "perturbed", k) if k else float("inf")


def keep_resampled(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of docs that resample() keeps, with all their columns; no text is shuffled.

    Null, empty and repeated rows, rows with a null doc_id (one key for all of them) and
    empty tables are as in resample().
    """
    model, scores = fit(docs, labels, settings)
    _, last = _cut(model, scores)
    weights, schema = model.weights, docs.schema
    names = [unused(docs, f"__{c}") for c in _PARTS_OF]

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        s = _score(b.column("text"), weights.value, settings)
        yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(s[:, k], from_pandas=True) for k in range(4))], [*b.schema.names, *names])

    wide = over_arrow(docs, run, StructType([*schema.fields, *(StructField(c, DoubleType()) for c in names)]))
    cols = [F.col(c) for c in names]
    _, p = model.key(F.col("doc_id"), cols[:2], cols[2:])
    return wide.where(p >= last).drop(*names)
