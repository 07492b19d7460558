"""SentencePiece encoding by Gumbel top-k sampling without replacement, and decoding.

A text's lattice has an edge for each piece of the vocabulary that fits at a place. With
the sums of all paths from each place on as an exact bound, a search from the largest
perturbed bound down (A*) gives whole paths in the order of their Gumbel-perturbed log
probabilities: the k first are a sample of k distinct segmentations without replacement.
A path that is popped is completed by drawing edge by edge; at each edge the set of paths
that take another one stays in the queue, with the largest perturbed value it can have.
Values are drawn from the row's key, so that a row has the same samples wherever it runs.

Texts are cut between any two characters that no piece holds side by side, so that a
lattice falls into words; that of each different word of a batch is built once. All steps run on whole batches
in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import BASES, bound_batches, chunks, mix, powers, prefix_hash, span_hash, text_bytes

SAMPLES = 2
MODEL = "piece_bpe_32k.model"
#: Log probability of a byte where no piece has the character.
BYTE_LOG_PROB = -12.0
#: Texts of so many bytes share the lattices of their words.
BATCH_BYTES = 1 << 20
_SPACE = 0x20


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LIKELY_BITS = 21
_BUCKET_BITS = 17
_PAIR_BITS = 20


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(32 - _PAIR_BITS)


@dataclass
class Vocabulary:
    """The model's pieces as code points, with U+2581 as the space it stands for."""

    keys: np.ndarray  # hashes of pieces, sorted; the largest number after them
    bucket: np.ndarray  # by the first bits of a hash: where hashes with them begin
    likely: np.ndarray  # by the first bits of a hash: 1 if a piece has them, 2 if what a longer piece begins with has
    ids: np.ndarray
    log_probs: np.ndarray
    longest: int
    joined: np.ndarray  # by a hash of two characters: whether a piece may hold them side by side
    byte_ids: np.ndarray
    piece_bytes: np.ndarray  # what each id decodes to, end to end
    piece_ends: np.ndarray


@lru_cache(maxsize=4)
def vocabulary(model: bytes) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.vocab_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    usable = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    scores = np.array([sp.get_score(i) for i in usable])
    if scores.min() < -100:  # merge ranks, not log probabilities: by Zipf's law of the rank
        rank = np.empty(len(scores))
        rank[np.argsort(-scores, kind="stable")] = np.arange(len(scores))
        log_probs = -np.log(rank + 2.7)
        log_probs -= np.log(np.exp(log_probs).sum())
    else:
        log_probs = scores
    texts = [pieces[i].replace("▁", " ") for i in usable]
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    ends = np.cumsum([len(p) for p in points])
    c = prefix_hash(np.concatenate(points))
    keys = mix(span_hash(c, ends - [len(p) for p in points], ends) + np.array([len(p) for p in points], np.uint64))
    order = np.argsort(keys)
    byte_ids = np.full(256, -1, np.int64)
    said = [b""] * n
    for i in range(n):
        if sp.is_byte(i):
            byte_ids[int(pieces[i][3:5], 16)] = i
            said[i] = bytes([int(pieces[i][3:5], 16)])
    for i, t in zip(usable, texts, strict=True):
        said[i] = t.encode()
    likely = np.zeros(1 << _LIKELY_BITS, np.uint8)
    for x in range(1, max(map(len, points))):
        begin = np.array([e - len(p) for e, p in zip(ends, points, strict=True) if len(p) > x], np.int64)
        likely[mix(span_hash(c, begin, begin + x) + np.uint64(x)) >> np.uint64(64 - _LIKELY_BITS)] |= 2
    likely[keys >> np.uint64(64 - _LIKELY_BITS)] |= 1
    joined = np.zeros(1 << _PAIR_BITS, bool)
    for q in points:
        joined[_pair(q[:-1], q[1:])] = True
    bucket = np.searchsorted(keys[order], np.arange(1 << _BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - _BUCKET_BITS)).astype(np.int32)
    return Vocabulary(np.append(keys[order], np.uint64(2**64 - 1)), bucket, likely, np.array(usable, np.int64)[order], log_probs[order], max(map(len, points)), joined, byte_ids, np.frombuffer(b"".join(said), np.uint8), np.cumsum([len(x) for x in said]))


def _find(key: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Where each hash stands among the pieces', or the next larger one."""
    at = v.bucket[key >> np.uint64(64 - _BUCKET_BITS)]
    less = np.flatnonzero(v.keys[at] < key)
    while len(less):
        at[less] += 1
        less = less[v.keys[at[less]] < key[less]]
    return at


def decode(ids: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Bytes of ids, end to end."""
    size = np.diff(np.concatenate(([0], v.piece_ends)))[ids]
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(v.piece_ends[ids] - ends, size)
    return v.piece_bytes[at]


class _Lattice:
    """The words of some texts; a row for each place of each different word, whose edges stand side by side, short ones first."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, v: Vocabulary) -> None:
        # Every text that isn't empty begins with a space of its own.
        n = len(offsets) - 1
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        full = np.diff(lead) > 0
        self.points = np.insert(points, lead[:-1][full], _SPACE)
        size = np.diff(lead) + full
        self.text_ends = np.cumsum(size)
        p = self.points
        first = np.zeros(len(p), bool)
        first[1:] = ~v.joined[_pair(p[:-1], p[1:])]
        first[(self.text_ends - size)[full]] = True
        self.starts = np.flatnonzero(first)
        self.ends = np.append(self.starts[1:], len(p)) if len(self.starts) else self.starts
        self.first_word = np.concatenate(([0], np.concatenate(([0], np.cumsum(first)))[self.text_ends]))
        self.text = np.repeat(np.arange(n), np.diff(self.first_word))
        c = prefix_hash(p)
        length = self.ends - self.starts
        h = mix(span_hash(c, self.starts, self.ends) + length.astype(np.uint64))
        _, one, kind = np.unique(h, return_index=True, return_inverse=True)
        self.length = length
        kind_length = length[one]
        base = np.concatenate(([0], np.cumsum(kind_length)))
        self.base = base[kind]
        rows = int(base[-1])
        at = np.arange(rows) - np.repeat(base[:-1], kind_length) + np.repeat(self.starts[one], kind_length)  # place in points
        left = np.repeat(self.starts[one] + kind_length, kind_length) - at
        # Edges: from each place, as long as some piece goes on like this.
        inverse, start = powers(BASES[0], len(p))[1][at], c[at]
        alive = np.arange(rows)
        found_row, found_piece = [], []
        for x in range(1, v.longest + 1):
            alive = alive[left[alive] >= x]
            key = mix((c[at[alive] + x] - start[alive]) * inverse[alive] + np.uint64(x))
            bits = v.likely[key >> np.uint64(64 - _LIKELY_BITS)]
            maybe = np.flatnonzero(bits & 1)
            found = _find(key[maybe], v)
            hit = v.keys[found] == key[maybe]
            found_row.append(alive[maybe[hit]])
            found_piece.append(found[hit])
            if x == 1:
                lone = np.ones(rows, bool)
                lone[found_row[0]] = False
                lone = np.flatnonzero(lone)
            alive = alive[bits >> 1 > 0]
            if not len(alive):
                break
        cp = p[at[lone]]
        n_edges = np.zeros(rows, np.int64)
        for r in (lone, *found_row):
            n_edges[r] += 1
        self.edge = np.concatenate(([0], np.cumsum(n_edges)))
        fill = self.edge[:-1].copy()
        self.size = np.ones(self.edge[-1], np.int8 if v.longest < 128 else np.int32)
        self.piece = np.full(self.edge[-1], -1, np.int32)
        value = np.empty(self.edge[-1])
        value[fill[lone]] = BYTE_LOG_PROB * (1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))
        fill[lone] += 1
        for x, (r, piece) in enumerate(zip(found_row, found_piece, strict=True), 1):
            self.size[fill[r]] = x
            self.piece[fill[r]] = v.ids[piece]
            value[fill[r]] = v.log_probs[piece]
            fill[r] += 1
        # Sums of all paths from each place, from the words' ends on; then conditional log probabilities.
        row = np.repeat(np.arange(rows), n_edges)
        level = left[row]
        by = np.argsort(level.astype(np.uint16) if len(left) and left.max() < 1 << 16 else level, kind="stable")
        to = row + self.size
        to[self.size == level] = rows  # a word's end
        ahead = np.zeros(rows + 1)
        cut = np.searchsorted(level[by], np.arange(1, (left.max() if rows else 0) + 2))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            e = by[lo:hi]
            if not len(e):
                continue
            r = row[e]
            begin = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            total = value[e] + ahead[to[e]]
            value[e] = total
            most = np.maximum.reduceat(total, begin)
            ahead[r[begin]] = most + np.log(np.add.reduceat(np.exp(total - np.repeat(most, np.diff(np.append(begin, len(e))))), begin))
        self.log_p = value - ahead[row]
        total = np.concatenate(([0.0], np.cumsum(np.exp(self.log_p))))
        self.cum = total[1:] - total[self.edge[row]]
        self.cum[self.edge[1:] - 1] = np.inf  # the last edge takes what rounding leaves

    def walk(self, word: np.ndarray, place: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, place, edge) drawn from a place in each word to its end."""
        out = [(word[:0], place[:0], place[:0])]
        while len(word):
            text = self.text[word]
            edge = self.edge[self.base[word] + place]
            u = _uniform(seed[text], word - self.first_word[text], place)
            on = np.flatnonzero(u >= self.cum[edge])
            while len(on):
                edge[on] += 1
                on = on[u[on] >= self.cum[edge[on]]]
            out.append((word, place, edge))
            place = place + self.size[edge]
            going = place < self.length[word]
            word, place = word[going], place[going]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def chances(self, row: np.ndarray, taken: np.ndarray) -> np.ndarray:
        """For some rows, how likely each edge is, side by side; 0 for those that are taken."""
        first, count = self.edge[row], self.edge[row + 1] - self.edge[row]
        i = np.arange(count.max() if len(row) else 1)
        open_ = (i < count[:, None]) & ((taken[:, None] >> i) & 1 == 0)
        return np.where(open_, np.exp(self.log_p[np.minimum(first[:, None] + i, len(self.log_p) - 1)]), 0.0)


def _uniform(seed: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1 that follow from (seed, a, b)."""
    x = mix(seed.astype(np.uint64) + mix(a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) + np.uint64(1)))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def _truncated(place: np.ndarray, most: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel variable at `place` given that it is `most` or less."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        return np.where(np.isneginf(place), -np.inf, -np.logaddexp(-most, np.log(-np.log(u)) - place))


@dataclass
class _Path:
    """A path for each text, its edges by text and place."""

    word: np.ndarray
    place: np.ndarray
    edge: np.ndarray
    text: np.ndarray
    log_p: np.ndarray
    before: np.ndarray  # log probability of what precedes the edge
    taken: np.ndarray  # edges of the place that are out of the set, as bits
    value: np.ndarray  # largest perturbed value of that set
    total: np.ndarray  # by text
    perturbed: np.ndarray


def _complete(t: _Lattice, n: int, word: np.ndarray, place: np.ndarray, edge: np.ndarray, fresh: np.ndarray, taken: np.ndarray, perturbed: np.ndarray, seed: np.ndarray) -> _Path:
    at = np.full(len(t.points), -1, np.int32)
    at[t.starts[word] + place] = np.arange(len(word))
    order = at[at >= 0]  # by text and place
    word, place, edge, fresh, taken = (x[order] for x in (word, place, edge, fresh, taken))
    row, text = t.base[word] + place, t.text[word]
    log_p = t.log_p[edge]
    c = np.concatenate(([0.0], np.cumsum(log_p)))
    first = np.searchsorted(text, np.arange(n + 1))
    before = c[:-1] - c[first[text]]
    taken = taken | (1 << (edge - t.edge[row]))
    new = np.flatnonzero(fresh)
    rest = -np.expm1(log_p[new])
    # Sums over the other edges, where one less than the probability would lose them to rounding.
    many = np.flatnonzero((taken[new] & (taken[new] - 1) != 0) | (rest < 1e-6))
    if len(many):
        rest[many] = t.chances(row[new[many]], taken[new[many]]).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mass = np.where(rest > 0, before[new] + np.log(rest), -np.inf)
    value = np.full(len(word), -np.inf)
    value[new] = _truncated(mass, perturbed[text[new]], _uniform(mix(seed)[text[new]], word[new] - t.first_word[text[new]], place[new]))
    return _Path(word, place, edge, text, log_p, before, taken, value, np.add.reduceat(np.append(log_p, 0), first[:-1]) * (np.diff(first) > 0) if len(first) > 1 else np.zeros(0), perturbed)


def sample(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, k: int, v: Vocabulary) -> tuple[_Lattice, list[tuple[_Path, np.ndarray]], np.ndarray]:
    """The lattice; for each rank the paths and which texts have one; the largest perturbed value that is left to each text."""
    n = len(offsets) - 1
    t = _Lattice(data, offsets, v)
    paths: list[tuple[_Path, np.ndarray]] = []
    seed = mix(keys.astype(np.int64).view(np.uint64))
    top = -np.log(-np.log(_uniform(seed, np.zeros(n), np.full(n, 7))))
    word, place, edge = t.walk(np.arange(len(t.starts)), np.zeros(len(t.starts), np.int64), seed)
    paths.append((_complete(t, n, word, place, edge, np.ones(len(word), bool), np.zeros(len(word), np.int64), top, seed), np.ones(n, bool)))
    while True:
        best, source = np.full(n, -np.inf), np.full(n, -1)
        for i, (p, _) in enumerate(paths):
            first = np.searchsorted(p.text, np.arange(n + 1))
            if len(p.value):
                most = np.where(np.diff(first) > 0, np.maximum.reduceat(np.append(p.value, -np.inf), first[:-1]), -np.inf)
                source = np.where(most > best, i, source)
                best = np.maximum(best, most)
        if len(paths) == k:
            return t, paths, best
        r = len(paths)
        seed = mix(seed + np.uint64(r))
        new: list[tuple[np.ndarray, ...]] = []
        for i, (p, _) in enumerate(paths):
            mine = np.flatnonzero(source == i)
            if not len(mine):
                continue
            hit = np.flatnonzero((source[p.text] == i) & (p.value == best[p.text]) & np.isfinite(p.value))
            _, one = np.unique(p.text[hit], return_index=True)
            hit = hit[one]
            fork = np.full(n, -1)
            fork[p.text[hit]] = hit
            p.value[hit] = -np.inf
            row = t.base[p.word[hit]] + p.place[hit]
            c = np.cumsum(t.chances(row, p.taken[hit]), 1)
            u = _uniform(seed[p.text[hit]], np.full(len(hit), 3), np.full(len(hit), 5)) * c[:, -1]
            edge = t.edge[row] + np.where(c[:, -1] > 0, np.minimum((u[:, None] >= c).sum(1), t.edge[row + 1] - t.edge[row] - 1), 0)
            keep = np.flatnonzero((fork[p.text] >= 0) & (np.arange(len(p.text)) < fork[p.text]))
            new.append((p.word[keep], p.place[keep], p.edge[keep], np.zeros(len(keep), bool), np.zeros(len(keep), np.int64)))
            new.append((p.word[hit], p.place[hit], edge, np.ones(len(hit), bool), p.taken[hit]))
            # The rest of the word, and all words after it.
            end = p.place[hit] + t.size[edge]
            part = end < t.length[p.word[hit]]
            after = np.zeros(len(t.starts) + 1, np.int64)
            last = t.first_word[p.text[hit] + 1]
            np.add.at(after, p.word[hit] + 1, 1)
            np.add.at(after, last, -1)
            later = np.flatnonzero(np.cumsum(after)[:-1] > 0)
            w, q, s = t.walk(np.concatenate((p.word[hit][part], later)), np.concatenate((end[part], np.zeros(len(later), np.int64))), seed)
            new.append((w, q, s, np.ones(len(w), bool), np.zeros(len(w), np.int64)))
        if not new:
            return t, paths, best
        word, place, edge, fresh, taken = (np.concatenate(c) for c in zip(*new, strict=True))
        paths.append((_complete(t, n, word, place, edge, fresh, taken, best, seed), source >= 0))


def path_ids(t: _Lattice, p: _Path, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the path's pieces, and the text of each; a character without a piece gives its bytes."""
    piece = t.piece[p.edge].astype(np.int64)
    lone = np.flatnonzero(piece < 0)
    if not len(lone):
        return piece, p.text
    cp = t.points[t.starts[p.word[lone]] + p.place[lone]]
    count = np.ones(len(piece), np.int64)
    count[lone] = 1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF)
    ids, at = np.repeat(piece, count), np.cumsum(count) - count
    for c in np.unique(cp).tolist():
        for i, b in enumerate(chr(c).encode()):
            ids[at[lone[cp == c]] + i] = v.byte_ids[b]
    return ids, np.repeat(p.text, count)


SCHEMA = "doc_id long, sample long, n_pieces long, log_prob double, perturbed double, inclusion double, ids_hash long, decoded boolean"


def _segment(b: pa.RecordBatch, model: bytes, k: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    v = vocabulary(model)
    keys = b.column("key").to_numpy(zero_copy_only=False)
    for i, j, data, offsets in chunks(*text_bytes(b.column("text")), BATCH_BYTES):
        n = j - i
        t, paths, left = sample(data, offsets, keys[i:j], k, v)
        for rank, (p, has) in enumerate(paths, 1):
            ids, text = path_ids(t, p, v)
            n_pieces = np.bincount(text, minlength=n)
            ends = np.cumsum(n_pieces)
            hashed = mix(span_hash(prefix_hash(ids), ends - n_pieces, ends) + n_pieces.astype(np.uint64))
            said = decode(ids, v)
            # Back to the texts: without the space that each begins with, they are the same bytes.
            size = np.bincount(text, np.diff(np.concatenate(([0], v.piece_ends)))[ids], minlength=n).astype(np.int64)
            real = has & (size > 0)
            begin = np.cumsum(size) - size
            ok = has & (size == np.diff(offsets) + (np.diff(offsets) > 0))
            inner = np.ones(len(said), bool)
            inner[begin[real]] = False
            inner &= np.repeat(ok, size)
            wanted = np.repeat(ok, np.diff(offsets))
            wrong = np.flatnonzero(said[inner] != data[wanted])
            if len(wrong):
                ok[np.repeat(np.arange(n), np.diff(offsets))[wanted][wrong]] = False
            with np.errstate(over="ignore"):
                inclusion = -np.expm1(-np.exp(p.total - left))
            cols = [b.column("doc_id").slice(i, n), pa.array(np.full(n, rank)), pa.array(n_pieces, pa.int64()), pa.array(p.total), pa.array(p.perturbed), pa.array(inclusion), pa.array(hashed.view(np.int64)), pa.array(ok)]
            names = ["doc_id", "sample", "n_pieces", "log_prob", "perturbed", "inclusion", "ids_hash", "decoded"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids, pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(has))


def sample_segmentations(docs: DataFrame, k: int = SAMPLES, model: str | None = None, with_ids: bool = False, seed: int = 6) -> DataFrame:
    """k distinct segmentations of every text, best perturbed first.

    Columns: doc_id, sample (1 to k), n_pieces, log_prob, perturbed, inclusion (the
    chance that a sample of this size includes it), a hash of the ids, whether the ids
    decode to the very text, and the ids where with_ids asks for them. Null and empty
    texts have one segmentation, without pieces; texts with fewer than k segmentations
    give what they have. Whole texts are segmented. The draw follows from seed, doc_id
    and text, so repeated rows give equal samples. An empty table gives none; other
    columns are not read. `model` is the path of a SentencePiece model, read on the driver.
    """
    bound_batches(docs.sparkSession)
    with open(model or model_path(), "rb") as f:
        proto = docs.sparkSession.sparkContext.broadcast(f.read())
    keyed = docs.select("doc_id", "text", F.xxhash64(F.lit(seed), "doc_id", "text").alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from _segment(b, proto.value, k, with_ids)

    return keyed.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))
