"""Letter runs of many lines at once, by arrays of code points."""

from __future__ import annotations

import functools
import hashlib
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TAGS = ("word", "short", "cap")
TOKENS = "array<struct<s:string,l:string,p:string,b:int,e:int>>"
#: Bytes of text that are worked on at a time, about.
TEXT_BYTES = 4_000_000


@functools.cache
def _known_kinds() -> np.ndarray:
    return np.full(sys.maxunicode + 1, 255, np.uint8)


def _kinds(points: np.ndarray) -> np.ndarray:
    """For each code point 1 for a letter, 2 for an upper-case one, else 0; a point is looked up once."""
    known = _known_kinds()
    kind = known[points]
    new = kind == 255
    if new.any():
        for p in np.unique(points[new]).tolist():
            known[p] = {"Lu": 2, "Ll": 1, "Lt": 1, "Lm": 1, "Lo": 1}.get(unicodedata.category(chr(p)), 0)
        kind = known[points]
    return kind


def _lower(surface: pa.Array, ascii_only: bool) -> pa.Array:
    """Lower-cased surfaces, which hold letters only: as one text, a line for each, so that no word is a Python string."""
    if ascii_only or not len(surface):
        return pc.ascii_lower(surface)
    ends = np.frombuffer(surface.buffers()[1], np.int32)[1:]
    lines = np.insert(np.frombuffer(surface.buffers()[2], np.uint8), ends, 10)
    low = np.frombuffer(lines.tobytes().decode().lower().encode(), np.uint8)
    stop = low == 10
    places = np.concatenate(([0], np.flatnonzero(stop) - np.arange(len(surface)))).astype(np.int32)
    return pa.StringArray.from_buffers(len(surface), pa.py_buffer(places.tobytes()), pa.py_buffer(low[~stop].tobytes()))


def code_points(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]:
    """(bytes, code points, where in the bytes each begins, first point of each row, whether all are ASCII) of an array without nulls."""
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
    raw = text.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    ascii_only = not (data >= 0x80).any()
    if ascii_only:
        return data, data, np.arange(len(data) + 1), offsets, True
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    begins = (data & 0xC0) != 0x80
    lead = np.append(np.flatnonzero(begins), len(data))
    return data, points, lead, np.searchsorted(lead, offsets), False


def letter_runs(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array, pa.Array]:
    """(row, begin, end, tag, surface, lemma) of each letter run, in turn; places are code points of the row, tags numbers in TAGS. Null rows have none."""
    data, points, lead, first, ascii_only = code_points(text.cast(pa.string()).fill_null(""))
    kind = _kinds(points)
    letter = kind > 0
    edge = np.zeros(len(points) + 1, bool)
    edge[first] = True
    before, after = np.zeros(len(points), bool), np.zeros(len(points), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    s = np.flatnonzero(letter & (~before | edge[:-1]))
    e = np.flatnonzero(letter & (~after | edge[1:])) + 1
    row = np.searchsorted(first, s, "right") - 1
    inside = letter if ascii_only else np.repeat(letter, np.diff(lead))
    places = np.concatenate(([0], np.cumsum(lead[e] - lead[s]))).astype(np.int32)
    surface = pa.StringArray.from_buffers(len(s), pa.py_buffer(places.tobytes()), pa.py_buffer(data[inside].tobytes()))
    tag = np.where(kind[s] == 2, 2, (e - s <= 3).astype(np.int64))
    return row, s - first[row], e - first[row], tag, surface, _lower(surface, ascii_only)


def parts(b: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with TEXT_BYTES of a text column, or one row."""
    size = np.cumsum(pc.binary_length(b.column(column)).fill_null(0).to_numpy())
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + TEXT_BYTES, "right")))
        yield b.slice(i, j - i)
        i = j


def cut(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(row, number, line) of the \\n-split lines of texts; null texts have none."""
    each = pc.split_pattern(text.cast(pa.string()), "\n")
    sizes = pc.list_value_length(each).fill_null(0).to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(text)), sizes)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes), each.flatten()


#: Of bytes: whether they are ASCII letters, and their lower case.
_ASCII_LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])
_ASCII_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)


class Text:
    """The letter runs of texts that are one array of bytes, with a newline after each text: places are bytes, so only what is asked for is counted in lines or code points."""

    def __init__(self, text: pa.Array) -> None:
        text = text.cast(pa.string()).fill_null("")
        sizes = pc.binary_length(text).to_numpy().astype(np.int64)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(text)], pa.int32()), text), "\n")[0].as_buffer()
        self.data = np.append(np.frombuffer(joined, np.uint8), np.uint8(10)) if len(text) else np.zeros(0, np.uint8)
        self.newline = np.flatnonzero(self.data == 10)
        #: First byte of each text, and of each line.
        self.first, self.line_first = np.cumsum(sizes + 1) - sizes - 1, np.append(0, self.newline[:-1] + 1)
        letter = _ASCII_LETTER[self.data]
        wide = np.flatnonzero(self.data >= 0x80)
        if len(wide):
            rare = self.data[wide]
            points = np.frombuffer(rare.tobytes().decode().encode("utf-32-le"), np.uint32)
            letter[wide] = (_kinds(points) > 0)[np.cumsum((rare & 0xC0) != 0x80) - 1]
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        if len(letter) and letter[0]:
            edge = np.append(0, edge)
        self.begin, self.end = edge[::2], edge[1::2]
        self.later = wide[(self.data[wide] & 0xC0) == 0x80]  # bytes that aren't a code point's first
        places = np.append(0, np.cumsum(self.end - self.begin)).astype(np.int32)
        low = _ASCII_LOWER[self.data[letter]]
        #: Lower-cased but for those that aren't ASCII, which are `odd`.
        self._runs = pa.StringArray.from_buffers(len(self.begin), pa.py_buffer(places), pa.py_buffer(low))
        odd = np.zeros(len(self.begin), bool)
        odd[np.searchsorted(self.begin, wide[letter[wide]], "right") - 1] = True
        self._odd = np.flatnonzero(odd)
        #: Whether a run is the last one of its line.
        self.last = np.zeros(len(self.begin), bool)
        before = np.searchsorted(self.begin, self.newline) - 1
        self.last[before[before >= 0]] = True

    def numbers(self, lemmas: pa.Array) -> np.ndarray:
        """The place in lemmas of each lower-cased run, or -1."""
        number = pc.index_in(self._runs, lemmas).fill_null(-1).to_numpy().astype(np.int64)
        if len(self._odd):
            # The surface again, as an ASCII letter beside others is lower-cased alike.
            own = _lower(self._runs.take(pa.array(self._odd)), False)
            number[self._odd] = pc.index_in(own, lemmas).fill_null(-1).to_numpy()
        return number

    def text_of(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1

    def line_of(self, place: np.ndarray) -> np.ndarray:
        """The number of the line among those of all texts."""
        return np.searchsorted(self.line_first, place, "right") - 1

    def points(self, start: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Code points between places."""
        return place - start - (np.searchsorted(self.later, place) - np.searchsorted(self.later, start))

    def digests(self, line: np.ndarray) -> list[bytes]:
        """MD5 of lines."""
        data = self.data.tobytes()
        return [hashlib.md5(data[s:e]).digest() for s, e in zip(self.line_first[line].tolist(), self.newline[line].tolist(), strict=True)]


def few_rows(spark: SparkSession) -> None:
    """Arrow batches get 1000 rows at most, as whole documents are long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 1000:
        spark.conf.set(name, "1000")


def token_lines(text_lines: DataFrame, places: bool = True) -> DataFrame:
    """text_lines with tok, an array of the letter runs of line: surface s, lower-cased l, tag p and the span b to e.

    Tags are cap (first letter in upper case), short (three letters or fewer) and word.
    Spans are in code points of the line, or in token numbers without places.
    """
    schema = StructType([*text_lines.schema, *StructType.fromDDL(f"tok {TOKENS}")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in parts(whole, "line"):
                row, s, e, tag, surface, lemma = letter_runs(b.column("line"))
                ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=b.num_rows))))
                if not places:
                    s = np.arange(len(row)) - ends[row]
                    e = s + 1
                named = pa.array(TAGS).take(pa.array(tag))
                one = pa.StructArray.from_arrays([surface, lemma, named, pa.array(s, pa.int32()), pa.array(e, pa.int32())], ["s", "l", "p", "b", "e"])
                tok = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), one)
                yield pa.RecordBatch.from_arrays([*b.columns, tok], [*b.schema.names, "tok"])

    return text_lines.mapInArrow(run, schema)


def held_tokens(text_lines: DataFrame, key: str) -> DataFrame:
    """(key, lemma, n, held) of lines (key, line, hits): the different lemmas of each line, how often they come, and whether they lie inside of a hit.

    hits is an array of spans (s, e) that are sorted and don't overlap.
    """
    schema = StructType([text_lines.schema[key], *StructType.fromDDL("lemma string, n long, held boolean")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in parts(whole, "line"):
                row, s, e, _, _, lemma = letter_runs(b.column("line"))
                if not len(row):
                    continue
                hits = b.column("hits").fill_null([]) if b.column("hits").null_count else b.column("hits")
                spans, of = hits.flatten(), np.repeat(np.arange(b.num_rows), hits.value_lengths().to_numpy())
                held = np.zeros(len(row), bool)
                if len(of):
                    # The last hit that starts at the token or before it.
                    at = np.searchsorted((of << 32) + spans.field("s").to_numpy(), (row << 32) + s, "right") - 1
                    held = (at >= 0) & (of[at] == row) & (e <= spans.field("e").to_numpy()[at])
                known = lemma.dictionary_encode()
                code = known.indices.to_numpy().astype(np.int64)
                kind, n = np.unique((row * len(known.dictionary) + code) * 2 + held, return_counts=True)
                word = known.dictionary.take(pa.array(kind // 2 % len(known.dictionary)))
                keys = b.column(key).take(pa.array(kind // 2 // len(known.dictionary)))
                yield pa.RecordBatch.from_arrays([keys, word, pa.array(n, pa.int64()), pa.array(kind % 2 == 1)], [key, "lemma", "n", "held"])

    return text_lines.mapInArrow(run, schema)


def _words(docs: DataFrame, key: str, schema: StructType, rows: Callable[[pa.Array, pa.Array, np.ndarray, np.ndarray, np.ndarray], list]) -> DataFrame:
    """rows(keys, different lemmas, row and lemma of each word of a text, how often it comes) of the texts of (key, text)."""
    few_rows(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in parts(whole, "text"):
                row, *_, lemma = letter_runs(b.column("text"))
                if len(row):
                    known = lemma.dictionary_encode()
                    kind, n = np.unique(row * len(known.dictionary) + known.indices.to_numpy(), return_counts=True)
                    row, word = np.divmod(kind, len(known.dictionary))
                    yield pa.RecordBatch.from_arrays(rows(b.column(key), known.dictionary, row, word, n), schema.names)

    return docs.select(key, "text").mapInArrow(run, schema)


def word_counts(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lemma, n): the different lemmas of each text, and how often they come."""
    schema = StructType([docs.schema[key], *StructType.fromDDL("lemma string, n long")])
    return _words(docs, key, schema, lambda keys, known, row, word, n: [keys.take(pa.array(row)), known.take(pa.array(word)), pa.array(n, pa.int64())])


def word_totals(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(lemma, songs, total): in how many different keys each lemma comes, nulls not counted, and how often.

    Texts whose keys don't repeat are summed by batches, so that only a batch's lemmas are
    shuffled; those of repeated keys go by (key, lemma).
    """

    def summed(keys: pa.Array, known: pa.Array, row: np.ndarray, word: np.ndarray, n: np.ndarray) -> list:
        there = keys.is_valid().to_numpy(zero_copy_only=False)[row]
        songs = np.bincount(word[there], minlength=len(known))
        total = np.bincount(word, n, minlength=len(known)).astype(np.int64)  # below 2^53
        return [known, pa.array(songs, pa.int64()), pa.array(total)]

    def by_batch(d: DataFrame) -> DataFrame:
        return _words(d, key, StructType.fromDDL("lemma string, songs long, total long"), summed)

    again = docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    if again.isEmpty():
        found = by_batch(docs)
    else:
        by_key = word_counts(docs.join(again, key, "left_semi"), key).groupBy(key, "lemma").agg(F.sum("n").alias("n"))
        found = by_batch(docs.join(again, key, "left_anti")).unionAll(by_key.groupBy("lemma").agg(F.count("*").alias("songs"), F.sum("n").alias("total")))
    return found.groupBy("lemma").agg(F.sum("songs").alias("songs"), F.sum("total").alias("total"))
