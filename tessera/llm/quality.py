"""Quality rules: how much of a text lies in n-grams and lines that it repeats.

Rolling hashes of several n-gram lengths are made over a whole batch of documents in
numpy. For each length the operator marks the words that lie in n-grams found twice or
more in the same document and measures their characters; it does the same for lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import chunks, mix, over_arrow, prefix_hash, span_hash, text_bytes, word_spans

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Limits:
    """Greatest shares that a kept document may have."""

    min_words: int = 50
    repeat_words_percent: int = 50  # words in repeated 3-word windows, of all words
    dup_lines: float = 0.30  # lines equal to an earlier one, of all lines with a word
    dup_line_chars: float = 0.20  # their characters, of all characters of words
    dup_ngram_chars: tuple[tuple[int, float], ...] = ((5, 0.20), (6, 0.20), (7, 0.20), (8, 0.20), (9, 0.20), (10, 0.20))  # in n-grams that an earlier place has, of all characters of words
    symbols_per_word: float = 0.10
    upper_letters: float = 0.60  # A-Z of all ASCII letters


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, dup_ngram_chars array<long>, base_failed boolean, kept boolean"


def _repeated(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of (row, key): which are found twice or more, and which of these are not the first."""
    dup, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.lexsort((keys, rows))
        k, r = keys[order], rows[order]
        same = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
        dup[order[1:]] |= same
        dup[order[:-1]] |= same
        later[order[1:]] = same
    return dup, later


def _measure(doc_id: pa.Array, data: np.ndarray, offsets: np.ndarray, limits: Limits) -> pa.RecordBatch:
    n = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets)
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before each byte
    chars = points[ends] - points[starts]
    count = lambda at, w=None: np.bincount(at, w, minlength=n).astype(np.int64)
    n_words, word_chars = count(rows), count(rows, chars)
    at_byte = lambda flags: np.searchsorted(offsets, np.flatnonzero(flags), "right") - 1
    n_symbols = count(at_byte(_SYMBOL[data])) if len(data) else np.zeros(n, np.int64)
    upper = count(at_byte((data >= 65) & (data <= 90)))
    letters = upper + count(at_byte((data >= 97) & (data <= 122)))
    c = prefix_hash(data)
    ids = span_hash(c, starts, ends) + (ends - starts).astype(np.uint64)
    if len(starts):
        hashes = mix(ids)
    else:
        hashes = ids
    # Lines with a word; equal whole lines of the same document.
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge[1:] |= data == 10
    cut = np.flatnonzero(edge)
    line_start, line_end = cut[:-1], cut[1:].copy()
    line_end -= data[line_end - 1] == 10 if len(line_end) else 0
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    _, later = _repeated(mix(span_hash(c, line_start, line_end) + (line_end - line_start).astype(np.uint64)), line_row)
    n_lines, n_dup_lines = count(line_row), count(line_row[later])
    before = np.concatenate(([0], np.cumsum(chars)))
    line_chars = before[np.searchsorted(starts, line_end)] - before[np.searchsorted(starts, line_start)]
    dup_line_chars = count(line_row[later], line_chars[later])
    # Words that repeated n-grams cover.
    covered = {}
    for k in (3, *(k for k, _ in limits.dup_ngram_chars)):
        mark = np.zeros(len(starts) + 1, np.int64)
        if len(starts) >= k:
            m = len(starts) - k + 1
            whole = np.flatnonzero(rows[:m] == rows[k - 1 :])
            acc = np.zeros(m, np.uint64)
            for i in range(k):
                acc = acc * np.uint64(0xD6E8FEB86659FD93) + hashes[i : m + i]
            dup, later = _repeated(mix(acc[whole]), rows[whole])
            at = whole[dup if k == 3 else later]
            np.add.at(mark, at, 1)
            np.add.at(mark, at + k, -1)
        covered[k] = np.cumsum(mark)[:-1] > 0
    n_repeat = count(rows[covered[3]])
    base_failed = (n_words < limits.min_words) | (100 * n_repeat > limits.repeat_words_percent * n_words)
    bad = (n_dup_lines > limits.dup_lines * n_lines) | (dup_line_chars > limits.dup_line_chars * word_chars)
    bad |= (n_symbols > limits.symbols_per_word * n_words) | (upper > limits.upper_letters * letters)
    shares = []
    for k, most in limits.dup_ngram_chars:
        shares.append(count(rows[covered[k]], chars[covered[k]]))
        bad |= shares[-1] > most * word_chars
    flat = np.stack(shares, 1).ravel() if shares else np.zeros(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(shares)), pa.array(flat, pa.int64()))
    return pa.RecordBatch.from_arrays(
        [doc_id, *(pa.array(x, pa.int64()) for x in (n_words, word_chars, n_symbols, n_dup_lines, n_repeat, dup_line_chars)), lists, pa.array(base_failed), pa.array(~base_failed & ~bad)],
        ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", "dup_ngram_chars", "base_failed", "kept"],
    )


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each document: what it repeats, and whether the rules keep it.

    Words are runs of bytes other than 0x20 and 0x09-0x0D. Null text has no words and
    fails the base rule, as does empty text. A text of any length is measured whole.
    Equal rows give equal results, one each; an empty table gives none. Columns other
    than doc_id and text are not read. Equality of lines and n-grams is that of 64-bit
    hashes within one document.
    """

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, j, data, offsets in chunks(*text_bytes(b.column("text"))):
            yield _measure(b.column("doc_id").slice(i, j - i), data, offsets, limits)

    return over_arrow(docs.select("doc_id", "text"), run, SCHEMA)
