"""A tokenizer that takes a line's cheapest path through the words of a dictionary.

The dictionary is a table; it is what mart.tagged_lines takes as a back-end.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words and pairs of classes that a task may hold.
MOST_WORDS, MOST_PAIRS = 2_000_000, 4_000_000
#: Code points of the longest word.
LONGEST = 64
#: What a run of letters outside the dictionary costs, and each of its code points; fixed values.
UNKNOWN, EACH = 10_000, 1_000
#: Classes of an unknown word, and of a line's ends.
NO_CLASS = 0

Entry = tuple[str, str, int, int, int]


def dictionary(entries: DataFrame, connections: DataFrame) -> tuple[dict[str, list[Entry]], dict[tuple[int, int], int]]:
    """Words by surface, with each beginning of one, and costs by (right, left) class, of entries (s, l, p, left, right, cost) and connections (right, left, cost).

    Of equal entries one is kept, of connections of one pair the cheapest. Entries without
    a surface, with white space in it or of more than LONGEST code points fail, as do tables beyond their bounds;
    null lemmas are the surface, null parts of speech "", null classes NO_CLASS, null costs 0.
    """
    of = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(NO_CLASS)).alias(c)
    rows = entries.select("s", F.coalesce("l", "s").alias("l"), F.coalesce("p", F.lit("")).alias("p"), of("left"), of("right"), of("cost")).distinct().limit(MOST_WORDS + 1).collect()
    pairs = connections.groupBy(of("right"), of("left")).agg(F.min(of("cost")).alias("cost")).limit(MOST_PAIRS + 1).collect()
    if len(rows) > MOST_WORDS or len(pairs) > MOST_PAIRS:
        raise ValueError(f"a dictionary of more than {MOST_WORDS} words or {MOST_PAIRS} pairs of classes")
    words: dict[str, list[Entry]] = {}
    for r in sorted(map(tuple, rows), key=lambda r: (r[0] or "", *r[1:])):
        if not r[0] or len(r[0]) > LONGEST or any(c.isspace() for c in r[0]):
            raise ValueError(f"a surface has 1 to {LONGEST} code points and no white space: {r[0]!r}")
        for e in range(1, len(r[0])):
            words.setdefault(r[0][:e], [])
        words.setdefault(r[0], []).append(r[1:])
    return words, {(r["right"], r["left"]): r["cost"] for r in pairs}


@lru_cache(maxsize=1 << 16)
def _kind(c: str) -> str:
    """What a run of unknown letters has in common: the script, or the class of what isn't a letter."""
    return unicodedata.name(c, "").split(" ")[0] if c.isalpha() else unicodedata.category(c)


def candidates(line: str, words: dict[str, list[Entry]]) -> Iterator[list[tuple[int, Entry]]]:
    """For each place of a line the (end, entry) that start there; white space has none.

    Besides the dictionary's words a place has the rest of its run of one kind of letters,
    up to LONGEST code points, and its one code point, so that every place is reached.
    """
    kinds = ["" if c.isspace() else _kind(c) for c in line] + [""]
    ends = list(range(1, len(line) + 1))
    for i in range(len(line) - 2, -1, -1):
        if kinds[i] == kinds[i + 1]:
            ends[i] = ends[i + 1]
    for i, kind in enumerate(kinds[:-1]):
        found: list[tuple[int, Entry]] = []
        if kind:
            for e in range(i + 1, len(line) + 1):
                here = words.get(line[i:e])
                if here is None:  # no word begins like this
                    break
                found.extend((e, x) for x in here)
            found.extend((e, (line[i:e], "", NO_CLASS, NO_CLASS, UNKNOWN + EACH * (e - i))) for e in {i + 1, min(ends[i], i + LONGEST)})
        yield found


def cheapest(line: str, words: dict[str, list[Entry]], joins: dict[tuple[int, int], int]) -> list[dict]:
    """Tokens (s, l, p, b, e) of the path of the least cost: words, and connections of each with the next; pairs of classes without a cost are free.

    White space lies between tokens. Of tokens that end alike at the same cost the shorter
    one is taken, then the smaller entry, so a line has one answer. Work and memory go
    with the line's length, times the classes that end at one place.
    """
    # At each place, for each right class that a path ends in: (cost, start of its last token, entry, class before).
    ends: list[dict[int, tuple]] = [{} for _ in range(len(line) + 1)]
    ends[0][NO_CLASS] = (0, 0, None, NO_CLASS)
    for i, found in enumerate(candidates(line, words)):
        if line[i].isspace():
            for c, (cost, *_) in ends[i].items():
                ends[i + 1][c] = (cost, i, None, c)
            continue
        reached: dict[int, tuple[int, int]] = {}
        for e, entry in found:
            if entry[2] not in reached:  # entries of one class are reached alike
                reached[entry[2]] = min((v[0] + joins.get((c, entry[2]), 0), c) for c, v in ends[i].items())
            cost, before = reached[entry[2]]
            new = (cost + entry[4], i, entry, before)
            old = ends[e].get(entry[3])
            if old is None or (new[0], -i, entry) < (old[0], -old[1], old[2]):
                ends[e][entry[3]] = new
    at = len(line)
    c = min(ends[at], key=lambda c: (ends[at][c][0] + joins.get((c, NO_CLASS), 0), c))
    out = []
    while at:
        _, start, entry, before = ends[at][c]
        if entry is not None:
            out.append({"s": line[start:at], "l": entry[0], "p": entry[1], "b": start, "e": at})
        at, c = start, before
    return out[::-1]


def lattice_tagger(entries: DataFrame, connections: DataFrame) -> Callable[[], Callable[[str], list[dict]]]:
    """A back-end for tagged_lines; the dictionary, whose size is bounded, is broadcast once."""
    words, joins = dictionary(entries, connections)
    sent = entries.sparkSession.sparkContext.broadcast((words, joins))

    def tagger() -> Callable[[str], list[dict]]:
        return lambda line: cheapest(line, *sent.value)

    return tagger
