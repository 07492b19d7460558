"""What to add to a lexicon, and how its entries are read, over the mart's tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.llm.common import id_filter, in_filter, mix
from tessera.operators.batch_rules import thinned
from tessera.operators.graph import written
from tessera.operators.intervals import covered, inside
from tessera.operators.lexicon import SLICE_TOKENS, Trie, alternatives
from tessera.sources.letters import TAGS, cut, few_rows, letter_runs, parts

_LINE = ["song_id", "line_idx"]


def _counted(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["songs"].where("dup_of IS NULL").select(F.col("id").alias("song_id"), "album")


def candidates(tables: dict[str, DataFrame], albums: list[str], pos: list[str], grammar: list[str], least: int = 2, examples: int = 3) -> DataFrame:
    """(lemma, pos1, kana, songs, here, total, examples): words of the chosen albums that no entry covers yet.

    Counted are songs that repeat no other, of the chosen albums and of those that are
    done; tokens with one of the tags `pos`, whose lemma isn't plain ASCII, and which
    neither a hit of an entry nor one of the listed grammar points covers whole. `songs`
    and `total` are songs and tokens, `here` songs of the chosen albums; kana is the
    largest reading of the lemma. A word is in `least` songs and in one of the chosen
    albums, at least. Examples are lines with the word marked, covered or not: its first
    place in each of the first songs, those of the chosen albums first. Null lemmas and
    tags are no words; without tokens there are no rows.
    """
    chosen = F.col("id").isin(albums)
    scope = tables["albums"].where(chosen | F.coalesce("done", F.lit(False))).select(F.col("id").alias("album"), chosen.alias("here")).distinct()
    songs = _counted(tables).join(scope, "album").select("song_id", "here")
    words = tables["tokens"].where(F.col("pos1").isin(pos) & F.col("lemma").rlike("[^ -~]")).join(songs, "song_id")
    spans = [tables["entry_hits"], tables["grammar_hits"].where(F.col("grammar_id").isin(grammar))]
    spans = [h.select(*_LINE, "c_start", "c_end") for h in spans]
    marked = covered(words.select(*_LINE, "pos", "lemma", "lemma_kana", "kana", "pos1", "c_start", "c_end", "here"), spans[0].unionAll(spans[1]), _LINE)
    # By song first: what a song says often is one row from here on.
    first = F.min(F.struct("line_idx", "pos", "c_start", "c_end", "kana"))
    by_song = marked.groupBy("lemma", "pos1", "song_id", "here").agg(F.count_if(~F.col("covered")).alias("n"), F.max(F.when(~F.col("covered"), F.col("lemma_kana"))).alias("kana"), first.alias("at"))
    by_song = written(by_song, "words")  # it is read twice
    free = F.col("n") > 0
    found = by_song.groupBy("lemma", "pos1").agg(F.max("kana").alias("kana"), F.count_if(free).alias("songs"), F.count_if(free & F.col("here")).alias("here"), F.sum("n").alias("total")).where((F.col("songs") >= least) & (F.col("here") >= 1))
    order = Window.partitionBy("lemma", "pos1").orderBy(F.desc("here"), "song_id")
    some = by_song.join(found.select("lemma", "pos1"), ["lemma", "pos1"], "left_semi").withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= examples)
    some = some.select("lemma", "pos1", "_i", "song_id", "at.*").join(tables["lines"].select("song_id", F.col("idx").alias("line_idx"), "ja", "zh"), _LINE)
    part = lambda a, n: F.substring(F.col("ja"), a, n)
    a, b = F.col("c_start"), F.col("c_end")
    shown = F.concat(F.col("song_id").cast("string"), F.lit(": "), part(F.lit(1), a), F.lit("【"), part(a + 1, b - a), F.lit("|"), F.coalesce("kana", F.lit("")), F.lit("】"), part(b + 1, F.length("ja")), F.lit("  // "), F.coalesce("zh", F.lit("")))
    lists = some.groupBy("lemma", "pos1").agg(F.array_sort(F.collect_list(F.struct("_i", shown.alias("text")))).alias("_x"))  # `examples` a word
    return found.join(lists, ["lemma", "pos1"]).select("lemma", "pos1", "kana", "songs", "here", "total", F.transform("_x", lambda x: x["text"]).alias("examples"))


_AT = "song_id long, line_idx int, c_start int, c_end int"
_SUMS = f"lemma string, pos1 string, songs long, here long, total long, examples array<struct<away:boolean,{_AT.replace(' ', ':').replace(',:', ',')}>>"


def _word_sums(b: pa.RecordBatch, trie: Trie, runs: list[list[str]], pos: list[str], most: int) -> Iterator[pa.RecordBatch]:
    """Rows of _SUMS for the words of the texts of a batch (song_id, here, text)."""
    of, number, line = cut(b.column("text"))
    row, s, e, tag, _, lemma = letter_runs(line)
    wanted = np.flatnonzero(np.isin(tag, [TAGS.index(p) for p in pos]) & ~pc.string_is_ascii(lemma).to_numpy(zero_copy_only=False))
    if not len(wanted):
        return
    # Hits of entries and runs of tags begin and end with tokens, so a token is covered if it is one of theirs.
    edge = np.zeros(len(row) + 1, np.int64)
    entry, x, y = trie.find(lemma, np.searchsorted(row, row, "right"))
    hits = [thinned(np.unique(trie.name[entry] * len(line) + row[x], return_inverse=True)[1], x, y + 1)[1:]]
    for run in runs:
        n = len(run)
        x = np.arange(max(0, len(row) - n + 1))
        x = x[np.logical_and.reduce([row[x] == row[x + n - 1], *(tag[x + i] == TAGS.index(p) for i, p in enumerate(run))])]
        hits.append((x, x + n))
    for x, y in hits:
        np.add.at(edge, x, 1)
        np.add.at(edge, y, -1)
    free = np.cumsum(edge)[:-1][wanted] == 0
    known = lemma.take(pa.array(wanted)).dictionary_encode()
    word = known.indices.to_numpy().astype(np.int64) * len(TAGS) + tag[wanted]
    # By word and text; the first place of each comes first.
    kind, first, where = np.unique(word * b.num_rows + of[row[wanted]], return_index=True, return_inverse=True)
    n = np.bincount(where, free, len(kind)).astype(np.int64)
    word, doc = np.divmod(kind, b.num_rows)
    here, song = b.column("here").to_numpy(zero_copy_only=False).astype(bool)[doc], b.column("song_id").to_numpy()[doc]
    each, begin, group = np.unique(word, return_index=True, return_inverse=True)
    total = lambda x: pa.array(np.bincount(group, x, len(each)).astype(np.int64))
    few = np.arange(len(kind)) - begin[group] < most
    chosen = np.lexsort((song, ~here, word))[few]
    at = wanted[first[chosen]]
    places = [pa.array(~here[chosen]), pa.array(song[chosen]), pa.array(number[row[at]], pa.int32()), pa.array(s[at], pa.int32()), pa.array(e[at], pa.int32())]
    shown = pa.StructArray.from_arrays(places, ["away", "song_id", "line_idx", "c_start", "c_end"])
    ends = np.concatenate(([0], np.cumsum(np.bincount(group[few], minlength=len(each)))))
    cols = [known.dictionary.take(pa.array(each // len(TAGS))), pa.array(TAGS).take(pa.array(each % len(TAGS))), total(n > 0), total((n > 0) & here), total(n), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), shown)]
    yield pa.RecordBatch.from_arrays(cols, ["lemma", "pos1", "songs", "here", "total", "examples"])


def _place_key(song: np.ndarray, line: np.ndarray) -> np.ndarray:
    return mix(mix(song.astype(np.int64).view(np.uint64)) + line.astype(np.uint64)).view(np.int64)


def _lines_of(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(song_id, line_idx, line) of texts (song_id, text): lines at the places (song_id, line_idx) and, before they are joined with them, some others."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_place_key(*(c.to_numpy() for c in b.columns)))], ["key"])

    keys = written(places.select(*_LINE).mapInArrow(keyed, "key long"), "places")
    words, songs = (docs.sparkSession.sparkContext.broadcast(id_filter(df, c)) for df, c in ((keys, "key"), (places, "song_id")))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            few = whole.filter(pa.array(in_filter(songs.value, whole.column("song_id").to_numpy())))
            for b in parts(few, "text"):
                of, number, line = cut(b.column("text"))
                song = b.column("song_id").to_numpy()[of]
                at = pa.array(np.flatnonzero(in_filter(words.value, _place_key(song, number))))
                yield pa.RecordBatch.from_arrays([pa.array(song).take(at), pa.array(number, pa.int32()).take(at), line.take(at)], ["song_id", "line_idx", "line"])

    return docs.select("song_id", "text").mapInArrow(held, "song_id long, line_idx int, line string")


def document_candidates(docs: DataFrame, copies: DataFrame, lexicon: DataFrame, pos: list[str], runs: list[list[str]], least: int = 2, examples: int = 3) -> DataFrame | None:
    """candidates() of whole texts (song_id, here, text) of the chosen albums (here) and those that are done, whose tokens are letter runs and their own kana; without kana.

    Texts of copies (song_id) aren't counted. Entries are those of the lexicon (w, match),
    grammar points are runs of tags. What covers a token is known where its text is
    searched, so neither tokens nor texts are shuffled: a row is a word of a batch, with
    sums and its first places. Texts go through an exact join if a filter can't tell
    them from copies, and lines if an example may be in them. None if this can't be:
    ids that aren't long or repeat, patterns or more tokens of phrases than a slice.
    """
    if docs.schema["song_id"].dataType != LongType():
        return None
    docs = docs.where("song_id IS NOT NULL")
    known = written(alternatives(lexicon), "alternatives").select("kind", "w", F.coalesce("phrase", F.array("lemma")).alias("phrase"))
    size = known.agg(F.sum(F.size("phrase")).alias("n"), F.count_if(F.col("kind") == "rule").alias("rules")).first()
    if size.rules or (size.n or 0) > SLICE_TOKENS or not docs.groupBy("song_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return None
    few_rows(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    copies = written(copies.select("song_id"), "copies")
    machine, gone = context.broadcast(Trie([(r.w, r.phrase) for r in known.toLocalIterator()])), context.broadcast(id_filter(copies, "song_id"))

    def split(b: pa.RecordBatch, unsure: bool) -> pa.RecordBatch:
        return b.filter(pa.array(in_filter(gone.value, b.column("song_id").to_numpy()) == unsure))

    def sums(batches: Iterator[pa.RecordBatch], sure: bool) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in parts(split(whole, False) if sure else whole, "text"):
                yield from _word_sums(b, machine.value, runs, pos, examples)

    unsure = docs.mapInArrow(lambda it: (split(b, True) for b in it), docs.schema).join(copies, "song_id", "left_anti")
    by_batch = docs.mapInArrow(lambda it: sums(it, True), _SUMS).unionAll(unsure.mapInArrow(lambda it: sums(it, False), _SUMS))
    by_batch = written(by_batch, "words")  # it is read twice
    word = ["lemma", "pos1"]
    found = by_batch.groupBy(*word).agg(*(F.sum(c).alias(c) for c in ("songs", "here", "total"))).where((F.col("songs") >= least) & (F.col("here") >= 1))
    found = written(found, "found")
    order = Window.partitionBy(*word).orderBy("away", "song_id")
    some = by_batch.select(*word, "examples").join(found.select(*word), word, "left_semi").select(*word, F.inline("examples"))
    some = written(some.withColumn("_i", F.row_number().over(order)).where(F.col("_i") <= examples), "examples")
    some = some.join(_lines_of(docs, some), _LINE)
    a, b = F.col("c_start"), F.col("c_end")
    part = lambda x, n: F.substring("line", x, n)
    shown = F.concat(F.col("song_id").cast("string"), F.lit(": "), part(F.lit(1), a), F.lit("【"), part(a + 1, b - a), F.lit("|"), part(a + 1, b - a), F.lit("】"), part(b + 1, F.length("line")), F.lit("  // "))
    lists = some.groupBy(*word).agg(F.array_sort(F.collect_list(F.struct("_i", shown.alias("text")))).alias("_x"))  # `examples` a word
    return found.join(lists, word).select(*word, "songs", "here", "total", F.transform("_x", lambda x: x["text"]).alias("examples"))


def audit(tables: dict[str, DataFrame], albums: list[str]) -> DataFrame:
    """(w, songs, readings): of each entry with tokens inside its hits in the albums' counted songs, how many songs, and how often it is read how.

    readings is an array of (kana, n), the most frequent first, null last among equals.
    """
    songs = _counted(tables).where(F.col("album").isin(albums)).select("song_id")
    hits = tables["entry_hits"].join(songs, "song_id").select("w", *_LINE, "c_start", "c_end")
    tokens = tables["tokens"].join(songs, "song_id", "left_semi").select(*_LINE, "kana", "c_start", "c_end")
    by_song = written(inside(tokens, hits, _LINE).groupBy("w", "kana", "song_id").agg(F.count("*").alias("n")), "readings")  # it is read twice
    counts = by_song.groupBy("w", "kana").agg(F.sum("n").alias("n")).groupBy("w").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("kana").isNull().alias("last"), "kana"))).alias("_x"))
    held = by_song.select("w", "song_id").distinct().groupBy("w").agg(F.count("*").alias("songs"))
    return held.join(counts, "w").select("w", "songs", F.transform("_x", lambda x: F.struct(x["kana"].alias("kana"), (-x["m"]).alias("n"))).alias("readings"))
