"""Containment against all pairs, and candidates and audit of a small mart, by hand."""

import random

import pytest

from tessera.operators import candidates as operators
from tessera.operators import intervals
from tessera.operators.candidates import audit, candidates
from tessera.operators.intervals import covered, inside
from tessera.plans import queries

INNER = "song_id string, line_idx int, c_start int, c_end int, id int, _e string"
OUTER = "song_id string, line_idx int, c_start int, c_end int, w string"


def _rows(seed):
    rnd = random.Random(seed)
    line = lambda: rnd.choice([("a", 0), ("a", 0), ("a", 1), ("b", 0), (None, 0), ("a", None)])
    span = lambda most: (lambda s: (s, s + rnd.randrange(most)))(rnd.randrange(120))
    inner = [(*line(), *span(6), i, "x") for i in range(300)] + [("a", 0, None, 3, 900, "x"), ("a", 0, 3, None, 901, "x")]
    outer = [(*line(), *span(rnd.choice([4, 12, 60])), str(i)) for i in range(25)] + [("a", 0, None, 500, "null"), ("b", 0, 5, None, "null")]
    return inner, outer


def _holds(i, o):
    return None not in (*i[:4], *o[:4]) and i[:2] == o[:2] and o[2] <= i[2] and i[3] <= o[3]


@pytest.mark.parametrize("block,seed", [(4096, 0), (8, 1), (1, 2), (40, 3)])
def test_against_all_pairs(spark, monkeypatch, block, seed):
    monkeypatch.setattr(intervals, "BLOCK", block)
    inner, outer = _rows(seed)
    a, b = spark.createDataFrame(inner, INNER).repartition(3), spark.createDataFrame(outer, OUTER).repartition(2)
    got = covered(a, b, ["song_id", "line_idx"]).collect()
    assert {r.id: r.covered for r in got} == {i[4]: any(_holds(i, o) for o in outer) for i in inner} and len(got) == len(inner)
    assert got[0].asDict().keys() == {"song_id", "line_idx", "c_start", "c_end", "id", "_e", "covered"}
    pairs = [(r.id, r.w) for r in inside(a.drop("_e"), b, ["song_id", "line_idx"]).collect()]
    assert sorted(pairs) == sorted((i[4], o[4]) for i in inner for o in outer if _holds(i, o))


def test_no_intervals(spark):
    inner, outer = _rows(0)
    a, b = spark.createDataFrame(inner, INNER), spark.createDataFrame(outer, OUTER)
    assert not any(r.covered for r in covered(a, b.limit(0), ["song_id", "line_idx"]).collect())
    assert covered(a.limit(0), b, ["song_id", "line_idx"]).count() == 0


@pytest.fixture()
def tables(spark):
    songs = [("s1", "al", None), ("s2", "al", None), ("s3", "be", None), ("s4", "ce", None), ("s5", "al", "s1")]
    said = {"s1": ["é ö é", "ö ü"], "s2": ["é x"], "s3": ["ü é", "é"], "s4": ["ö ö"], "s5": ["é é"]}
    tokens, lines = [], []
    for song, texts in said.items():
        for i, text in enumerate(texts):
            lines.append((song, i, text, "z"))
            tokens += [(song, i, p, w, w, w.upper(), "k" + w, "n", 2 * p, 2 * p + 1) for p, w in enumerate(text.split())]
    hits = [("long", "s1", 0, 0, 3), ("one", "s3", 1, 0, 1), ("one", "s5", 0, 0, 1), ("off", "s2", 0, 2, 2)]
    grammar = [("g", "s1", 1, 2, 3), ("other", "s2", 0, 0, 3)]
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    return {
        "songs": make(songs, "id string, album string, dup_of string"), "albums": make([("al", False), ("be", True), ("ce", False)], "id string, done boolean"),
        "lines": make(lines, "song_id string, idx int, ja string, zh string"), "tokens": make(tokens, "song_id string, line_idx int, pos int, surface string, lemma string, kana string, lemma_kana string, pos1 string, c_start int, c_end int"),
        "entry_hits": make(hits, "w string, song_id string, line_idx int, c_start int, c_end int"), "grammar_hits": make(grammar, "grammar_id string, song_id string, line_idx int, c_start int, c_end int"),
    }


def test_candidates(tables):
    """é is free in s1 (its second time), s2 and s3; ö once in s1; ü only in s3, as grammar covers it in s1."""
    got = {r.lemma: tuple(r)[1:] for r in candidates(tables, ["al"], ["n"], ["g"]).collect()}
    assert got == {"é": ("n", "ké", 3, 2, 3, ["s1: 【é|É】 ö é  // z", "s2: 【é|É】 x  // z", "s3: ü 【é|É】  // z"])}
    more = {r.lemma: (r.songs, r.here, r.total) for r in candidates(tables, ["al"], ["n"], ["g"], least=1, examples=1).collect()}
    assert more == {"é": (3, 2, 3), "ö": (1, 1, 1)}
    assert {r.lemma for r in candidates(tables, ["al"], ["n"], [], least=2).collect()} == {"é", "ü"}
    assert candidates(tables, ["none"], ["n"], ["g"]).count() == 0 and candidates(tables | {"tokens": tables["tokens"].limit(0)}, ["al"], ["n"], ["g"]).count() == 0


def test_audit(tables):
    got = [(r.w, r.songs, [tuple(x) for x in r.readings]) for r in audit(tables, ["al", "be"]).collect()]
    assert sorted(got) == [("long", 1, [("É", 1), ("Ö", 1)]), ("one", 1, [("É", 1)])]


def test_inside_meets_only_what_is_near(spark):
    """A line of 2000 tokens and 1000 hits: each hit meets the tokens of its blocks, not of 4096 places."""
    tokens = spark.range(2000).selectExpr("'a' AS song_id", "0 AS line_idx", "CAST(id * 6 AS int) AS c_start", "CAST(id * 6 + 5 AS int) AS c_end", "id")
    hits = spark.range(1000).selectExpr("'a' AS song_id", "0 AS line_idx", "CAST(id * 12 AS int) AS c_start", "CAST(id * 12 + 11 AS int) AS c_end", "CAST(id AS string) AS w")
    assert intervals.JOIN_BLOCK <= 64 and inside(tokens, hits, ["song_id", "line_idx"]).count() == 2000


def _random_tables(spark, at, seed, repeated=False):
    rnd = random.Random(seed)
    vocabulary = ["étoile", "Été", "née", "über", "Über", "straße", "ciel", "Mer", "la", "né", "İle", "wordswords", "Ça", "a"]
    text = lambda: "\n".join("".join(rnd.choice(vocabulary) + rnd.choice([" ", " ", ", ", "'"]) for _ in range(rnd.randrange(9))) for _ in range(rnd.randrange(4)))
    docs = [(i, text(), "fr", f"src{rnd.randrange(5)}") for i in range(150)]
    docs += [(200 + i, docs[i][1], "fr", docs[i][3]) for i in range(0, 60, 2)] + [(300, None, "fr", "src1"), (None, "née née", "fr", "src1"), (301, "née", "fr", None), (302, "née 𝒳é née", "fr", "src1")]
    docs += [(0, "née plus étoile", "fr", docs[0][3])] if repeated else []
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(docs[i][3] != "src4")) for i in range(150)], "doc_id long, quality int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, "étoile née la, Über straße étoile"), (2, "née né"), (3, None), (4, "straße wordswords")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")


@pytest.mark.parametrize("seed", [1, 2])
def test_candidates_of_documents_are_those_of_tokens(spark, tmp_path, monkeypatch, seed):
    """Words are marked where their text is searched: the same rows as by tables of tokens, and no table of tokens."""
    _random_tables(spark, tmp_path, seed)
    mart = queries._mart(spark, str(tmp_path), done=True)
    want = candidates(mart, queries._CHOSEN, queries._WORD_TAGS, queries._GRAMMAR).collect()
    monkeypatch.setattr(operators, "candidates", None)
    got = queries.lexicon_candidates(spark, str(tmp_path)).collect()
    flat = lambda rows: sorted((r.lemma, r.pos1, r.kana, r.songs, r.here, r.total, r.examples if isinstance(r.examples, str) else "\n".join(r.examples)) for r in rows)
    assert len(got) > 4 and flat(got) == flat(want)


def test_candidates_of_repeated_ids(spark, tmp_path):
    _random_tables(spark, tmp_path, 3, repeated=True)
    want = candidates(queries._mart(spark, str(tmp_path), done=True), queries._CHOSEN, queries._WORD_TAGS, queries._GRAMMAR)
    got = queries.lexicon_candidates(spark, str(tmp_path))
    assert sorted((r.lemma, r.pos1, r.songs, r.total) for r in got.collect()) == sorted((r.lemma, r.pos1, r.songs, r.total) for r in want.collect())
