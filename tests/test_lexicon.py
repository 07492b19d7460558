"""A lexicon that is a table, against a plain search of every alternative in every line."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import lexicon
from tessera.operators.lexicon import Automaton, alternatives, document_hits, hit_totals, table_hits
from tessera.sources import letters
from tessera.sources.letters import token_lines

TOKEN = "struct<s:string,l:string,p:string,k:string,f:string,p2:string,b:int,e:int>"


def _tokens(line):
    return [(m[0], m[0].lower(), "cap" if m[0][0].isupper() else "low", "", "", "", m.start(), m.end()) for m in re.finditer(r"\w+", line)]


def _frame(spark, texts):
    rows = [(i, t, _tokens(t) if t is not None else None, 1, "w") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"id long, line string, tok array<{TOKEN}>, s int, w string").repartition(3)


def _plain(texts, entries):
    out = set()
    for i, text in enumerate(texts):
        tok = _tokens(text or "")
        for w, match in entries.items():
            spans = set()
            for alt in match:
                if isinstance(alt, str):
                    spans |= {(t[6], t[7]) for t in tok if t[1] == alt}
                elif isinstance(alt, dict):
                    spans |= {m.span() for m in re.finditer(alt["re"], text or "")}
                else:
                    ok = lambda t, c: all(t[{"l": 1, "p": 2, "s": 0}[k]] in ([v] if isinstance(v, str) else v) for k, v in c.items())
                    spans |= {(tok[j][6], tok[j + len(alt) - 1][7]) for j in range(len(tok) - len(alt) + 1) if all(ok(tok[j + n], c) for n, c in enumerate(alt))}
            last = -1
            for s, e in sorted(spans):
                if s >= last:
                    out.add((i, w, s, e))
                    last = e
    return out


@pytest.mark.parametrize("slice_tokens,entries_a_pass", [(500_000, 100), (20, 1)])
def test_table_hits(spark, monkeypatch, slice_tokens, entries_a_pass):
    monkeypatch.setattr(lexicon, "SLICE_TOKENS", slice_tokens)
    monkeypatch.setattr(lexicon, "PASS_ENTRIES", entries_a_pass)
    rnd = random.Random(4)
    word = lambda: rnd.choice("a b c d Ab ba".split())
    texts = [" ".join(word() for _ in range(rnd.randrange(0, 30))) for _ in range(60)] + [None, "", "a" * 50]
    entries = {f"e{i}": [[{"l": word().lower()} for _ in range(rnd.randrange(1, 5))] for _ in range(3)] + ([word().lower()] if i % 3 == 0 else []) for i in range(30)}
    entries |= {"re": [{"re": "b a|ab"}, "d"], "cond": [[{"p": "cap"}, {"l": ["a", "b"]}], [{"l": "c"}, {"l": "c"}]], "none": [], "missing": ["zz", [{"l": "zz"}]]}
    table = spark.createDataFrame([(w, [x if isinstance(x, str) else json.dumps(x) for x in m]) for w, m in entries.items()] + [("null", None), ("e0", ["d"])], "w string, match array<string>")
    entries["e0"] = [*entries["e0"], "d"]
    got = [tuple(r) for r in table_hits(_frame(spark, texts), table, ["id"]).collect()]
    assert len(got) == len(set(got)) and set(got) == _plain(texts, entries) and len(got) > 500


def test_no_lines_or_entries(spark):
    lines, none = _frame(spark, ["a b"]), spark.createDataFrame([], "w string, match array<string>")
    assert table_hits(lines, none, ["id"]).count() == 0
    assert table_hits(lines.limit(0), spark.createDataFrame([("x", ["a", '[{"l": "a"}, {"l": "b"}]', '{"re": "a"}'])], "w string, match array<string>"), ["id"]).count() == 0


def test_kinds(spark):
    match = ["a", '[{"l": "a"}]', '[{"l": ["a", "b"]}]', '[{"l": "a", "p": "x"}]', '{"re": "x"}', "[]"]
    got = {r.lemma or r.rule or str(r.phrase): r.kind for r in alternatives(spark.createDataFrame([("w", match)], "w string, match array<string>")).collect()}
    assert got == {"a": "lemma", "['a']": "phrase", match[2]: "rule", match[3]: "rule", match[4]: "rule", "[]": "rule"}


def test_automaton():
    rnd = random.Random(1)
    for _ in range(200):
        phrases = [(str(i), [rnd.choice("ab") for _ in range(rnd.randrange(0, 5))]) for i in range(rnd.randrange(8))]
        line = [rnd.choice("abc") for _ in range(40)]
        want = {(w, i, i + len(p)) for w, p in phrases if p for i in range(len(line)) if line[i : i + len(p)] == p}
        got = list(Automaton(phrases).find(line))
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("at_once", [1, 4_000_000])
def test_hits_of_documents_are_those_of_their_lines(spark, monkeypatch, at_once):
    """Whole texts, cut where they are searched, have the hits of their lines; patterns and conditions too."""
    monkeypatch.setattr(letters, "TEXT_BYTES", at_once)
    texts = [None, "", "\n", "A bé a\n\nbé A c\r\nΣΑΣ a", "a b\na b a b", "b\na", "x" * 20, "a\n" * 30 + "a bé a bé"]
    docs = spark.createDataFrame([(None if i == 4 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    table = spark.createDataFrame([("x", ['[{"l": "a"}, {"l": "bé"}]', "σας", "b"]), ("y", ['[{"l": "a"}, {"l": "b"}, {"l": "a"}]', '{"re": "c."}', '[{"p": "cap"}]'])], "w string, match array<string>")
    lines = token_lines(docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_idx", "line")))
    for known in (table, table.where("w = 'x'")):
        want = [tuple(r) for r in table_hits(lines, known, ["doc_id", "line_idx"]).collect()]
        assert sorted(map(str, (tuple(r) for r in document_hits(docs, known).collect()))) == sorted(map(str, want)) and len(want) > 5


def test_lines_are_no_rows_where_only_phrases_are_searched(spark):
    """The plan has neither an explode of lines nor arrays of tokens; these took most of the time."""
    docs = spark.createDataFrame([(1, "a b\na b")], "doc_id long, text string")
    plan = document_hits(docs, spark.createDataFrame([("x", ['[{"l": "a"}, {"l": "b"}]'])], "w string, match array<string>"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "posexplode" not in plan and "tok" not in plan


def test_chained_hits_are_searched_in_documents(spark):
    """chain_join joins lines to hits by their numbers; the search itself has no rows for lines."""
    from tessera.plans.queries import QUERIES

    plan = QUERIES["chain_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "tok#" not in plan


@pytest.mark.parametrize("at_once,slice_tokens,ids", [(1, 500_000, "once"), (4_000_000, 500_000, "once"), (60, 8, "once"), (4_000_000, 2, "once"), (60, 500_000, "again"), (4_000_000, 8, "again")])
def test_totals_are_those_of_hits_joined_to_lines_and_texts(spark, monkeypatch, at_once, slice_tokens, ids):
    """Overlaps, equal lines of one text and of several, null keys and values, and keys that repeat, against sets of Python."""
    monkeypatch.setattr(letters, "TEXT_BYTES", at_once)
    monkeypatch.setattr(lexicon, "SLICE_TOKENS", slice_tokens)
    texts = [None, "", "\n", "A bé a\n\nbé A c\r\nΣΑΣ a\u212a", "a b\na b a b a b", "b\na", "a\n" * 30 + "a bé a bé", "x" * 20, "a b a b a b\na b a b a b", "é", "a'ΑΣ'b 中b a\nb"] * 2
    key = {"once": lambda i: None if i == 8 else i, "again": lambda i: None if i == 8 else i // 3 * 2 + i % 2}[ids]
    rows = [(key(i), [None, "p", "q"][i % 3], t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    match = {"x": ['[{"l": "a"}, {"l": "bé"}]', "σας", "b", "ak"], "y": ['[{"l": "a"}, {"l": "b"}, {"l": "a"}]', '[{"l": "b"}, {"l": "a"}]', "ας"], "z": ["a", '[{"l": "a"}, {"l": "b"}]', "中b"], "none": []}
    table = spark.createDataFrame(list(match.items()), "w string, match array<string>")
    want = {}
    hits = [tuple(r) for r in document_hits(docs, table).collect()]
    for k, at, w, _, _ in hits:
        for k2, _, text in rows:
            for k3, source, _ in rows:
                if k is not None and k == k2 == k3 and text is not None and at < len(text.split("\n")):
                    n = want.setdefault((w, source), [0, set(), set()])
                    n[0], n[1], n[2] = n[0] + 1, n[1] | {k}, n[2] | {text.split("\n")[at]}
    got = [tuple(r) for r in hit_totals(docs, table, "source").collect()]
    assert sorted(map(str, got)) == sorted(str((*k, n, len(keys), len(lines))) for k, (n, keys, lines) in want.items()) and len(got) > 6


def test_totals_of_patterns_and_of_nothing(spark):
    docs = spark.createDataFrame([(1, "s", "a b\na b"), (2, "s", "a b\nb")], "doc_id long, source string, text string")
    table = spark.createDataFrame([("x", ['{"re": "b"}', "a"])], "w string, match array<string>")
    assert [tuple(r) for r in hit_totals(docs, table, "source").collect()] == [("x", "s", 7, 2, 2)]
    for some, known in ((docs.limit(0), table.select("w", F.array(F.lit("a")).alias("match"))), (docs, table.limit(0))):
        assert hit_totals(some, known, "source").collect() == []


def test_chained_hits_are_summed_where_they_are_searched(spark):
    """chain_join has neither rows for lines nor joins; these grew with all lines."""
    from tessera.plans.queries import QUERIES

    plan = QUERIES["chain_join"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "posexplode" not in plan and plan.count("MapInArrow") == 1
