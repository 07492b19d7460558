"""Pattern matching over token sequences, by higher-order functions on arrays of tokens.

A rule is {"tok": [condition, ...]}, {"re": pattern} or {"any": [rule, ...]}. A condition
is a dict over one token: s and k (regex, whole surface or reading), f (regex, prefix of
the form), l (lemma, one or several), p and p2 (tags, "!x" excludes), prev, next, !prev,
!next (a condition on the neighbour, without neighbours of its own).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrays import kept_in_turn, let, sums_before


def _many(x: str | list[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _own(t: Column, cond: dict) -> Column:
    ok = F.lit(True)
    for key, want in cond.items():
        value = F.coalesce(t[key], F.lit("")) if key in ("s", "k", "f", "l", "p", "p2") else None
        if key in ("s", "k"):
            ok &= value.rlike(rf"^(?:{want})\z")
        elif key == "f":
            ok &= value.rlike(rf"^(?:{want})")
        elif key == "l":
            ok &= value.isin(_many(want))
        elif key in ("p", "p2"):
            tags = _many(want)
            if out := [x[1:] for x in tags if x.startswith("!")]:
                ok &= ~value.isin(out)
            if one_of := [x for x in tags if not x.startswith("!")]:
                ok &= value.isin(one_of)
    return ok


def matches(tokens: Column, i: Column, cond: dict) -> Column:
    """Whether token i (0-based) of the array satisfies the condition."""
    ok = _own(F.get(tokens, i), cond)
    for key, step in (("prev", -1), ("next", 1)):
        there = (i + step >= 0) & (i + step < F.size(tokens))
        if key in cond:
            ok &= there & _own(F.get(tokens, i + step), cond[key])
        if f"!{key}" in cond:
            ok &= ~(there & _own(F.get(tokens, i + step), cond[f"!{key}"]))
    return F.coalesce(ok, F.lit(False))


def _span(s: Column, e: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"))


def seq_spans(tokens: Column, conds: list[dict]) -> Column:
    """Spans of every window of tokens that satisfies the conditions in turn; overlaps stay."""
    n = len(conds)
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))

    def all_ok(i: Column) -> Column:
        ok = F.lit(True)
        for k, c in enumerate(conds):
            ok &= matches(tokens, i + k, c)
        return ok

    return F.transform(F.filter(starts, all_ok), lambda i: _span(F.get(tokens, i)["b"], F.get(tokens, i + (n - 1))["e"]))


def regex_spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches, as spans in code points; empty matches are not spans."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))

    def spans(x: Column) -> Column:
        words, between = x["w"], F.slice(x["g"], F.lit(1), F.size(x["w"]))
        # Each match starts after the gaps up to it and the matches before it.
        starts = sums_before(F.zip_with(between, words, lambda g, w: g + F.length(w)))
        return F.zip_with(F.zip_with(starts, between, lambda s, g: s + g), words, lambda s, w: _span(s, s + F.length(w)))

    return let(F.struct(found.alias("w"), gaps.alias("g")), spans)


def greedy(spans: Column) -> Column:
    """Sorted by start and end, a span is dropped if it starts before the last kept one ends: at one start the shortest wins."""
    none = F.array().cast("array<struct<s:int,e:int>>")
    return kept_in_turn(F.array_sort(F.array_distinct(spans)), lambda last, x: x["s"] >= last["e"], none)


def lexicon_matches(text: Column, tokens: Column, entries: dict[str, list]) -> Column:
    """(w, s, e) of all entries in a line, by w, s and e.

    Each alternative of an entry is a lemma, {"re": pattern} or a list of conditions in
    turn; overlaps of one entry's spans go as in greedy(). Lemmas are looked up by a map,
    so that the expression grows only with the other alternatives.
    """
    lemmas: dict[str, list[str]] = {}
    tagged = []
    tag = lambda spans, w: F.transform(spans, lambda x: F.struct(F.lit(w).alias("w"), x["s"].alias("s"), x["e"].alias("e")))
    for w, match in entries.items():
        for alt in match:
            if isinstance(alt, str):
                lemmas.setdefault(alt, []).append(w)
            else:
                tagged.append(tag(rule_spans(text, tokens, alt if isinstance(alt, dict) else {"tok": alt}), w))
    if lemmas:
        words = F.create_map(*(x for l, ws in lemmas.items() for x in (F.lit(l), F.array(*map(F.lit, ws)))))
        known = F.filter(F.transform(tokens, lambda t: F.struct(F.try_element_at(words, t["l"]).alias("ws"), _span(t["b"], t["e"]).alias("x"))), lambda t: t["ws"].isNotNull())
        tagged.append(F.flatten(F.transform(known, lambda t: F.transform(t["ws"], lambda w: F.struct(w.alias("w"), t["x"]["s"].alias("s"), t["x"]["e"].alias("e"))))))
    none = F.array().cast("array<struct<w:string,s:int,e:int>>")
    if not tagged:
        return none

    return kept_in_turn(F.array_sort(F.array_distinct(F.concat(*tagged))), lambda last, x: (last["w"] != x["w"]) | (x["s"] >= last["e"]), none)


def rule_spans(text: Column, tokens: Column, rule: dict) -> Column:
    if "re" in rule:
        return regex_spans(text, rule["re"])
    if "tok" in rule:
        return seq_spans(tokens, rule["tok"])
    return greedy(F.concat(*(rule_spans(text, tokens, r) for r in rule["any"])))


def match_rules(text: Column, tokens: Column, rules: dict[str, dict]) -> Column:
    """Spans (s, id, e) of all rules, by start and then id."""
    def named(i: str, r: dict) -> Column:
        return F.transform(rule_spans(text, tokens, r), lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("id"), x["e"].alias("e")))

    tagged = [named(i, r) for i, r in rules.items()]
    return F.array_sort(F.concat(*tagged))


def first_rule(tokens: Column, i: Column, rules: list[tuple[dict, str]]) -> Column:
    """What the first rule that matches token i sets; all rules see the unmodified tokens. Null if none does."""
    out = None
    for cond, value in rules:
        out = F.when(matches(tokens, i, cond), F.lit(value)) if out is None else out.when(matches(tokens, i, cond), F.lit(value))
    return out
