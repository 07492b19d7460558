"""Readings of tokens: notes in the text, corrections, and the compact form for display.

A token is a struct of s (surface), l (lemma), p and p2 (tags), k (reading), lk (the
lemma's reading), and its span b, e; further fields stay. All of it is higher-order
functions on a line's array of tokens, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.arrays import let, sums_before
from tessera.functions.text import KANJI, to_hira
from tessera.operators.sequence import matches

#: A reading in parentheses after kanji, and tags of marks.
_NOTE = f"({KANJI}+)[(（]([ぁ-ゖァ-ヺー]+)[)）]"
_MARKS = ("補助記号", "空白")
#: Short names of parts of speech.
TAGS = {"名詞": "n", "動詞": "v", "形容詞": "a", "形状詞": "na", "副詞": "adv", "代名詞": "pr", "助詞": "p", "助動詞": "aux", "接尾辞": "suf", "接頭辞": "pre", "接続詞": "cj", "連体詞": "adn", "感動詞": "int"}


def strip_notes(text: Column) -> Column:
    """(text, notes): the text without readings in parentheses after kanji, and (b, e, k) of what they are on, in that text."""
    part = lambda i: F.regexp_extract_all(text, F.lit(_NOTE), F.lit(i))
    gaps = F.slice(F.transform(F.split(text, _NOTE, -1), lambda g: F.length(g)), F.lit(1), F.size(part(1)))
    found = F.arrays_zip(gaps.alias("g"), part(1).alias("w"), part(2).alias("k"))

    def placed(x: Column) -> Column:
        # Each note is after the gaps up to it and the words before it.
        before = sums_before(F.transform(x, lambda n: n["g"] + F.length(n["w"])))
        return F.zip_with(before, x, lambda at, n: F.struct((at + n["g"]).alias("b"), (at + n["g"] + F.length(n["w"])).alias("e"), n["k"].alias("k")))

    return F.struct(F.regexp_replace(text, _NOTE, "$1").alias("text"), let(found, placed).alias("notes"))


def apply_notes(tokens: Column, notes: Column, text: Column) -> Column:
    """Tokens with the notes' readings.

    A note on one token is its reading; if the token goes on in hiragana, they follow the
    reading; several tokens become one noun. Notes that fit no tokens change nothing.
    """

    def merged(t: Column, n: Column) -> Column:
        word = F.substring(text, n["b"] + 1, n["e"] - n["b"])
        for field, value in (("s", word), ("l", word), ("p", F.lit("名詞")), ("p2", F.lit("普通名詞")), ("k", n["k"]), ("lk", n["k"]), ("e", n["e"]), ("f", F.lit(None).cast("string"))):
            t = t.withField(field, value)
        return t

    def step(ts: Column, n: Column) -> Column:
        rest = lambda t: F.substring(t["s"], n["e"] - n["b"] + 1, F.length(t["s"]))
        one = lambda t: (t["b"] == n["b"]) & ((t["e"] == n["e"]) | ((t["e"] > n["e"]) & rest(t).rlike(r"^[ぁ-ゖ]+\z")))
        inside = F.filter(ts, lambda t: (t["b"] >= n["b"]) & (t["e"] <= n["e"]))
        several = (F.size(inside) > 0) & (F.get(inside, F.lit(0))["b"] == n["b"]) & (F.try_element_at(inside, F.lit(-1))["e"] == n["e"])
        joined = F.concat(F.filter(ts, lambda t: t["b"] < n["b"]), F.array(merged(F.get(inside, F.lit(0)), n)), F.filter(ts, lambda t: (t["b"] >= n["b"]) & (t["e"] > n["e"])))
        return F.when(F.exists(ts, one), F.transform(ts, lambda t: F.when(one(t), t.withField("k", F.concat(n["k"], rest(t)))).otherwise(t))).when(several, joined).otherwise(ts)

    return F.aggregate(notes, tokens, step)


def lemma_reading(s: Column, l: Column, k: Column, lk: Column) -> Column:
    """The lemma's reading after k changed.

    Where surface and lemma share a beginning with kanji and part in kana, it is the
    reading with the lemma's ending for the surface's; else lk stays.
    """
    n = F.least(F.length(s), F.length(l))
    same = F.when(n > 0, F.size(F.filter(F.sequence(F.lit(1), n), lambda j: F.substring(s, F.lit(1), j) == F.substring(l, F.lit(1), j)))).otherwise(0)
    ends = F.substring(s, same + 1, F.length(s)), F.substring(l, same + 1, F.length(l))
    old = to_hira(ends[0])
    fits = (s != l) & (ends[0] != "") & F.substring(s, F.lit(1), same).rlike(KANJI) & ~F.concat(*ends).rlike(KANJI) & k.endswith(old) & (F.length(k) > F.length(old))
    return F.when(fits, F.concat(F.substring(k, F.lit(1), F.length(k) - F.length(old)), to_hira(ends[1]))).otherwise(lk)


def correct(tokens: Column, text: Column, fixes: list[dict]) -> Column:
    """Tokens after the first fix that matches each, all matched on the tokens as they were.

    A fix has tok (a condition), maybe line (a regex that the text must hold), and any of
    l, p, p2, k, lk to set; after k the lemma's reading follows, unless lk is set too.
    """
    if not fixes:
        return tokens
    fields = ("l", "p", "p2", "k", "lk")
    values = F.array(*(F.struct(*(F.lit(fix.get(f)).cast("string").alias(f) for f in fields)) for fix in fixes))

    def one(t: Column, i: Column) -> Column:
        which = None
        for at, fix in enumerate(fixes):
            ok = matches(tokens, i, fix["tok"])
            if "line" in fix:
                ok &= text.rlike(fix["line"])
            which = F.when(ok, F.lit(at)) if which is None else which.when(ok, F.lit(at))
        x = F.get(values, which)
        new = {f: F.coalesce(x[f], t[f]) for f in fields}
        new["lk"] = F.coalesce(x["lk"], F.when(x["k"].isNotNull(), lemma_reading(t["s"], new["l"], x["k"], t["lk"])), t["lk"])
        for f, value in new.items():
            t = t.withField(f, value)
        return t

    return F.transform(tokens, one)


def attaches(t: Column, before: Column) -> Column:
    """Whether a token goes on with the one before it, of which `before` is the tag (null: none)."""
    marks = before.isNull() | before.isin(*_MARKS) | t["p"].isin(*_MARKS)
    verbal = (t["p"] == "助詞") & (t["p2"] == "接続助詞") & t["s"].isin("て", "で", "ば", "ちゃ", "じゃ")
    ending = F.when(t["p"] == "助動詞", ~t["l"].isin("だ", "です")).otherwise((t["p"] == "接尾辞") | verbal)
    return F.coalesce(~marks & ((before == "接頭辞") | ending), F.lit(False))


def compact(t: Column) -> Column:
    """[surface, reading, tag, lemma, lemma's reading] without empty ends; marks and spaces are the surface alone.

    The reading is given where there are kanji, and for two particles; the lemma where it
    differs from the surface.
    """
    particle = F.when((t["p"] == "助詞") & (t["s"] == "は"), "わ").when((t["p"] == "助詞") & (t["s"] == "へ"), "え")
    k = F.coalesce(F.when(t["s"].rlike(KANJI) & (t["k"] != ""), t["k"]), particle, F.lit(""))
    other = t["l"] != t["s"]
    cells = F.array(t["s"], k, F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TAGS.items() for x in kv)), t["p"]), F.lit("")), F.when(other, t["l"]).otherwise(""), F.when(other & t["l"].rlike(KANJI), F.coalesce(t["lk"], F.lit(""))).otherwise(""))
    used = F.size(cells) - F.coalesce(F.array_position(F.transform(F.reverse(cells), lambda c: c != ""), True), F.lit(5)) + 1
    return F.when(t["p"].isin(*_MARKS), F.array(t["s"])).otherwise(F.slice(cells, F.lit(1), used.cast("int")))


def segments(text: Column, tokens: Column) -> Column:
    """Segments of a line: tokens with what attaches to them, and the text between tokens; end to end they are the line."""
    none = F.array().cast("array<array<array<string>>>")
    zero = F.struct(none.alias("done"), F.lit(0).alias("at"), F.lit(None).cast("string").alias("p"))
    between = lambda b, e: F.when(e > b, F.array(F.array(F.array(F.substring(text, b + 1, e - b))))).otherwise(none)

    def step(a: Column, t: Column) -> Column:
        before = F.when(t["b"] <= a["at"], a["p"])
        on = attaches(t, before) & (F.size(a["done"]) > 0)
        longer = F.concat(F.slice(a["done"], F.lit(1), F.size(a["done"]) - 1), F.array(F.concat(F.try_element_at(a["done"], F.lit(-1)), F.array(compact(t)))))
        done = F.when(on, longer).otherwise(F.concat(a["done"], between(a["at"], t["b"]), F.array(F.array(compact(t)))))
        return F.struct(done.alias("done"), t["e"].cast("int").alias("at"), t["p"].alias("p"))

    return F.aggregate(tokens, zero, step, lambda a: F.concat(a["done"], between(a["at"], F.length(text))))


def spoken(segs: Column) -> Column:
    """A line's reading: segments by spaces, each token as its reading or else its surface."""
    one = lambda seg: F.trim(F.array_join(F.transform(seg, lambda t: F.coalesce(F.nullif(F.get(t, F.lit(1)), F.lit("")), F.get(t, F.lit(0)))), ""))
    return F.array_join(F.filter(F.transform(segs, one), lambda x: x != ""), " ")


def highlight(text: Column, first: Column, second: Column) -> Column:
    """For each character "a" in a span of the first, else "b" in one of the second, else ""."""
    within = lambda spans, i: F.exists(spans, lambda x: (x["s"] <= i) & (i < x["e"]))
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda _, i: F.when(within(first, i), "a").when(within(second, i), "b").otherwise(""))
