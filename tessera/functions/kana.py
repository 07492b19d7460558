"""Kana to Latin letters, as folds over syllables; no Python on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import to_hira


def _entries(table: str) -> dict[str, str]:
    words = table.split()
    return dict(zip(words[::2], words[1::2], strict=True))


#: Single kana.
_SYLLABLES = _entries("""
    あ a い i う u え e お o
    か ka き ki く ku け ke こ ko
    さ sa し shi す su せ se そ so
    た ta ち chi つ tsu て te と to
    な na に ni ぬ nu ね ne の no
    は ha ひ hi ふ fu へ he ほ ho
    ま ma み mi む mu め me も mo
    や ya ゆ yu よ yo
    ら ra り ri る ru れ re ろ ro
    わ wa ゐ i ゑ e を wo ん n
    が ga ぎ gi ぐ gu げ ge ご go
    ざ za じ ji ず zu ぜ ze ぞ zo
    だ da ぢ ji づ zu で de ど do
    ば ba び bi ぶ bu べ be ぼ bo
    ぱ pa ぴ pi ぷ pu ぺ pe ぽ po
    ぁ a ぃ i ぅ u ぇ e ぉ o ゔ vu
""")
#: Kana with a small one, read as one syllable.
_JOINED = _entries("""
    きゃ kya きゅ kyu きょ kyo
    しゃ sha しゅ shu しょ sho
    ちゃ cha ちゅ chu ちょ cho
    にゃ nya にゅ nyu にょ nyo
    ひゃ hya ひゅ hyu ひょ hyo
    みゃ mya みゅ myu みょ myo
    りゃ rya りゅ ryu りょ ryo
    ゐゃ ya ゐゅ yu ゐょ yo
    ぎゃ gya ぎゅ gyu ぎょ gyo
    じゃ ja じゅ ju じょ jo
    ぢゃ ja ぢゅ ju ぢょ jo
    びゃ bya びゅ byu びょ byo
    ぴゃ pya ぴゅ pyu ぴょ pyo
    いぁ a いぃ i いぅ u いぇ e いぉ o
    うぁ wa うぃ wi うぅ wu うぇ we うぉ wo
    きぁ ka きぃ ki きぅ ku きぇ ke きぉ ko
    しぁ sha しぃ shi しぅ shu しぇ she しぉ sho
    ちぁ cha ちぃ chi ちぅ chu ちぇ che ちぉ cho
    てぃ ti
    にぁ na にぃ ni にぅ nu にぇ ne にぉ no
    ひぁ ha ひぃ hi ひぅ hu ひぇ he ひぉ ho
    ふぁ fa ふぃ fi ふぅ fu ふぇ fe ふぉ fo
    みぁ ma みぃ mi みぅ mu みぇ me みぉ mo
    りぁ ra りぃ ri りぅ ru りぇ re りぉ ro
    ゐぁ a ゐぃ i ゐぅ u ゐぇ e ゐぉ o
    ぎぁ ga ぎぃ gi ぎぅ gu ぎぇ ge ぎぉ go
    じぁ ja じぃ ji じぅ ju じぇ je じぉ jo
    ぢぁ ja ぢぃ ji ぢぅ ju ぢぇ je ぢぉ jo
    でぃ di
    びぁ ba びぃ bi びぅ bu びぇ be びぉ bo
    ぴぁ pa ぴぃ pi ぴぅ pu ぴぇ pe ぴぉ po
""")
#: Signs of the display form.
_SIGNS = {"、": ",", "。": ".", "？": "?", "！": "!", "　": " "}


def _table(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


def to_romaji(x: Column) -> Column:
    """Kana in Latin letters, run together; what isn't kana stays.

    A small tsu doubles the next syllable's first letter unless that is a vowel or n; a
    long mark says the last vowel again. Null gives null.
    """
    table = _table(_SYLLABLES | _JOINED)
    units = F.regexp_extract_all(to_hira(x), F.lit(f"(?s){'|'.join(_JOINED)}|."), F.lit(0))
    start = F.struct(F.lit("").alias("said"), F.lit(False).alias("double"))

    def step(a: Column, u: Column) -> Column:
        latin = F.try_element_at(table, u)
        twice = F.when(a["double"] & latin.rlike("^[^aiueon]"), F.substring(latin, 1, 1)).otherwise("")
        more = F.when(u == "っ", "").when(u == "ー", F.regexp_extract(a["said"], "(?s)([aiueo])[^aiueo]*$", 1)).otherwise(F.concat(F.coalesce(twice, F.lit("")), F.coalesce(latin, u)))
        return F.struct(F.concat(a["said"], more).alias("said"), (u == "っ").alias("double"))

    return F.aggregate(units, start, step, lambda a: a["said"])


def display_romaji(x: Column) -> Column:
    """The form for display: words by spaces, tch, n' before vowels and y, Latin punctuation.

    A mora is a kana with the small kana, long marks and small tsu that go with it; what
    isn't kana stays, in hiragana. Null gives null.
    """
    table = _table(_SYLLABLES | {"ゃ": "ya", "ゅ": "yu", "ょ": "yo", "ゎ": "wa"})
    signs = _table(_SIGNS)

    def said(u: Column) -> Column:
        stops = F.length(F.regexp_extract(u, "^(っ*)", 1))
        core = F.regexp_replace(u, "^っ+|ー+$", "")
        first, small = F.substring(core, 1, 1), F.substring(core, F.lit(2), F.length(core))
        latin, tail = F.try_element_at(table, first), F.coalesce(F.try_element_at(table, small), F.lit(""))
        stem = F.regexp_replace(latin, "[aiueo]$", "")
        glide = F.when(latin.isin("shi", "chi", "ji"), F.concat(stem, F.regexp_replace(tail, "^.", ""))).otherwise(F.concat(F.regexp_replace(latin, ".$", ""), tail))
        plain = F.when(latin.isNull(), F.coalesce(F.try_element_at(signs, first), core)).when(small == "", latin).when(small.rlike("[ゃゅょ]"), glide).otherwise(F.concat(stem, tail))
        long = F.concat(plain, F.repeat(F.regexp_extract(plain, "(?s)([aiueo])[^aiueo]*$", 1), F.length(F.regexp_extract(u, "(ー*)$", 1))))
        head = F.when(long.startswith("ch"), F.concat(F.repeat(F.substring(long, 1, 1), stops - 1), F.lit("t"))).otherwise(F.repeat(F.substring(long, 1, 1), stops))
        return F.when(stops == 0, long).otherwise(F.concat(head, long))

    units = F.regexp_extract_all(to_hira(x), F.lit("(?s) |っ*[^っ ][ゃゅょぁぃぅぇぉゎー]*|っ+"), F.lit(0))
    apart = F.array_join(F.transform(units, said), "\x00")
    return F.regexp_replace(F.regexp_replace(apart, r"(?<![^\x00])n\x00(?=[aeiouy])", "n'"), r"\x00", "")
