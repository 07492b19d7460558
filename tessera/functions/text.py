"""Scalar functions of text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: One kanji or sign that stands for one.
KANJI = "[\u3400-\u9fff々〆ヶ]"
#: Names of album types.
ALBUM_TYPES = {"Full Album": "全长专辑", "Mini Album": "迷你专辑"}
_KATAKANA = "".join(chr(c) for c in range(0x30A1, 0x30F7))
_HIRAGANA = "".join(chr(c - 0x60) for c in range(0x30A1, 0x30F7))


def to_hira(x: Column) -> Column:
    return F.translate(x, _KATAKANA, _HIRAGANA)


def base_title(x: Column) -> Column:
    """Without a last "(... ver.)" or "(demo)"; full-width parentheses are part of a title."""
    return F.regexp_replace(x, r"(?iuU)\s*\((?:[^()]*ver\.?|demo)\)\s*$", "")  # fixed value: the pattern of versions


def mark_span(line: Column, start: Column, end: Column) -> Column:
    """line[:start]【line[start:end]】line[end:], 0-based and half-open."""
    return F.concat(F.substring(line, F.lit(1), start), F.lit("【"), F.substring(line, start + 1, end - start), F.lit("】"), F.substring(line, end + 1, F.length(line)))


def first_sentence(x: Column) -> Column:
    return F.get(F.split(x, r"(?<=[。！？])"), F.lit(0))


def album_type(folder: Column, spec: Column) -> Column:
    """The spec without parentheses and with known names replaced; the folder's type where there is no spec."""
    said = F.regexp_replace(spec, r"\s*\(.*?\)", "")
    for name, shown in ALBUM_TYPES.items():
        said = F.replace(said, F.lit(name), F.lit(shown))
    return F.coalesce(F.when(spec != "", said), folder)


def title_part(x: Column, last: bool = False) -> Column:
    """The first or last part of what slashes separate, trimmed."""
    return F.trim(F.element_at(F.split(x, "/"), -1 if last else 1))


def _proper(lemma: Column, surface: Column, p2: Column) -> tuple[Column, Column]:
    own = F.substring_index(F.coalesce(lemma, surface), "-", 1)
    return own, F.coalesce((p2 == "固有名詞") & own.rlike(r"^[ァ-ヺー・]+\z"), F.lit(False))


def lemma_form(lemma: Column, surface: Column, p2: Column) -> Column:
    """The lemma up to a hyphen; a proper noun's that is all katakana gives way to the surface."""
    own, proper = _proper(lemma, surface, p2)
    return F.when(proper, surface).otherwise(own)


def lemma_kana(lemma: Column, surface: Column, p2: Column, k: Column, lk: Column) -> Column:
    """The lemma's reading; where lemma_form() gives way to the surface it is the surface's, if that has one."""
    return F.when(_proper(lemma, surface, p2)[1], F.coalesce(k, lk)).otherwise(lk)


@F.pandas_udf(StringType())
def nfc(x: pd.Series) -> pd.Series:
    return x.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))
