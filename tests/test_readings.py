import json

import pytest
from pyspark.sql import functions as F

from tessera.functions.kana import display_romaji, to_romaji
from tessera.functions.text import album_type, lemma_form, title_part
from tessera.operators.readings import apply_notes, correct, highlight, segments, spoken, strip_notes
from tessera.operators.temporal import parse_timed_text

TOKEN = "array<struct<s:string,l:string,p:string,p2:string,k:string,lk:string,f:string,b:int,e:int>>"


def _tokens(*words):
    """s/p[/l[/k[/p2]]] each; a leading blank is a gap."""
    at, out = 0, []
    for w in words:
        at += len(w) - len(w.lstrip())
        s, p, l, k, p2 = (w.strip().split("/") + [""] * 4)[:5]
        out.append({"s": s, "l": l or s, "p": p, "p2": p2, "k": k or None, "lk": k or None, "f": "", "b": at, "e": at + len(s)})
        at += len(s)
    return json.dumps(out)


def _one(spark, schema, row, *cols):
    return spark.createDataFrame([row], schema).select(*cols).first()


def _on(spark, text, words, f):
    df = spark.createDataFrame([(text, _tokens(*words))], "text string, j string").select("text", F.from_json("j", TOKEN).alias("t"))
    return df.select(f(F.col("t"), F.col("text")).alias("x")).first().x


@pytest.mark.parametrize(("kana", "plain", "shown"), [
    ("りょこう", "ryokou", "ryokou"),
    ("コーヒー", "koohii", "koohii"),
    ("きっぷ", "kippu", "kippu"),
    ("パーティー", "paatii", "paatii"),
    ("フォーク", "fooku", "fooku"),
    ("みずを", "mizuwo", "mizuwo"),
    ("まっちゃ", "maccha", "matcha"),
    ("れんあい", "renai", "ren'ai"),
    ("ほんや。", "honya。", "hon'ya."),
    ("っ", "", ""),
    ("猫とX", "猫toX", "猫toX"),
    ("", "", ""),
    (None, None, None),
])
def test_romaji(spark, kana, plain, shown):
    got = _one(spark, "x string", (kana,), to_romaji(F.col("x")).alias("a"), display_romaji(F.col("x")).alias("b"))
    assert (got.a, got.b) == (plain, shown)


def test_old_kana_with_glides(spark):
    assert _one(spark, "x string", ("ゐゃゑいぇ",), to_romaji(F.col("x")).alias("a")).a == "yaee"


def test_words_stay_apart(spark):
    assert _one(spark, "x string", ("ほん あい",), display_romaji(F.col("x")).alias("a")).a == "hon ai"


def test_notes(spark):
    got = _one(spark, "x string", ("夜(よる)と星空(ほしぞら)だ",), strip_notes(F.col("x")).alias("a")).a
    assert got.text == "夜と星空だ" and [tuple(n) for n in got.notes] == [(0, 1, "よる"), (2, 4, "ほしぞら")]
    assert _one(spark, "x string", ("かな",), strip_notes(F.col("x")).alias("a")).a.notes == []


def _noted(spark, text, words, *notes):
    array = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(e).alias("e"), F.lit(k).alias("k")) for b, e, k in notes))
    return [(t.s, t.k, t.p) for t in _on(spark, text, words, lambda t, x: apply_notes(t, array, x))]


def test_notes_on_tokens(spark):
    assert _noted(spark, "夜が", ["夜/名詞", "が/助詞"], (0, 1, "よる")) == [("夜", "よる", "名詞"), ("が", None, "助詞")]
    assert _noted(spark, "開いた", ["開い/動詞", "た/助動詞"], (0, 1, "あ"))[0] == ("開い", "あい", "動詞")
    assert _noted(spark, "山桜花が", ["山/名詞", "桜/名詞", "花/名詞", "が/助詞"], (0, 2, "やまざくら")) == [("山桜", "やまざくら", "名詞"), ("花", None, "名詞"), ("が", None, "助詞")]
    assert _noted(spark, "夜空", ["夜空/名詞"], (0, 1, "よる")) == [("夜空", None, "名詞")]


def test_corrections(spark):
    fixes = [{"tok": {"s": "開い"}, "k": "あい"}, {"tok": {"s": "金", "next": {"s": "が"}}, "l": "金", "k": "かね"}, {"tok": {"s": "金"}, "k": "きん"}]
    got = _on(spark, "開い金が", ["開い/動詞/開く/ひらい", "金/名詞/キン", "が/助詞"], lambda t, x: correct(t, x, fixes))
    assert [(t.l, t.k, t.lk) for t in got] == [("開く", "あい", "あく"), ("金", "かね", None), ("が", None, None)]
    gated = [{"tok": {"s": "が"}, "line": "無", "p": "x"}]
    assert [t.p for t in _on(spark, "金が", ["金/名詞", "が/助詞"], lambda t, x: correct(t, x, gated))] == ["名詞", "助詞"]


def test_segments(spark):
    words = ["忘れ/動詞/忘れる/わすれ", "て/助詞/て//接続助詞", "いる/動詞", "だろう/助動詞/だ", " 夜/名詞/夜/よる", "は/助詞", "。/補助記号"]
    text = "忘れているだろう 夜は。…"
    segs = _on(spark, text, words, lambda t, x: segments(x, t))
    assert segs == [[["忘れ", "わすれ", "v", "忘れる", "わすれ"], ["て", "", "p"]], [["いる", "", "v"]], [["だろう", "", "aux", "だ"]], [[" "]], [["夜", "よる", "n"]], [["は", "わ", "p"]], [["。"]], [["…"]]]
    assert "".join(t[0] for seg in segs for t in seg) == text
    assert _on(spark, text, words, lambda t, x: spoken(segments(x, t))) == "わすれて いる だろう よる わ 。 …"


def test_small_functions(spark):
    got = _one(spark, "x string", ("ab漢",), highlight(F.col("x"), F.array(F.struct(F.lit(0).alias("s"), F.lit(1).alias("e"))), F.array(F.struct(F.lit(0).alias("s"), F.lit(2).alias("e")))).alias("h"), album_type(F.lit("EP"), F.lit("1st Full Album (CD)")).alias("t"), album_type(F.lit("EP"), F.lit(None).cast("string")).alias("u"), title_part(F.lit("a / b"), True).alias("p"), lemma_form(F.lit("コダイラ"), F.lit("小平"), F.lit("固有名詞")).alias("l"), lemma_form(F.lit("為る-他"), F.lit("し"), F.lit("")).alias("m"))
    assert got.h == ["a", "b", ""] and (got.t, got.u, got.p, got.l, got.m) == ("1st 全长专辑", "EP", "b", "小平", "為る")


def test_titles_and_credits_go(spark):
    files = spark.createDataFrame([("p", "[00:01.5]Band - Song\n[00:02]演唱：x\n[00:03]Song - Band\n[00:04]Band sings")], "path string, value string")
    assert [r.text for r in parse_timed_text(files, ("Band",)).collect()] == ["Band sings"]
