import json
import random

from pyspark.sql import functions as F

from tessera.functions.arrays import sums_before
from tessera.functions.text import first_sentence, lemma_form, lemma_kana
from tessera.operators import merge, temporal
from tessera.operators.library import create_own_view
from tessera.operators.sequence import lexicon_matches
from tessera.sources import ingest, library
from tessera.sources.mart import tagged_lines


def test_sums(spark):
    rows = [([random.Random(n).randrange(9) for _ in range(n)],) for n in (0, 1, 2, 63, 64, 65, 500)]
    got = spark.createDataFrame(rows, "x array<int>").select("x", sums_before(F.col("x")).alias("y")).collect()
    assert all(list(r.y) == [sum(r.x[:i]) for i in range(len(r.x))] for r in got) and len(got) == 7


def test_mart(spark, tmp_path):
    tok = lambda s, l, b, **more: {"s": s, "l": l, "p": "n", "i": [b, b + len(s)], **more}
    song = lambda i, *lines: {"id": i, "album": "al", "ja": f"song {i}", "zh": "z", "lines": [{"t": 1000 * k, "ja": ja, "zh": "", "tok": t, **({"gram": g} if g else {})} for k, (ja, t, g) in enumerate(lines)]}
    one = song("s1", ("a bb a", [tok("a", "a", 0, k="x"), tok("bb", "b", 2), tok("a", "a", 5)], [["g1", 0, 4]]), ("none", [], None))
    two = song("s2", ("bb", [tok("bb", "b", 0)], None))
    catalog = {"bands": [{"id": "x", "ja": "X", "zh": "Y"}], "albums": [{"id": "al", "band": "x", "ja": "A", "zh": "B", "year": "2020.01", "type": "t", "note": "", "done": True}, {"id": "am", "band": "x", "ja": "A", "zh": "B", "year": "2021"}], "songs": [{"id": "s1", "album": "al", "ja": "song s1", "zh": "z", "track": 1}, {"id": "s2", "album": "al", "ja": "song s2", "zh": "z", "dup_of": "s1"}]}
    lexicon = [{"w": "wa", "k": "k", "r": "r", "m": "m", "match": ["a", [{"l": "a"}, {"l": "b"}], {"re": "b+"}]}, {"w": "wb", "match": ["b", "a"], "ex": ["1", "2", "3"]}]
    grammar = [{"id": "g1", "g": "p", "r": "r", "m": "m", "ex": ["1", "2", "3"], "rule": {"re": "x"}}]
    for name, x in (("songs/s1", one), ("songs/s2", two), ("catalog", catalog), ("lemmas", lexicon), ("grammar", grammar), ("names", {"a": "note"})):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / f"{name}.json").write_text(json.dumps(x, indent=1))
    read = lambda name, kind: library.read_json(spark, f"file://{tmp_path}/{name}", kind)
    tables = library.mart(read("songs", "song"), read("catalog.json", "catalog"), read("lemmas.json", "lexicon"), read("grammar.json", "grammar"))
    rows = {k: sorted(map(str, map(tuple, v.collect()))) for k, v in tables.items()}
    hits = {tuple(r) for r in tables["entry_hits"].collect()}
    assert hits == {("wa", "s1", 0, 0, 1), ("wa", "s1", 0, 2, 4), ("wa", "s1", 0, 5, 6), ("wa", "s2", 0, 0, 2), ("wb", "s1", 0, 0, 1), ("wb", "s1", 0, 2, 4), ("wb", "s1", 0, 5, 6), ("wb", "s2", 0, 0, 2)}
    assert rows["grammar_hits"] == ["('g1', 's1', 0, 0, 4)"] and len(rows["tokens"]) == 4 and len(rows["lines"]) == 3 and rows["known"] == []
    assert [tuple(r) for r in tables["albums"].select("id", "done").orderBy("id").collect()] == [("al", True), ("am", False)]
    assert [tuple(r) for r in tables["entries"].orderBy("w").collect()][1] == ("wb", None, None, None, "1", "2", "3")
    library.register(tables)
    assert [r.id for r in spark.sql("SELECT id FROM counted_songs").collect()] == ["s1"]
    assert {tuple(r) for r in spark.table("lemma_song_counts").collect()} == {("a", "n", "s1", 2), ("b", "n", "s1", 1)}
    library.write_mart(tables, f"file://{tmp_path}/mart")
    assert sorted(map(str, map(tuple, spark.read.parquet(f"file://{tmp_path}/mart/tokens").collect()))) == rows["tokens"]
    library.write_json(library.picked(tables["songs"], {"id": "id", "album": "on", "nothing": "x", "dup_of": "dup_of"}).coalesce(1), f"file://{tmp_path}/out")
    assert [json.loads(x) for f in (tmp_path / "out").glob("part-*") for x in f.read_text().splitlines()] == [{"id": "s1", "on": "al"}, {"id": "s2", "on": "al", "dup_of": "s1"}]
    whole = library.document(songs=tables["songs"].select(F.col("id").alias("ord"), "id"), bands=tables["bands"].select(F.lit(1).alias("ord"), "zh")).first().value
    assert json.loads(whole) == {"songs": [{"id": "s1"}, {"id": "s2"}], "bands": [{"zh": "Y"}]}
    assert library.read_names(spark, f"file://{tmp_path}/names.json").first() == ("a", "note")


def test_no_entries(spark):
    df = spark.createDataFrame([("x", [])], "j string, t array<struct<s:string,l:string,b:int,e:int>>")
    assert df.select(lexicon_matches(F.col("j"), F.col("t"), {}).alias("x")).first().x == []


def test_copies_of_files(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, content string")
    new = spark.createDataFrame([("a", "1"), ("b", "3"), ("c", "4")], "path string, content string")
    written, kept = library.conditional_copy(new, old)
    assert sorted(r.path for r in written.collect()) == ["a", "c"] and [r.path for r in kept.collect()] == ["b"]
    written, kept = library.conditional_copy(new, old, force=True)
    assert written.count() == 3 and kept.count() == 0


def test_versions_and_existing_songs(spark):
    songs = spark.createDataFrame([("s1", "b", 1, 2, "Moon"), ("s2", "b", 2, 1, "Moon (Live Ver.)"), ("s3", "b", 1, 1, "Moon (demo)"), ("s4", "c", 0, 1, "Moon"), ("s5", None, 0, 1, "x")], "id string, band string, album_ord int, track int, title string")
    assert {r.id: r.dup_of for r in ingest.first_versions(songs).collect()} == {"s1": "s3", "s2": "s3", "s3": None, "s4": None, "s5": None}
    known = spark.createDataFrame([("s1", "al", "New", "Old"), ("s2", "al", "Same", None)], "id string, album string, title string, lib_title string")
    files = spark.createDataFrame([("al", "Old"), ("al", "New"), ("al", "Same"), ("al", "Other"), ("am", "New")], "album string, title string")
    got = {(r.album, r.title): (r.song, r.renamed) for r in ingest.existing_songs(files, known).collect()}
    assert got == {("al", "Old"): ("s1", True), ("al", "New"): ("s1", False), ("al", "Same"): ("s2", False), ("al", "Other"): (None, False), ("am", "New"): (None, False)}


def test_background(spark):
    text = "t\n# 《名 (Title / 月 )》x\n**专辑规格**：Full Album (12 tracks) \n## 一、背景\n\n 第一句。第二句。\nrest\n| **1. Song** | **歌 / x** | y |\n| **2. B** | **乙** |\n| **3. Song** | **丙** |\n"
    got = spark.createDataFrame([(text,), ("",), (None,)], "x string").select(ingest.background(F.col("x")).alias("b")).collect()
    assert tuple(got[0].b)[:3] == ("月", "Full Album (12 tracks)", "第一句。") and got[0].b.titles == {"Song": "丙", "B": "乙"}
    assert tuple(got[1].b) == (None, None, None, {}) and not got[2].b.titles


def test_moments_and_lines(spark):
    rnd = random.Random(3)
    moments = [(rnd.choice("ab"), rnd.randrange(60)) for _ in range(60)] + [("a", 7)] * 3 + [("z", 5), (None, 5), ("a", None)]
    lines = [(rnd.choice("ab"), rnd.randrange(60), o, f"l{o}") for o in range(40)]
    m = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(moments)], "k string, at int, id int")
    l = spark.createDataFrame(lines, "k string, t int, ord int, text string")
    got = {r.id: r.text for r in temporal.current_line(m, l, "k", bucket=7).collect()}
    best = lambda k, t: max(((x[1], x[2], x[3]) for x in lines if t is not None and x[0] == k and x[1] <= t), default=(0, 0, None))[2]
    assert got == {i: best(k, t) for i, (k, t) in enumerate(moments)}
    got = {r.ord: r.ms for r in temporal.line_durations(l, "k", "ord", 12).collect()}
    order = sorted(lines, key=lambda x: x[:3])
    after = {a[2]: min(b[1] - a[1], 12) if b[0] == a[0] else 12 for a, b in zip(order, [*order[1:], (None, 0)], strict=True)}
    assert got == after


def test_odd_stamps(spark):
    rows = spark.createDataFrame([("[01:02.5]",), ("[oops]",), ("",), (None,), ("[1:2.12345]",)], "x string")
    assert [r.y for r in rows.select(temporal.stamp_ms(F.col("x")).alias("y")).collect()] == [62500, None, None, None, 62123]


def test_marks_are_stripped_in_turn(spark):
    files = spark.createDataFrame([("f", "[00:01.0] \u200b x \u200b \n[00:02.0]\u200b \u200by\n[00:03.0]\u200b \u200b")], "path string, value string")
    assert [r.text for r in temporal.parse_timed_text(files).orderBy("ord").collect()] == ["x", "\u200by"]


class Device:
    """A device that holds its own progress and what the cloud held when they last met."""

    def __init__(self, spark):
        self.spark, self.learned, self.base = spark, set(), None

    def sync(self, cloud):
        df = lambda x: self.spark.createDataFrame([(w,) for w in x], "w string")
        if self.base is None:
            merged = cloud | self.learned
        else:
            merged = {r.w for r in merge.three_way_learned(df(cloud), df(self.learned), df(self.base), ["w"]).collect()}
        self.learned, self.base = set(merged), set(merged)
        return merged


def test_two_devices_converge(spark):
    rnd = random.Random(5)
    a, b, cloud = Device(spark), Device(spark), set()
    a.learned = {"w1"}
    b.learned = {"w3"}
    cloud = b.sync(a.sync(cloud))
    assert cloud == {"w1", "w3"}  # the first sync of each is a union
    for _ in range(4):
        for d in (a, b):
            for _ in range(2):
                w = f"w{rnd.randrange(6)}"
                (d.learned.discard if w in d.learned else d.learned.add)(w)
        cloud = a.sync(cloud)
        cloud = b.sync(cloud)
        cloud = a.sync(cloud)
        assert a.learned == b.learned == cloud
    gone = rnd.choice(sorted(a.learned))
    a.learned.discard(gone)
    assert gone not in b.sync(a.sync(cloud))


def test_reviews_of_two_devices(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "w string, box int, due int")
    base = df(("same", 1, 5), ("mine", 1, 5), ("theirs", 1, 5), ("both", 1, 5), ("gone", 1, 5), ("tie", 0, 1))
    local = df(("same", 1, 5), ("mine", 2, 9), ("theirs", 1, 5), ("both", 2, 7), ("new", 0, 1), ("tie", 2, 6))
    cloud = df(("same", 1, 5), ("mine", 1, 5), ("theirs", 3, 20), ("both", 0, 8), ("gone", 1, 5), ("far", 4, 4), ("tie", 1, 6))
    got = {tuple(r) for r in merge.three_way_srs(cloud, local, base, ["w"], "box", "due").collect()}
    assert got == {("same", 1, 5), ("mine", 2, 9), ("theirs", 3, 20), ("both", 0, 8), ("new", 0, 1), ("far", 4, 4), ("tie", 2, 6)}


def test_taggers(spark):
    def tagger():
        return lambda line: [{"s": w, "p": "n", "l": w.lower()} if w[0].isupper() else {"s": w} for w in line.split()]

    df = spark.createDataFrame([(1, "Ab  cd Ab"), (2, None), (3, "")], "doc_id long, line string")
    got = {r.doc_id: [(t.s, t.l, t.p, t.b, t.e) for t in r.tok] for r in tagged_lines(df, tagger).collect()}
    assert got == {1: [("Ab", "ab", "n", 0, 2), ("cd", "cd", None, 4, 6), ("Ab", "ab", "n", 7, 9)], 2: [], 3: []}


def test_small_functions(spark):
    row = spark.createDataFrame([("一。二！三", "コダイラ", "小平", "固有名詞", "こだいら", "x")], "t string, l string, s string, p2 string, k string, lk string")
    f = row.select(first_sentence(F.col("t")).alias("a"), lemma_form(F.col("l"), F.col("s"), F.col("p2")).alias("b"), lemma_kana(F.col("l"), F.col("s"), F.col("p2"), F.col("k"), F.col("lk")).alias("c"), lemma_kana(F.col("l"), F.col("s"), F.lit(None).cast("string"), F.col("k"), F.col("lk")).alias("d"))
    assert tuple(f.first()) == ("一。", "小平", "こだいら", "x")


def test_own_view(spark):
    me = spark.sql("SELECT current_user() AS u").first().u
    spark.createDataFrame([(me, 1), ("other", 2)], "user_id string, x int").createOrReplaceTempView("progress")
    for _ in range(2):
        create_own_view(spark, "progress", "my_progress")
    assert [tuple(r) for r in spark.table("my_progress").collect()] == [(me, 1)]
