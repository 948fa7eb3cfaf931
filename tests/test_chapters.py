"""Chapters, series and pages, as the reference's tests expect them."""

import io
import random
import zipfile

from pyspark.sql import functions as F

from quire.functions import segmenting
from quire.functions import text as T
from quire.operators import chapters, nav, pages, series
from quire.sources import epub


def book(spark, titles, lines=None):
    rows = [("d", i, t, (lines or {}).get(i, ["body"])) for i, t in enumerate(titles)]
    return spark.createDataFrame(rows, "doc string, pos int, title string, lines array<string>")


def titles(df):
    return [r["title"] for r in df.orderBy("pos").collect()]


def test_detect(spark):
    docs = spark.createDataFrame([("a", "1화\n첫 문장\n2화\n둘째 문장"), ("b", "작품명@작가명\n소개 문장\n1화\n본문"), ("c", "no heads\nhere"), ("e", None), ("f", "")], "doc string, text string")
    got = {}
    for r in chapters.detect(docs).orderBy("doc", "pos").collect():
        got.setdefault(r["doc"], []).append((r["title"], r["lines"]))
    assert got == {"a": [("1화", ["첫 문장"]), ("2화", ["둘째 문장"])], "b": [("1화", ["본문"])], "c": [("본문", ["no heads", "here"])], "f": [("본문", [])]}


def test_numbers(spark):
    rows = spark.createDataFrame([("175.The Oprah",), ("3.6kg is body text",), ("제 12 화 x",), ("# 7 y",), ("x 9화",), (None,)], "t string")
    assert [r[0] for r in rows.select(chapters.number(F.col("t"))).collect()] == [175, None, 12, 7, None, None]


def test_ascending(spark):
    got = chapters.keep_ascending(book(spark, ["1.", "2.", "99.", "3.", "4."])).orderBy("pos").collect()
    assert [r["title"] for r in got] == ["1.", "2.", "3.", "4."] and got[1]["lines"] == ["body", "<b>99.</b>", "body"]


def test_ascending_is_the_quadratic_one():
    def slow(nums):
        length, back = [1] * len(nums), [-1] * len(nums)
        for i in range(len(nums)):
            for j in range(i):
                if nums[j] < nums[i] and length[j] + 1 > length[i]:
                    length[i], back[i] = length[j] + 1, j
        at, out = max(range(len(nums)), key=lambda i: length[i]), []
        while at >= 0:
            out.append(at)
            at = back[at]
        return out[::-1]

    r = random.Random(3)
    for _ in range(300):
        nums = [r.randrange(12) for _ in range(r.randrange(1, 25))]
        assert segmenting.ascending(nums) == slow(nums)


def test_suspects(spark):
    own = book(spark, ["1.", "#TAG", "2.", "4.", "3.", "5."])
    assert [(r["pos"], r["kind"], r["auto_merge"]) for r in chapters.suspects(own).orderBy("pos").collect()] == [(1, "flow", True), (3, "gap", False), (4, "order", True), (5, "gap", False)]
    assert titles(chapters.merge_suspects(own)) == ["1.", "2.", "4.", "5."]


def test_flow_noise(spark):
    own = book(spark, ["108.", "109.", "1.", "0.1%", "1.", "114.", "115."])
    assert titles(chapters.keep_ascending(chapters.absorb_interruptions(own))) == ["108.", "109.", "114.", "115."]
    noisy = chapters.keep_ascending(book(spark, ["1.", "2.", "0.1%", "3.", "이야기 3화 끝", "4.", "에필로그"])).orderBy("pos").collect()
    assert [r["title"] for r in noisy] == ["1.", "2.", "3.", "4.", "에필로그"] and noisy[1]["lines"] == ["body", "<b>0.1%</b>", "body"]


def test_low_runs(spark):
    own = book(spark, ["10.", "1.", "2.", "11.", "12."])
    assert titles(chapters.absorb_low_runs(own)) == ["10.", "11.", "12."]


def test_styles(spark):
    assert titles(chapters.with_style(book(spark, ["1화 가", "2. 나", "3화"]))) == ["1화 가", "2화 나", "3화"]
    assert titles(chapters.without_subtitles(book(spark, ["1화 가", "2. 나", "plain"]))) == ["1.", "2.", "plain"]


def test_merge_short(spark):
    own = book(spark, ["1화", "note", "2화"], {0: ["long body"], 1: ["s"], 2: ["x"]})
    assert [(r["title"], r["lines"]) for r in chapters.merge_short(own, 5).orderBy("pos").collect()] == [("1화", ["long body", "<b>note</b>", "s"]), ("2화", ["x"])]
    own = book(spark, ["n", "1화", "First meeting", "2."], {0: ["s"], 1: ["long body"], 2: [], 3: ["x" * 9]})
    assert [(r["title"], r["lines"]) for r in chapters.merge_short(own, 5).orderBy("pos").collect()] == [("n 1화", ["s", "<b>1화</b>", "long body"]), ("First meeting 2.", ["x" * 9])]


def test_gap_recovery(spark):
    own = book(spark, ["1.", "2.", "4.", "5."], {1: ["two", "3. three", "still three"]})
    got = chapters.fill_gaps(own).orderBy("pos").collect()
    assert [(r["title"], r["lines"]) for r in got] == [("1.", ["body"]), ("2.", ["two"]), ("3. three", ["still three"]), ("4.", ["body"]), ("5.", ["body"])]
    docs = spark.createDataFrame([("d", "2화. 부제\n")], "doc string, text string")
    assert titles(chapters.restored_titles(book(spark, ["1.", "2."]), docs)) == ["1.", "2. 부제"]
    assert titles(chapters.numbered_titles(chapters.without_angles(book(spark, ["3. <다음>", "시작 001 : 가"])))) == ["3. 다음", "1. 가"]


def test_gaps(spark):
    rows = spark.createDataFrame([(1, 2), (1, 5), (1, 5), (2, 1), (2, 2)], "k int, n int")
    assert sorted(map(tuple, chapters.gaps(rows, ["k"], "n").collect())) == [(1, 3), (1, 4)]


def test_series(spark):
    names = ["버림받은 황비 1.epub", "버림 받은 황비 2.epub", "혼자 있는 책.epub", "어떤 시리즈 1-1.epub", "어떤 시리즈 1-2.epub"]
    own = spark.createDataFrame(list(enumerate(names)), "pos int, name string")
    got = series.canonical(series.with_group(own, series.series_key(F.col("name"))))
    assert sorted((r["key"], r["members"]) for r in got.collect()) == [("버림받은 황비", 2), ("어떤 시리즈", 2), ("혼자 있는 책", 1)]


def test_alike_series(spark):
    rows = [("[간절히] 조선, 봉황이 포효하다", 2, 0), ("[간절히] 조선, 봉황이 포효한다", 1, 1), ("[다른] 조선, 봉황이 포효하다", 1, 2)]
    own = spark.createDataFrame([(k, k, n, i) for k, n, i in rows], "norm string, key string, members long, first int")
    assert {r["key"]: r["into"] for r in series.merge_alike(own).collect()} == {rows[0][0]: rows[0][0], rows[1][0]: rows[0][0], rows[2][0]: rows[2][0]}


def test_authors(spark):
    own = spark.createDataFrame([(1, 0, "조병래"), (1, 1, "너와같은꿈"), (1, 2, "조경래"), (2, 0, "가"), (2, 1, "가나"), (3, 0, "")], "k int, pos int, author string")
    assert {r["k"]: r["author"] for r in series.majority_author(own, ["k"]).collect()} == {1: "조경래", 2: "가나"}


def test_natural_sort(spark):
    names = ["너희들은 변호됐다 29권 (완결)", "너희들은 변호됐다 17권(2부)", "너희들은 변호됐다 8권"]
    own = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r["name"] for r in own.orderBy(series.natural_sort(F.col("name"))).collect()] == names[::-1]


def test_page_rules(spark):
    rows = [("book_info.xhtml", "<p>지은이 : 가</p><p>펴낸곳 : 나</p>"), ("chapter_0.xhtml", "<img src='a.jpg'/>"), ("toc.xhtml", "<p>목차</p>"), ("x.xhtml", "<p>story</p>"), ("toc_page.xhtml", "<p>story</p>")]
    got = {r["path"]: r["reason"] for r in pages.classified(spark.createDataFrame(rows, "path string, markup string")).collect()}
    assert got == {"book_info.xhtml": "copyright", "chapter_0.xhtml": "cover", "toc.xhtml": "index", "x.xhtml": None, "toc_page.xhtml": None}


def test_images(spark):
    markup = '<img src="My%20Cover.JPG?width=900#frag"/><image xlink:href="../plate 01.png"/><style>p{background:url(bg%20one.webp)}</style>'
    refs = pages.image_refs(spark.createDataFrame([(1, markup)], "book int, markup string"), "book", "markup")
    assert {r["name"] for r in refs.collect()} == {"my cover.jpg", "plate 01.png", "bg one.webp"}
    manifest = [(1, "cover-image", "cover.jpg", "image/jpeg"), (1, "used", "used.png", "image/png"), (1, "unused", "unused.gif", "image/gif"), (1, "chapter", "c.xhtml", "application/xhtml+xml"), (1, "style", "s.css", "text/css")]
    plan = pages.prune_plan(spark.createDataFrame(manifest, "book int, id string, href string, media_type string"), spark.createDataFrame([(1, "used.png")], "book int, name string"))
    assert [(r["id"], r["name"], r["removable"]) for r in plan.collect()] == [("unused", "unused.gif", True)]


def test_volume_plan(spark):
    own = spark.createDataFrame([(1, 0, "작품 1권 1화"), (1, 1, "작품 1권 2화"), (1, 2, "작가 후기")], "k int, pos int, stem string")
    plan = nav.volume_plan(own)
    assert [(r["volume"], r["chapter"], r["grouped"]) for r in plan.orderBy("pos").collect()] == [(1, 1, True), (1, 2, True), (None, None, False)]
    assert nav.use_grouping(plan, ["k"]).first()["use_grouping"]


def test_text_functions(spark):
    row = spark.createDataFrame([("제목\n본문".encode("cp949"), "제목\n본문".encode("utf-16"), "제목".encode())], "a binary, b binary, c binary")
    assert tuple(row.select(*(T.decoded(F.col(c)) for c in "abc")).first()) == ("제목\n본문", "제목\n본문", "제목")
    one = spark.range(1).select(T.clean_lines(F.lit("\n a  b \r\nSection_01.xhtml\n\n\n c\n")).alias("a"), T.without_invisible(F.lit("A​B")).alias("b"), T.human_size(F.lit(2048)).alias("c"), T.safe_filename(F.lit('a/b:c. ')).alias("d")).first()
    assert tuple(one) == ("a b\n\nc", "AB", "2.0 KB", "a_b_c")


def archive(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return out.getvalue()


def test_epub(spark):
    opf = '<package><metadata><dc:title>Vol</dc:title><dc:creator>Me</dc:creator></metadata><manifest><item id="b" href="second.xhtml" media-type="application/xhtml+xml"/><item id="a" href="first.xhtml" media-type="application/xhtml+xml"/><item id="c" href="copyright.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="a"/><itemref idref="c"/><itemref idref="b"/></spine></package>'
    ncx = '<ncx><navMap><navPoint><navLabel><text><![CDATA[Chapter & One]]></text></navLabel><content src="first.xhtml#x"/></navPoint></navMap></ncx>'
    good = archive({"mimetype": "application/epub+zip", "META-INF/container.xml": epub.CONTAINER.format("O/c.opf"), "O/c.opf": opf, "O/toc.ncx": ncx, "O/first.xhtml": "<p>A​B<br/>C</p>", "O/second.xhtml": "<p>two &amp; more</p>", "O/copyright.xhtml": "<p>c</p>"})
    books = spark.createDataFrame([("g", good), ("bad", b"no zip")], "path string, content binary")
    assert [(r["name"], r["text"]) for r in epub.sections(books).orderBy("pos").collect()] == [("O/first.xhtml", "AB\nC"), ("O/second.xhtml", "two & more")]
    assert [r["label"] for r in epub.labels(epub.entries(books)).collect()] == ["Chapter & One"]
    found = epub.items(books).collect()
    assert {r["title"] for r in found if r["error"] is None} == {"Vol"} and sum(r["error"] is not None for r in found) == 1
    meta = spark.createDataFrame([("d", "Book", "Me", "u1")], "doc string, title string, author string, uid string")
    made = epub.built(book(spark, ["1화", "2화"]), meta).select(F.col("doc").alias("path"), "content")
    assert [r["text"] for r in epub.sections(made).orderBy("pos").collect()] == ["1화 1화\nbody", "2화 2화\nbody"]
