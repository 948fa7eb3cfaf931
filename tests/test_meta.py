"""Metadata and covers, as the reference's tests expect them."""

from pyspark.sql import functions as F

from quire.functions import meta
from quire.operators import covers
from quire.sources import epub

from .test_chapters import archive


def test_text_metadata(spark):
    rows = [("원본.txt", "새제목@새작가\n본문"), ("[가] 나.txt", ""), ("x by y.txt", "t"), ("n.txt", "\nTitle: A\n작가: B\n"), ("only.txt", None), ("뇌조_이야기_1_216.txt", "작가: 뇌조")]
    got = spark.createDataFrame(rows, "name string, text string").select(meta.text_title_author(F.col("name"), F.col("text")).alias("m")).collect()
    assert [tuple(r["m"]) for r in got] == [("새제목", "새작가"), ("나", "가"), ("x", "y"), ("A", "B"), ("only", "미상"), ("이야기 1-216", "뇌조")]


def test_captured_pages(spark):
    html = '<meta property="og:title" content="성스러운 아이돌 - 네이버 시리즈"><ul class="end_info"><li><span>글</span><span>신화진</span></li></ul><div class="ranking">글 : 비가</div>'
    plain = '<p>작가: 가나</p><div class="ranking">글 : 비가</div>'
    got = spark.createDataFrame([(html,), (plain,), ("",)], "h string").select(meta.page_title(F.col("h")).alias("t"), meta.page_author(F.col("h")).alias("a")).collect()
    assert [tuple(r) for r in got] == [("성스러운 아이돌", "신화진"), ("", "가나"), ("", "")]
    rows = spark.createDataFrame([('{"volumeNo": 2}',), ('{"volumeNo": 0, "seriesNo": "12"}',), ('{"productName": "제 3화 x"}',), ("{}",)], "j string")
    assert [r[0] for r in rows.select(meta.episode_number(F.col("j"))).collect()] == [2, 12, 3, None]
    ids = spark.createDataFrame([("123",), ("https://x/?productNo=45&a",), ("no",)], "v string")
    assert [r[0] for r in ids.select(meta.product_number(F.col("v"))).collect()] == ["123", "45", None]


def test_image_urls(spark):
    base = "https://comic.pstatic.net/"
    rows = [("k", 0, "src", base + "555.jpg?type=m101"), ("k", 1, "src", base + "777.jpg"), ("k", 2, "src", base + "123/thumbnailbig.jpg?type=m260"), ("k", 3, "raw", base + "123/thumbnailbig.jpg"), ("k", 4, "raw", "https://other.net/a.jpg"), ("k", 5, "og:image", base + "999/thumbnailbig.png")]
    got = covers.scored_image_urls(spark.createDataFrame(rows, "key string, pos int, source string, url string"), ["123"]).orderBy("place").collect()
    assert [r["url"].removeprefix(base) for r in got] == ["123/thumbnailbig.jpg", "999/thumbnailbig.png", "777.jpg"]


def test_first_episode(spark):
    rows = [("k", 0, "3화", "c"), ("k", 1, "11화", "b"), ("k", 2, "제 1 화", "a"), ("m", 0, "x", "d"), ("m", 1, "2화", "e")]
    got = covers.first_episode(spark.createDataFrame(rows, "key string, pos int, title string, url string")).collect()
    assert {r["key"]: r["url"] for r in got} == {"k": "a", "m": "e"}


def test_covers(spark):
    opf = '<package><metadata><meta name="cover" content="ci"/></metadata><manifest><item id="ci" href="img/z.png" media-type="image/png"/><item id="p" href="p.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="p"/></spine></package>'
    book = archive({"META-INF/container.xml": epub.CONTAINER.format("O/c.opf"), "O/c.opf": opf, "O/p.xhtml": '<img src="img/10.jpg"/>', "O/img/10.jpg": "x", "O/img/z.png": "x", "O/img/2.jpg": "x", "O/img/mycover.jpg": "x"})
    books = spark.createDataFrame([("b", book)], "path string, content binary")
    got = covers.candidates(epub.entries(books), epub.items(books)).orderBy("place").collect()
    assert [(r["name"], r["source"]) for r in got] == [("O/img/z.png", "opf_meta"), ("O/img/mycover.jpg", "name"), ("O/img/10.jpg", "spine_img"), ("O/img/2.jpg", "first")]
