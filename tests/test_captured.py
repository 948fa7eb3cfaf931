"""Captured pages, as the reference's tests expect them."""

from pyspark.sql import functions as F

from quire.operators import captured, covers

HOST = "https://image-comic.pstatic.net/"
PAGE = r'''
<meta property="og:image" content="https://image-comic.pstatic.net/static/noimg.jpg?type=m260">
<img src="https://image-comic.pstatic.net/novel/555/thumbnail/small.jpg?type=m260">
<img data-src="https://image-comic.pstatic.net/novel/555/11/thumbnail/thumbnail.jpg?type=m101">
<img data-original="https://image-comic.pstatic.net/novel/123/thumbnail/thumbnailbig.jpg?type=m600">
<img data-lazy="https://image-comic.pstatic.net/novel/777/thumbnail/cover.webp">
<script>window.cover = "https:\/\/image-comic.pstatic.net\/novel\/999\/thumbnail\/thumbnailbig.jpg?type=m600";</script>
<span data-original="https://image-comic.pstatic.net/novel/123/thumbnail/thumbnailbig.jpg?type=m260"></span>
'''


def test_cover_urls(spark):
    pages = spark.createDataFrame([("k", PAGE)], "key string, markup string")
    got = covers.scored_image_urls(captured.image_urls(pages), ["123"]).orderBy("place").collect()
    assert [r["url"].removeprefix(HOST + "novel/") for r in got] == ["123/thumbnail/thumbnailbig.jpg", "999/thumbnail/thumbnailbig.jpg", "555/thumbnail/small.jpg", "777/thumbnail/cover.webp"]
    bad = ["https://example.com/novel/123/cover.jpg", "//image-comic.pstatic.net/novel/123/cover.jpg", *(HOST + x for x in ("static/cover.jpg", "novel/123/noimg.jpg", "novel/123/loading.gif", "novel/123/thumb/no/cover.jpg", "novel/123/thumb/19/cover.jpg", "gnb_/logo.png", "novel/123/cover.jpg?type=m101", "novel/123/cover.txt"))]
    rows = spark.createDataFrame([("k", i, "src", u) for i, u in enumerate(bad)], "key string, pos int, source string, url string")
    assert covers.scored_image_urls(rows).collect() == []
    assert [r["url"] for r in covers.scored_image_urls(rows.filter("pos = 8"), strict=False).collect()] == [HOST + "novel/123/cover.jpg"]


def test_values(spark):
    pages = ["originalProductId: 123", 'originalProductId = "234"', '{"originalProductId": "345"}', "{'originalProductId':456}", '<div data-original-product-id="567"></div>', "none"]
    own = spark.createDataFrame([(p,) for p in pages], "m string")
    assert [r[0] for r in own.select(captured.original_product(F.col("m"))).collect()] == ["123", "234", "345", "456", "567", None]
    urls = spark.createDataFrame([("sVolumeListUrl: '/comic/list?a=1&amp;sortOrder=DESC'",), ("totalCount: 37",), ("",)], "m string")
    assert [r[0] for r in urls.select(captured.volume_list_url(F.col("m"), F.lit("novel"), F.lit("9"))).collect()] == [
        captured.BASE + "/comic/list?a=1&sortOrder=ASC",
        captured.BASE + "/novel/volumeList.series?productNo=9&totalCount=37&sortOrder=ASC",
        captured.BASE + "/novel/volumeList.series?productNo=9&totalCount=9999&sortOrder=ASC",
    ]
    kinds = spark.createDataFrame([("https://x/a.PNG?b", "image/jpeg"), ("https://x/a", "image/webp"), ("https://x/a.jpeg", None), ("https://x/a", None)], "u string, t string")
    assert [r[0] for r in kinds.select(captured.image_type(F.col("u"), F.col("t"))).collect()] == ["png", "webp", "jpg", "jpg"]
    errors = spark.createDataFrame([(403, "x"), (500, "boom"), (None, "odd")], "c int, r string")
    assert [r[0] for r in errors.select(captured.fetch_error(F.col("c"), F.col("r"))).collect()] == [captured.EXPIRED, "HTTP 오류 500: boom", "오류: odd"]


def test_volumes(spark):
    body = '{"resultData": [{"productNo": 5, "volumeNo": 1, "volumeName": "1화"}, {"productNo": 5, "volumeNo": 1}, {"productNo": "7", "seriesNo": "2", "detailPageUrlByNstoreKey": "/d?x=1"}, 3, {}]}'
    got = captured.volume_rows(spark.createDataFrame([("k", "novel", body), ("j", "novel", "no json")], "key string, category string, body string")).orderBy("pos").collect()
    assert [(r["pos"], r["number"], r["label"], r["product"], r["detail"]) for r in got] == [
        (0, 1, "1화", "5", captured.BASE + "/novel/volumeDetail.series?productNo=5"),
        (2, 2, "2화", "7", captured.BASE + "/d?x=1"),
        (4, None, captured.CHOSEN, None, None),
    ]
    page = spark.createDataFrame([("k", '<img src="a.jpg" alt="11화"><img alt="제 1 화" data-src="b.jpg?x&amp;y"><img alt="none">')], "key string, markup string")
    own = captured.episode_covers(page)
    assert [(r["title"], r["url"]) for r in own.orderBy("pos").collect()] == [("11화", "a.jpg"), ("제 1 화", "b.jpg?x&y")]
    assert covers.first_episode(own).first()["url"] == "b.jpg?x&y"
