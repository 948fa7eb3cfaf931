"""Merged and cleaned books, as the reference's tests expect them."""

import io
import zipfile
from xml.etree import ElementTree as ET

from pyspark.sql import functions as F

from quire.functions import navigation as N
from quire.operators import titles
from quire.sources import books, epub

from .test_chapters import archive

NS = {"n": N.NCX}


def volume(text):
    opf = '<package><metadata><dc:title>x</dc:title></metadata><manifest><item id="b" href="body.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/></spine></package>'
    return archive({"mimetype": "application/epub+zip", "META-INF/container.xml": epub.CONTAINER.format("OEBPS/content.opf"), "OEBPS/content.opf": opf, "OEBPS/body.xhtml": text})


def opened(content):
    return zipfile.ZipFile(io.BytesIO(bytes(content)))


def test_merge(spark):
    rows = [("a", 0, "Bundle", "One", volume("<h1>1화 가</h1>")), ("a", 1, "Bundle", "Two", volume("<h1>2화 나​</h1>"))]
    own = spark.createDataFrame(rows, "book string, pos int, title string, label string, content binary")
    row = books.merged(own).first()
    assert (row["books"], row["pages"], row["warnings"]) == (2, 2, [])
    z = opened(row["content"])
    assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
    opf, ncx = z.read("OEBPS/content.opf").decode(), ET.fromstring(z.read("OEBPS/toc.ncx"))
    assert 'href="Text/vol001_0001.xhtml"' in opf and 'href="Text/vol002_0001.xhtml"' in opf and "​" not in z.read("OEBPS/Text/vol002_0001.xhtml").decode()
    assert [x.text for x in ncx.findall(".//n:navPoint/n:navLabel/n:text", NS)] == ["One", "Two"]
    items = epub.items(books.merged(own).select(F.col("book").alias("path"), "content")).filter("spine is not null").orderBy("spine").collect()
    assert [x["id"] for x in items] == ["item0001", "item0002"] and items[0]["title"] == "Bundle"
    nested = opened(books.merged(own, nested=True, contents=True, cover=b"x").first()["content"])
    ncx = ET.fromstring(nested.read("OEBPS/toc.ncx"))
    assert [[y.find("n:navLabel/n:text", NS).text for y in x.findall("n:navPoint", NS)] for x in ncx.findall("n:navMap/n:navPoint", NS)] == [["1화 가"], ["2화 나"]]
    assert "OEBPS/Images/cover.jpg" in nested.namelist() and 'href="vol001_0001.xhtml"' in nested.read("OEBPS/Text/contents.xhtml").decode()


def test_documents():
    entry = N.Entry('chapter "one"', "A&B <C>", "Text/c.xhtml#h1", 3, (N.Entry("x", "1화", "y.xhtml", 4),))
    ncx = N.navigation("AT&T <Novel>", "urn:x", [entry])
    root = ET.fromstring(ncx.split("\n", 1)[1])
    assert root.find("n:docTitle/n:text", NS).text == "AT&T <Novel>" and '<meta name="dtb:depth" content="2" />' in ncx
    point = root.find("n:navMap/n:navPoint", NS)
    assert (point.get("id"), point.get("playOrder"), point.find("n:content", NS).get("src"), point.find("n:navPoint", NS).get("playOrder")) == ('chapter "one"', "3", "Text/c.xhtml#h1", "4")
    page = N.contents_page([entry])
    assert page.startswith(N.XHTML_HEAD) and '<li><a href="Text/c.xhtml#h1">A&amp;B &lt;C&gt;</a><ul><li><a href="y.xhtml">1화</a></li></ul></li>' in page
    opf = N.package("작품 1-3권", "u", [N.Item("a b", "x.xhtml", N.PAGE_TYPE), N.Item(N.COVER, "Images/c.jpg", "image/jpeg")], ["a b"], creator="나&너")
    assert 'idref="a_b"' in opf and 'content="작품"' in opf and "나&amp;너" in opf and 'type="cover"' in opf
    assert "guide" not in N.package("", "u", [], [])
    assert N.creator_of("[작가] 작품") == "작가" and N.creator_of("작품", "_작가__작품") == "작가" and N.creator_of("작품") == ""


def test_volume_entries():
    entries = N.volume_entries([("머리말", "a")], {2: [(4, "작품 2권 4화", "e")], 1: [(2, "작품 1권 2화", "c"), (1, "작품 1권 1화", "b")]})
    assert [(e.id, e.label, e.src, e.order) for e in entries] == [("book001", "머리말", "a", 1), ("book002", "작품 1권", "b", 2), ("book005", "작품 2권", "e", 5)]
    assert [(c.id, c.label, c.src, c.order) for c in entries[1].children] == [("book003", "1화", "b", 3), ("book004", "2화", "c", 4)]
    assert N.book_entry("작품 1권", "Text/v1.xhtml", [("item-1", "Text/v1.xhtml", ""), ("item-2", "Text/chapter2.xhtml", "2화"), ("item-3", "Text/chapter3.xhtml", "3화")], 4, 9) == N.Entry("book004", "작품 1권", "Text/v1.xhtml", 9, (N.Entry("book004_item-2", "2화", "Text/chapter2.xhtml", 10), N.Entry("book004_item-3", "3화", "Text/chapter3.xhtml", 11)))
    assert N.flat_label("작품", 3) == "작품 3화" and N.flat_label("작품 2화", 3) == "작품 2화"


def test_cleanup(spark):
    opf = '<package><metadata><meta name="book-token" content="t"/></metadata><manifest><item id="body" href="body.xhtml" media-type="application/xhtml+xml"/><item id="copy" href="copyright.xhtml" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="copy"/><itemref idref="body"/></spine></package>'
    good = archive({"mimetype": "application/epub+zip", "META-INF/container.xml": epub.CONTAINER.format("OEBPS/content.opf"), "OEBPS/content.opf": opf, "OEBPS/body.xhtml": "<p>A​B</p>", "OEBPS/copyright.xhtml": "<p>c</p>"})
    rows = {r["path"]: r for r in books.cleaned(spark.createDataFrame([("g", good), ("bad", b"no")], "path string, content binary")).collect()}
    assert [tuple(x) for x in rows["g"]["removed"]] == [("copyright.xhtml", "copyright")] and rows["g"]["characters"] == 1 and rows["bad"]["error"] and bytes(rows["bad"]["content"]) == b"no"
    z = opened(rows["g"]["content"])
    text = z.read("OEBPS/content.opf").decode()
    assert z.infolist()[0].filename == "mimetype" and "OEBPS/copyright.xhtml" not in z.namelist() and z.read("OEBPS/body.xhtml") == b"<p>AB</p>"
    assert "book-token" not in text and "copyright.xhtml" not in text and 'idref="copy"' not in text and 'idref="body"' in text
    stamped = opened(books.stamped(spark.createDataFrame([("g", good)], "path string, content binary"), (2024, 1, 2, 0, 0, 0)).first()["content"])
    assert {i.date_time for i in stamped.infolist()} == {(2024, 1, 2, 0, 0, 0)} and stamped.infolist()[0].compress_type == zipfile.ZIP_STORED


def test_moves(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.txt").write_text("xy")
    plan = spark.createDataFrame([(f"{tmp_path}/{a}", f"{tmp_path}/t/{a}", n) for a, n in (("a.txt", 1), ("b.txt", 9), ("c.txt", 1))], "path string, to string, size long")
    moved = books.carried_out(plan)
    assert [r["status"] for r in moved.collect()] == ["moved", "changed", "missing"] and (tmp_path / "t" / "a.txt").exists()
    back = moved.filter("status = 'moved'").select(F.col("to").alias("path"), F.col("path").alias("to"))
    assert [r["status"] for r in books.carried_out(back).collect()] == ["moved"] and (tmp_path / "a.txt").read_text() == "x"
    found = epub.hashes(spark.createDataFrame([(f"{tmp_path}/a.txt",), ("/none",)], "path string")).orderBy("path").collect()
    assert [r["hash"] for r in found][0] is None and len(found[1]["hash"]) == 64


def test_titles(spark):
    rows = [("b", 0, "s1.xhtml", "<h1>1화 가</h1>", "Start", True, "", "", None), ("b", 1, "s2.xhtml", "<h1>1화 가</h1>", "", True, "", "", None), ("b", 2, "s3.xhtml", None, None, False, None, None, "손질")]
    own = spark.createDataFrame(rows, "book string, pos int, name string, markup string, label string, listed boolean, title string, series string, override string")
    assert [r["shown"] for r in titles.merged_titles(own).orderBy("pos").collect()] == ["1화 가", None, "손질"]
    page = spark.createDataFrame([("<h1>케이</h1><p>-2권에 계속-</p>",), (None,)], "m string")
    got = page.select(titles.page_title("m").alias("t"), titles.without_notices("m").alias("n"), titles.subheadings("m").alias("h")).collect()
    assert got[0]["t"] == "케이" and got[0]["n"]["removed"] == 1 and [x["title"] for x in got[0]["h"]] == ["케이"] and got[1]["t"] is None and got[1]["h"] == []
    files = spark.createDataFrame([("b", f"{i}화. 제목 {i}.xhtml") for i in range(1, 6)] + [("c", "1.xhtml")], "book string, name string")
    assert {r["book"]: r["trusted"] for r in titles.file_labels(files).collect()} == {"b": True, "c": False}
