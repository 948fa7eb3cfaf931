"""Books as results: merged, cleaned and stamped archives, and files moved as a plan says."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import headings
from quire.functions import navigation as N
from quire.functions import text as T
from quire.operators import pages
from quire.sources import epub

INVISIBLE = re.compile("[" + "".join(chr(c) for c in T.INVISIBLE.values()) + "]|[\U000e0020-\U000e00bf]")
TOKEN = re.compile(r"<meta[^>]*\bname\s*=\s*[\"']book-token[\"'][^>]*/?>\s*", re.I)
TEXTS = (".xhtml", ".html", ".htm", ".ncx", ".opf", ".xml", ".css", ".txt")
CLEANED = "path string, content binary, removed array<struct<name:string,reason:string>>, characters long, error string"
MERGED = "book string, content binary, books int, pages int, warnings array<string>"


def _opened(content: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(content))


def _spine(z: zipfile.ZipFile) -> tuple[str, str, list[tuple[str, str, str]]]:
    """Path and text of the package, and id, name and media type of the items in reading order."""
    path, text = epub._opf(z)
    tags = {epub._attribute(t, "id"): t for t in re.findall(r"<item\b[^>]*>", text, re.I)}
    found = [(i, tags[i]) for t in re.findall(r"<itemref\b[^>]*>", text, re.I) if (i := epub._attribute(t, "idref")) in tags]
    return path, text, [(i, epub.safe_path(posixpath.dirname(path), epub._attribute(t, "href")), epub._attribute(t, "media-type").lower()) for i, t in found]


def merge(volumes: list[tuple[str, bytes]], title: str, uid: str, creator: str = "", cover: bytes | None = None, cover_type: str = ".jpg", contents: bool = False, nested: bool = False, invisible: bool = True, stamp: tuple = epub.STAMP) -> tuple[bytes, int, list[str]]:
    """One archive of the pages of several (label, content): content, pages and warnings.

    nested: a point for each volume, with its pages' titles below; contents: a
    page of links in front.
    """
    files, items, spine, entries, warnings = [], [], [], [], []
    order = 1
    for v, (label, content) in enumerate(volumes, 1):
        own = []
        with _opened(content) as z:
            for k, (item, name, kind) in enumerate(_spine(z)[2], 1):
                if kind not in (N.PAGE_TYPE, "text/html"):
                    continue
                try:
                    text = z.read(name).decode("utf-8", "replace")
                except KeyError:
                    warnings.append(f"{label}: {name} is missing")
                    continue
                text = INVISIBLE.sub("", text) if invisible else text
                src = f"Text/vol{v:03d}_{k:04d}{posixpath.splitext(name)[1] or '.xhtml'}"
                files.append((f"OEBPS/{src}", text.encode()))
                items.append(N.Item(f"item{len(items) + 1:04d}", src, N.PAGE_TYPE))
                spine.append(items[-1].id)
                own.append((item, src, headings.page_title(text) or ""))
        if own and nested:
            entries.append(N.book_entry(label, own[0][1], own, v, order))
            order += 1 + len(entries[-1].children)
        else:
            for _, src, _ in own:
                entries.append(N.Entry(f"navPoint-{order}", label, src, order))
                order += 1
    if not spine:
        raise ValueError("no pages to merge")
    if contents:
        files.append(("OEBPS/Text/contents.xhtml", N.contents_page([e._replace(src=e.src.removeprefix("Text/"), children=tuple(c._replace(src=c.src.removeprefix("Text/")) for c in e.children)) for e in entries]).encode()))
        items.append(N.Item("contents", "Text/contents.xhtml", N.PAGE_TYPE))
        spine.insert(0, "contents")
    if cover is not None:
        name = f"Images/cover.{cover_type.lstrip('.').lower()}"
        files.append((f"OEBPS/{name}", cover))
        items.append(N.Item(N.COVER, name, N.media_type(name)))
    files.append(("OEBPS/content.opf", N.package(title, uid, items, spine, creator or N.creator_of(title)).encode()))
    files.append(("OEBPS/toc.ncx", N.navigation(title, uid, entries).encode()))
    files.append(("META-INF/container.xml", epub.CONTAINER.format("OEBPS/content.opf").encode()))
    return epub.packed(files, stamp), len(spine) - contents, warnings


def merged(volumes: DataFrame, **options) -> DataFrame:
    """volumes (book, pos, title, label, content) -> book, content, books, pages, warnings: one archive for each book, its volumes by pos.

    A merged book is one file, so its volumes come together in one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        first = pdf.iloc[0]
        content, n, warnings = merge(list(zip(pdf["label"], pdf["content"], strict=True)), first["title"], f"urn:quire:{first['book']}", **options)
        return pd.DataFrame({"book": [first["book"]], "content": [content], "books": [len(pdf)], "pages": [n], "warnings": [warnings]})

    return volumes.select(F.col("book").cast("string"), "pos", "title", "label", "content").groupBy("book").applyInPandas(run, MERGED)


def rewrite(content: bytes, gone: dict[str, str], invisible: bool = True, stamp: tuple | None = None) -> tuple[bytes, list[tuple[str, str]], int]:
    """An archive without some pages (name to reason) in files, manifest and spine, without invisible characters and book tokens: content, pages that went, and characters."""
    with _opened(content) as z:
        path, _, spine = _spine(z)
        ids = {i for i, name, _ in spine if name in gone}
        listed = {n for _, n, _ in spine}
        files, characters = [], 0
        for info in z.infolist():
            if info.is_dir() or info.filename in gone and info.filename in listed:
                continue
            data = z.read(info)
            if info.filename.lower().endswith(TEXTS) and not info.filename.startswith("META-INF/"):
                text = data.decode("utf-8", "surrogateescape")
                if invisible:
                    text, n = INVISIBLE.subn("", text)
                    characters += n
                if info.filename == path:
                    text = TOKEN.sub("", text)
                    text = re.sub(r"<itemref\b[^>]*?(?:/>|>\s*</itemref>)", lambda m: "" if epub._attribute(m[0], "idref") in ids else m[0], text, flags=re.I)
                    text = re.sub(r"<item\b[^>]*?/?>", lambda m: "" if epub._attribute(m[0], "id") in ids else m[0], text, flags=re.I)
                data = text.encode("utf-8", "surrogateescape")
            files.append((info, data))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for info, data in sorted(files, key=lambda x: x[0].filename != "mimetype"):
            z.writestr(zipfile.ZipInfo(info.filename, stamp or info.date_time), data, zipfile.ZIP_STORED if info.filename == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue(), [(posixpath.basename(n), gone[n]) for _, n, _ in spine if n in gone], characters


def cleaned(books: DataFrame, strip_pages: bool = True) -> DataFrame:
    """books (path, content) -> path, content, removed, characters, error: without imprint and index pages, invisible characters and tokens.

    Pages are classified as a table; then each archive is rewritten where it
    is, with the names of the pages that go. One that can't be read comes back as
    it was, with its error.
    """
    names = books.select("path").withColumn("gone", F.lit(None).cast("map<string,string>"))
    if strip_pages:
        texts = epub.entries(books, epub.MARKUP).filter("error IS NULL").select("path", "name", T.decoded(F.col("content")).alias("markup"))
        found = pages.classified(texts, "name").filter(F.col("reason").isin("copyright", "index"))
        names = found.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("name", "reason"))).alias("gone"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content, gone in zip(part["path"], part["content"], part["gone"], strict=True):
                try:
                    new, removed, n = rewrite(bytes(content), dict(gone) if gone is not None else {})
                    rows.append((path, new, [{"name": a, "reason": b} for a, b in removed], n, None))
                except Exception as e:  # noqa: BLE001  an unreadable book is a row with its error
                    rows.append((path, content, [], 0, str(e)))
            yield pd.DataFrame(rows, columns=["path", "content", "removed", "characters", "error"])

    return books.join(names, "path", "left").select("path", "content", "gone").mapInPandas(run, CLEANED)


def stamped(books: DataFrame, stamp: tuple) -> DataFrame:
    """books with all entries of their archives at one time."""

    @F.pandas_udf("binary")
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(lambda x: rewrite(bytes(x), {}, False, stamp)[0])

    return books.withColumn("content", run("content"))


def carried_out(plan: DataFrame) -> DataFrame:
    """Moves files as a plan (path, to, and size where it is known) says, in the file system that they are in: path, to, status.

    A file that is gone is missing, one whose size isn't what the plan saw is
    changed, a place that is taken is a conflict: these stay. Rows come to the
    driver one partition at a time. Run on a plan's inverse (to as path) it
    restores.
    """
    spark = plan.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    rows = []
    sized = "size" in plan.columns
    for row in plan.select("path", "to", *["size"] * sized).toLocalIterator():
        source, target = place(row["path"]), place(row["to"])
        system = source.getFileSystem(spark._jsc.hadoopConfiguration())
        if not system.exists(source):
            status = "missing"
        elif sized and row["size"] is not None and system.getFileStatus(source).getLen() != row["size"]:
            status = "changed"
        elif system.exists(target):
            status = "conflict"
        else:
            system.mkdirs(target.getParent())
            status = "moved" if system.rename(source, target) else "failed"
        rows.append((row["path"], row["to"], status))
    return spark.createDataFrame(rows, "path string, to string, status string")
