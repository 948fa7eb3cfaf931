"""EPUB files as tables: entries, manifest, spine, labels and pages, and text sections; and writers."""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quire.functions import text as T
from quire.operators import nav, pages

ENTRIES = "path string, name string, pos int, content binary, error string"
ITEMS = "path string, opf string, id string, href string, name string, media_type string, spine int, title string, creator string, language string, error string"
MARKUP = (".xhtml", ".html", ".htm")
#: Bytes of entries that make a batch.
HELD = 4 << 20


def files(spark: SparkSession, folder: str, extensions: list[str], recursive: bool = True) -> DataFrame:
    """path, size, mtime: without reading contents."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.{" + ",".join(x.lstrip(".") for x in extensions) + "}")
    listed = reader.load(folder).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))
    return listed.filter(~F.exists(F.split("path", "/"), lambda x: x.startswith("_dedupe_trash_")))


def hashes(files: DataFrame, block: int = 1 << 20) -> DataFrame:
    """files (path) -> path, hash: SHA-256 of each file's content, read by the executors a block at a time; null where a file can't be read.

    Paths are of a file system that executors mount (file: or plain).
    """

    @F.pandas_udf(StringType())
    def run(paths: pd.Series) -> pd.Series:
        return paths.map(lambda x: _hash(x, block))

    return files.select("path", run("path").alias("hash"))


def _hash(path: str, block: int) -> str | None:
    found = hashlib.sha256()
    try:
        with open(unquote(re.sub("^file:/+", "/", path)) if path.startswith("file:") else path, "rb") as f:
            while part := f.read(block):
                found.update(part)
    except OSError:
        return None
    return found.hexdigest()


def safe_path(folder: str, href: str) -> str:
    """Inside the archive, whatever the reference says."""
    joined = posixpath.normpath(posixpath.join("/", folder.replace("\\", "/"), href.replace("\\", "/")))
    return joined.lstrip("/")


def entries(books: DataFrame, suffixes: tuple[str, ...] | None = None) -> DataFrame:
    """books (path, content) -> a row for each entry of the archive; an archive that can't be read gives one row with error. Contents of entries without one of the suffixes stay null, unread."""

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "name", "pos", "content", "error"]
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                rows, held = [], 0
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [n for n in z.namelist() if not n.endswith("/") and safe_path("", n) == n]
                        for pos, name in enumerate(names):
                            data = z.read(name) if suffixes is None or name.lower().endswith(suffixes) else None
                            rows.append((path, name, pos, data, None))
                            held += len(data or b"")
                            if held > HELD:
                                yield pd.DataFrame(rows, columns=columns)
                                rows, held = [], 0
                except Exception as e:  # noqa: BLE001  an unreadable book is a row with its error
                    rows.append((path, None, None, None, str(e)))
                yield pd.DataFrame(rows, columns=columns).astype({"pos": "Int32"})

    return books.select("path", "content").mapInPandas(unpack, ENTRIES)


def _attribute(tag: str, name: str) -> str:
    found = re.search(rf"\b{name}\s*=\s*[\"']([^\"']+)[\"']", tag, re.I)
    return found[1].strip() if found else ""


def _opf(z: zipfile.ZipFile) -> tuple[str, str]:
    box = z.read("META-INF/container.xml").decode("utf-8", "replace")
    path = re.search(r"full-path=[\"']([^\"']+\.opf)[\"']", box, re.I)[1].replace("\\", "/")
    return path, z.read(path).decode("utf-8", "replace")


def items(books: DataFrame) -> DataFrame:
    """books (path, content) -> a row for each manifest item: its place in the spine (null: none) and the package's title, creator, language."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ITEMS.split(", ")]
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        opf, text = _opf(z)
                    folder = posixpath.dirname(opf)
                    spine = {}
                    for i, tag in enumerate(re.findall(r"<itemref\b[^>]*>", text, re.I)):
                        spine.setdefault(_attribute(tag, "idref"), i)
                    meta = []
                    for field in ("title", "creator", "language"):
                        found = re.search(rf"<dc:{field}\b[^>]*>(.*?)</dc:{field}>", text, re.I | re.S)
                        value = re.sub(r"<!\[CDATA\[(.*?)\]\]>", r"\1", found[1], flags=re.S) if found else ""
                        meta.append(" ".join(value.split()))
                    tags = [t for t in re.findall(r"<item\b[^>]*>", text, re.I) if _attribute(t, "id") and _attribute(t, "href")]
                    rows = [(path, opf, i := _attribute(t, "id"), h := _attribute(t, "href"), safe_path(folder, h), _attribute(t, "media-type").lower(), spine.get(i), *meta, None) for t in tags]
                except Exception as e:  # noqa: BLE001
                    rows = [(path, *[None] * 9, str(e))]
                yield pd.DataFrame(rows, columns=names).astype({"spine": "Int32"})

    return books.select("path", "content").mapInPandas(read, ITEMS)


def labels(found: DataFrame) -> DataFrame:
    """entries -> path, name (of a page, in lower case) and label: from NCX navigation; of one name the last label holds."""
    ncx = found.filter(F.lower("name").endswith(".ncx")).select("path", T.decoded(F.col("content")).alias("text"))
    points = r"(?is)<navLabel\b[^>]*>\s*<text\b[^>]*>(.*?)</text>\s*</navLabel>\s*<content\b[^>]*\bsrc\s*=\s*[\"']([^\"']+)[\"']"
    label, source = (F.regexp_extract_all("text", F.lit(points), F.lit(i)) for i in (1, 2))
    rows = ncx.select("path", F.posexplode(F.arrays_zip(label.alias("label"), source.alias("src"))).alias("pos", "x"))
    rows = rows.select("path", "pos", T.image_name(F.col("x.src")).alias("name"), T.collapse(T.unescape_html(F.regexp_replace("x.label", r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1"))).alias("label"))
    return rows.groupBy("path", "name").agg(F.max_by("label", "pos").alias("label"))


def sections(books: DataFrame, skip: bool = True, invisible: bool = True, cleanup: bool = True) -> DataFrame:
    """path, pos, name, text: the text of each page in reading order, without empty ones."""
    order = items(books).filter(F.col("spine").isNotNull() & F.col("media_type").contains("html")).select("path", "name", F.col("spine").alias("pos"))
    found = entries(books, MARKUP).filter("error IS NULL AND content IS NOT NULL").select("path", "name", F.col("pos").alias("at"), "content")
    known = found.join(order, ["path", "name"])
    bare = found.join(order.select("path").distinct(), "path", "left_anti").filter(F.lower("name").rlike(r"\.(xhtml|html|htm)$")).withColumn("pos", F.col("at"))
    own = known.unionByName(bare).withColumn("markup", T.decoded(F.col("content"))).drop("content")
    if skip:
        own = pages.classified(own, "name").filter("reason IS NULL")
    text = T.plain_text(T.without_invisible(F.col("markup")) if invisible else F.col("markup"))
    return own.select("path", "pos", "name", (T.clean_lines(text) if cleanup else text).alias("text")).filter("text <> ''")


def book_texts(books: DataFrame, **options) -> DataFrame:
    """path, text: sections joined by an empty line."""
    return nav.joined_text(sections(books, **options), ["path"], ["pos"], F.col("text"))


def text_names(texts: DataFrame, stem: str = "stem") -> DataFrame:
    """texts with name: a free file name for each, in the order of its stem: safe, `(n)` from the second of a name on."""
    own = texts.withColumn("__safe", T.safe_filename(F.col(stem))).withColumn("__folder", F.lit(""))
    named = nav.unique_names(own, "__folder", "__safe", stem)
    return named.withColumn("name", F.concat("unique", F.lit(".txt"))).drop("__safe", "__folder", "unique")


def write_texts(texts: DataFrame, folder: str) -> None:
    """A text file for each row (stem, text), written by the executors to a folder that all of them share."""
    texts.select(F.col("text").alias("value"), "stem").write.partitionBy("stem").text(folder)


CONTAINER = '<?xml version="1.0"?>\n<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="{}" media-type="application/oebps-package+xml"/></rootfiles></container>'
STAMP = (2020, 1, 1, 0, 0, 0)


def packed(parts: list[tuple[str, bytes]], stamp: tuple = STAMP) -> bytes:
    """An archive with mimetype first and stored, the rest deflated, all with one time."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in [("mimetype", b"application/epub+zip"), *[x for x in parts if x[0] != "mimetype"]]:
            z.writestr(zipfile.ZipInfo(name, stamp), data, zipfile.ZIP_STORED if name == "mimetype" else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def built(chapters: DataFrame, meta: DataFrame) -> DataFrame:
    """chapters (doc, pos, title, lines) and meta (doc, title, author, uid) -> doc, content: an EPUB for each document.

    A book is one file, so its chapters come together in one task.
    """
    kind = dict(chapters.dtypes)["doc"]
    named = chapters.join(meta.select("doc", F.col("title").alias("book"), "author", "uid"), "doc")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        from html import escape

        pdf = pdf.sort_values("pos").reset_index(drop=True)
        first = pdf.iloc[0]
        names = [f"chapter_{i + 1:04d}.xhtml" for i in pdf.index]
        parts = [("META-INF/container.xml", CONTAINER.format("OEBPS/content.opf").encode())]
        manifest = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
        spine = "".join(f'<itemref idref="c{i}"/>' for i in range(len(names)))
        parts.append(("OEBPS/content.opf", f'<?xml version="1.0" encoding="utf-8"?>\n<package xmlns="http://www.idpf.org/2007/opf" version="2.0" unique-identifier="uid"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="uid">{escape(first["uid"])}</dc:identifier><dc:title>{escape(first["book"])}</dc:title><dc:creator>{escape(first["author"])}</dc:creator><dc:language>ko</dc:language></metadata><manifest><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>{manifest}</manifest><spine toc="ncx">{spine}</spine></package>'.encode()))
        points = "".join(f'<navPoint id="n{i + 1}" playOrder="{i + 1}"><navLabel><text>{escape(t)}</text></navLabel><content src="{n}"/></navPoint>' for i, (t, n) in enumerate(zip(pdf["title"], names, strict=True)))
        parts.append(("OEBPS/toc.ncx", f'<?xml version="1.0" encoding="utf-8"?>\n<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head/><docTitle><text>{escape(first["book"])}</text></docTitle><navMap>{points}</navMap></ncx>'.encode()))
        for title, lines, name in zip(pdf["title"], pdf["lines"], names, strict=True):
            body = "".join(f"<p>{x}</p>" for x in lines)
            parts.append((f"OEBPS/{name}", f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(title)}</title></head><body><h2>{escape(title)}</h2>{body}</body></html>'.encode()))
        return pd.DataFrame({"doc": [first["doc"]], "content": [packed(parts)]})

    return named.groupBy("doc").applyInPandas(build, f"doc {kind}, content binary")
