"""Titles of pages, headings within them, and what else books say about themselves in their pages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType
from pyspark.sql.window import Window

from quire.functions import headings as H

_HEADINGS = ArrayType(StructType([StructField("title", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))
_ANCHORED = StructType([StructField("markup", StringType()), StructField("anchors", ArrayType(StructType([StructField("id", StringType()), StructField("title", StringType())])))])
_CLEANED = StructType([StructField("markup", StringType()), StructField("removed", IntegerType())])


def _applied(step, column: str) -> Column:
    @F.pandas_udf(StringType())
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else step(v) for v in values], dtype=object)

    return run(column)


def page_title(markup: str) -> Column:
    return _applied(H.page_title, markup)


def file_label(name: str) -> Column:
    return _applied(H.file_label, name)


def series_title(title: str) -> Column:
    return _applied(H.series_title, title)


def creator_of(markup: str) -> Column:
    return _applied(H.creator_of, markup)


def book_title_of(markup: str) -> Column:
    return _applied(H.book_title_of, markup)


@F.pandas_udf(_HEADINGS)
def subheadings(markup: pd.Series) -> pd.Series:
    """title, start and end of each heading within a page."""
    return markup.map(lambda x: [] if x is None else [{"title": t, "start": a, "end": b} for t, a, b in H.subheadings(x)])


@F.pandas_udf(_ANCHORED)
def anchored(markup: pd.Series, prefix: pd.Series) -> pd.DataFrame:
    """A page's markup with an anchor before each heading within it, and the anchors."""
    rows = [(x, []) if x is None else H.anchored(x, H.subheadings(x), p) for x, p in zip(markup, prefix, strict=True)]
    return pd.DataFrame({"markup": [m for m, _ in rows], "anchors": [[{"id": i, "title": t} for i, t in found] for _, found in rows]})


@F.pandas_udf(_CLEANED)
def without_notices(markup: pd.Series) -> pd.DataFrame:
    """Markup without notices that the story goes on, and how many went."""
    rows = [(None, 0) if x is None else H.without_notices(x) for x in markup]
    return pd.DataFrame({"markup": [m for m, _ in rows], "removed": [n for _, n in rows]})


@F.pandas_udf(BooleanType())
def is_subheading(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else H.is_subheading(x))


@F.pandas_udf(StringType())
def merged_title(markup: pd.Series, name: pd.Series, label: pd.Series, listed: pd.Series, book: pd.Series, series: pd.Series, override: pd.Series) -> pd.Series:
    """A page's title in a merged book. label: of the page in the navigation, where listed says that the book has one."""
    rows = zip(markup, name, label, listed, book, series, override, strict=True)
    return pd.Series([H.merged_title(m or "", n or "", {(n or "").replace("\\", "/").rsplit("/", 1)[-1].lower(): x or ""} if has else None, b or "", s or "", o) for m, n, x, has, b, s, o in rows], dtype=object)


@F.pandas_udf(StringType())
def chosen_title(name: pd.Series, title: pd.Series, force: pd.Series) -> pd.Series:
    """Of a file's label and a page's title the one that says more."""
    return pd.Series([H.choose_title(n or "", t, bool(f)) for n, t, f in zip(name, title, force, strict=True)], dtype=object)


def merged_titles(pages: DataFrame) -> DataFrame:
    """pages (book, pos, name, markup, label, listed, title, series, override) with shown: the titles of a merged book; of consecutive equal ones the first."""
    shown = pages.withColumn("shown", merged_title("markup", "name", "label", "listed", "title", "series", "override"))
    key = _applied(H.duplicate_key, "shown")
    before = F.lag(key).over(Window.partitionBy("book").orderBy("pos"))
    return shown.withColumn("shown", F.when((F.col("shown") == "") | key.eqNullSafe(before), None).otherwise(F.col("shown")))


def file_labels(files: DataFrame) -> DataFrame:
    """files (book, name) -> book, name, label, trusted: whether most labels of the book are structured episodes."""

    @F.pandas_udf(BooleanType())
    def consistent(labels: pd.Series) -> pd.Series:
        return labels.map(lambda x: H.are_consistent(list(x)))

    own = files.select("book", "name", file_label("name").alias("label"))
    sets = own.groupBy("book").agg(F.collect_list("label").alias("labels")).select("book", consistent("labels").alias("trusted"))
    return own.join(sets, "book")


def tail_units(books: DataFrame) -> DataFrame:
    """books (path, pages, labels, number, serial: arrays of markup and of labels) with unit: 권 or 화."""

    @F.pandas_udf(StringType())
    def unit(pages: pd.Series, labels: pd.Series, number: pd.Series, serial: pd.Series) -> pd.Series:
        return pd.Series([H.tail_unit(list(p), list(x), int(n), bool(s)) for p, x, n, s in zip(pages, labels, number, serial, strict=True)], dtype=object)

    return books.withColumn("unit", unit("pages", "labels", "number", "serial"))

