"""Order and navigation of merged books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MARKER = r"\d+\s*[권부]|외전|번외|특전"


def has_marker(label: Column) -> Column:
    """Whether a label counts as one of several volumes."""
    return F.when(label.rlike(MARKER), True).when(label.rlike(r"\d+\s*화"), False).otherwise(label.rlike(r"\s\d+\s*$"))


def volume_plan(entries: DataFrame, stem: str = "stem") -> DataFrame:
    """entries with volume and chapter of their file names; grouped where both are there."""
    volume, chapter = (F.regexp_extract(stem, rf"(\d+)\s*{u}", 1).try_cast("int") for u in "권화")
    own = entries.withColumn("volume", volume).withColumn("chapter", chapter)
    return own.withColumn("grouped", F.col("volume").isNotNull() & F.col("chapter").isNotNull())


def use_grouping(plan: DataFrame, keys: list[str]) -> DataFrame:
    """keys, use_grouping: some volume has two entries or more."""
    sizes = plan.filter("grouped").groupBy(*keys, "volume").agg(F.count("*").alias("n"))
    return plan.select(*keys).distinct().join(sizes.groupBy(*keys).agg((F.max("n") >= 2).alias("use_grouping")), keys, "left").withColumn("use_grouping", F.coalesce("use_grouping", F.lit(False)))


def hierarchy(rows: DataFrame, keys: list[str], parent: str, order: list[str]) -> DataFrame:
    """Rows and a row for each parent before its first child: level (0 or 1), place (from 1), running over keys."""
    own = Window.partitionBy(*keys).orderBy(F.col(parent).asc_nulls_first(), "level", *order)
    tops = rows.filter(F.col(parent).isNotNull()).groupBy(*keys, parent).agg(F.count("*").alias("children"))
    both = rows.withColumn("level", F.when(F.col(parent).isNull(), 0).otherwise(1)).unionByName(tops.withColumn("level", F.lit(0)), allowMissingColumns=True)
    return both.withColumn("place", F.row_number().over(own))


def multi_volume(entries: DataFrame, pages: DataFrame, keys: list[str], book: str, marked: Column) -> DataFrame:
    """keys, multi_volume: two marked labels or more, and not every one of several books of a single page."""
    labels = entries.groupBy(*keys).agg(F.count_if(marked).alias("markers"))
    per_book = pages.groupBy(*keys, book).agg(F.count("*").alias("n"))
    shape = per_book.groupBy(*keys).agg(F.count("*").alias("books"), F.max("n").alias("most"))
    return labels.join(shape, keys, "left").select(*keys, "markers", ((F.col("markers") >= 2) & ~F.coalesce((F.col("books") > 1) & (F.col("most") == 1), F.lit(False))).alias("multi_volume"))


def first_filled(rows: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """keys and the first value of each column, in order, that isn't empty."""
    return rows.groupBy(*keys).agg(*(F.min_by(F.nullif(c, F.lit("")), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(order))).alias(c) for c in columns))


def joined_text(rows: DataFrame, keys: list[str], order: list[str], text: Column, between: str = "\n\n") -> DataFrame:
    """keys and text: the parts in order. A group is one output file, so it comes together."""
    parts = F.sort_array(F.collect_list(F.struct(*order, text.alias("__part"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda x: x["__part"]), between).alias("text"))


def consecutive_distinct(rows: DataFrame, keys: list[str], order: str, value: Column) -> DataFrame:
    """Rows whose value differs from the one before."""
    before = F.lag("__value").over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__value", value).withColumn("__before", before).filter("NOT (__value <=> __before)").drop("__value", "__before")


def unique_names(rows: DataFrame, folder: str, stem: str, order: str) -> DataFrame:
    """rows with unique: the stem, with ` (n)` from the second of a folder on."""
    n = F.row_number().over(Window.partitionBy(folder, stem).orderBy(order))
    return rows.withColumn("unique", F.when(n == 1, F.col(stem)).otherwise(F.concat(stem, F.lit(" ("), n - 1, F.lit(")"))))


def reuse(assets: DataFrame, keys: list[str], content: str, path: str, order: str) -> DataFrame:
    """assets with use: the path of the first with equal content."""
    hashed = assets.withColumn("hash", F.sha2(content, 256)).drop(content)
    return hashed.join(hashed.groupBy(*keys, "hash").agg(F.min_by(path, order).alias("use")), [*keys, "hash"])
