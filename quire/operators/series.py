"""Series of files: grouping by a loose key, merging of alike titles, majority names and units, natural order."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from quire.functions import grammar
from quire.functions import text as T
from quire.operators import dedup
from quire.operators.graph import contracted
from quire.sources.shared import written

ALIKE = 0.88
SORT = StructType([StructField(c, t()) for c, t in {"series": StringType, "group": IntegerType, "a": LongType, "b": LongType, "kind": IntegerType, "state": DoubleType, "tag": StringType, "name": StringType}.items()])
# Tails of series names.
TAILS = [r"\([^()]*\)\s*$", r"\s*(?:외전|번외|특전)\s*\d*\s*$", r"\s+(?:완결|완|完)\s*$", r"\s*\d+\s*[-~_]\s*\d+\s*[권화부장회]?\s*\.?\s*$", r"\s*(?:제\s*)?\d+\s*(?:권|화|부|장|회)\s*\.?\s*$", r"\s+\d{1,4}\s*\.?\s*$"]


def series_key(name: Column, keep_author: bool = True) -> Column:
    """The series that a file name belongs to: without extension, numbers, parts and states at its end."""
    own = F.regexp_replace(T.base_name(name), r"(?i)\.(epub|zip|7z|txt)$", "")
    author = T.strip(F.regexp_extract(own, r"^\s*\[([^\]]+)\]", 1))
    body = T.collapse(F.translate(F.regexp_replace(own, r"^\s*\[[^\]]+\]\s*", ""), "_", " "))
    for _ in range(2):
        for pattern in TAILS:
            body = F.regexp_replace(body, f"(?U){pattern}", "")
    body = T.collapse(body)
    return T.safe_filename(F.when((author != "") & (author != body) & F.lit(keep_author), F.concat(F.lit("["), author, F.lit("] "), body)).otherwise(body))


def with_group(names: DataFrame, key: Column) -> DataFrame:
    """names with key and norm: the loose form that groups share. Names without one go."""
    return names.withColumn("key", key).withColumn("norm", T.group_key(F.col("key"))).filter("norm <> ''")


def canonical(named: DataFrame, order: str = "pos") -> DataFrame:
    """norm, key (the first form), members and first (place) of each group."""
    return named.groupBy("norm").agg(F.min_by("key", order).alias("key"), F.count("*").alias("members"), F.min(order).alias("first"))


def merge_alike(groups: DataFrame, least: float = ALIKE) -> DataFrame:
    """canonical groups with into: the norm of the group that takes each one in.

    In the order of their first members, titles of one author are compared;
    the larger group takes the smaller (of equal ones the earlier), and one
    that is taken compares no further. Titles that share this much of their
    blocks are few edits apart, so `dedup.similar_pairs` finds all that can
    be alike in an equi join; only what such pairs connect is folded
    together, in one task for each connected set: a row for each series,
    never its files.
    """
    author = F.regexp_extract("key", r"^\[([^\]]+)\]\s*(.+)$", 1)
    title = F.when(author != "", F.regexp_extract("key", r"^\[([^\]]+)\]\s*(.+)$", 2)).otherwise(F.col("key"))
    own = groups.withColumn("author", author).withColumn("title", title)
    # a ratio r leaves (1 - r) of both lengths unmatched, each at most one edit
    pairs = dedup.similar_pairs(own.select("author", F.col("title").alias("key")).distinct(), ["author"], 1 - 2 * (1 - least))
    node = lambda c: F.to_json(F.struct("author", F.col(c).alias("title")))
    linked = contracted(pairs.select(node("a").alias("u"), node("b").alias("v")))
    own = own.withColumn("node", node("title")).join(linked, "node", "left").withColumn("set", F.coalesce("component", "node")).drop("node", "component")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        size = dict(zip(pdf["norm"], pdf["members"], strict=True))
        name = dict(zip(pdf["norm"], pdf["title"], strict=True))
        into: dict[str, str] = {}
        norms = list(size)

        def alike(a: str, b: str) -> bool:
            match = SequenceMatcher(None, name[a], name[b])
            return bool(name[a]) and bool(name[b]) and match.real_quick_ratio() >= least and match.quick_ratio() >= least and match.ratio() >= least

        for i, a in enumerate(norms):
            for b in norms[i + 1 :]:
                if a in into:
                    break
                if b not in into and alike(a, b):
                    big, small = (a, b) if size[a] >= size[b] else (b, a)
                    into[small], size[big] = big, size[big] + size[small]

        def end(x: str) -> str:
            while x in into:
                x = into[x]
            return x

        return pdf.assign(into=[end(x) for x in pdf["norm"]])[["norm", "key", "members", "first", "into"]]

    kind = dict(groups.dtypes)["first"]
    return own.groupBy("set").applyInPandas(fold, f"norm string, key string, members long, first {kind}, into string")


def majority(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys, value and n: the most frequent value that isn't empty, of equal ones the one seen first."""
    counts = df.filter(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    best = F.max(F.struct("n", (-F.col("seen")).alias("early"), F.col(value).alias("value"))).alias("best")
    return counts.groupBy(*keys).agg(best).select(*keys, F.col("best.value").alias(value), F.col("best.n").alias("n"))


def majority_author(named: DataFrame, keys: list[str], author: str = "author", order: str = "pos") -> DataFrame:
    """keys and author: the most frequent; of equal ones one that extends another and none extends, else the shortest, of these the last seen."""
    counts = named.filter(F.col(author) != "").groupBy(*keys, author).agg(F.count("*").alias("n"), F.max(order).alias("last"), F.min(order).alias("seen"))
    top = counts.join(counts.groupBy(*keys).agg(F.max("n").alias("n")), [*keys, "n"])
    all_ = top.groupBy(*keys).agg(F.collect_set(author).alias("all"))  # distinct authors of a group with the greatest count
    top = top.join(all_, keys)
    own = F.col(author)
    longer = F.exists("all", lambda x: x.startswith(own) & (x != own))
    extends = F.exists("all", lambda x: own.startswith(x) & (x != own))
    rank = F.struct((extends & ~longer).alias("extends"), F.when(extends & ~longer, -F.col("seen")).otherwise(-F.length(own)).alias("first"), F.col("last"), own.alias("author"))
    return top.groupBy(*keys).agg(F.max(rank).alias("best")).select(*keys, F.col("best.author").alias(author))


def unit_majority(df: DataFrame, keys: list[str], is_volume: Column, is_episode: Column) -> DataFrame:
    """keys, volumes, episodes, unit: what more members have, of equal numbers volumes; null if one kind is missing."""
    sums = df.groupBy(*keys).agg(F.count_if(is_volume).alias("volumes"), F.count_if(is_episode).alias("episodes"))
    return sums.withColumn("unit", F.when((F.col("volumes") > 0) & (F.col("episodes") > 0), F.when(F.col("volumes") >= F.col("episodes"), "volume").otherwise("episode")))


def natural_key(name: Column) -> Column:
    """Digits padded so that text order is the order of numbers; letters in lower case."""
    padded = F.regexp_replace(F.lower(name), r"(\d+)", "0000000000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{20})(?!\d)", "$1")


@F.pandas_udf(SORT)
def natural_sort(names: pd.Series) -> pd.DataFrame:
    """Series, then volume (or episode, or number at the end), part, side stories and state, as a struct to sort by."""
    return pd.DataFrame([grammar.sort_parts(x or "") for x in names], columns=SORT.names)


def batch_names(names: DataFrame, name: str, order: list[str], find: str = "", replace: str = "", prefix: str = "", start: int = 1, step: int = 1, unit: str = "", scope: list[str] | None = None) -> DataFrame:
    """names with new: replaced, prefixed and numbered in order, within scope, else over all: in ranges that are sorted apart, each from where the one before ends."""
    new = F.replace(F.col(name), F.lit(find), F.lit(replace)) if find else F.col(name)
    if scope:
        at = F.row_number().over(Window.partitionBy(*scope).orderBy(*order)) - 1
    else:
        known = names.columns
        names = written(names.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id()), "ordered")
        part = F.shiftright("__id", 33)
        sizes = names.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
        before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # a row for each range
        names = names.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn("__at", F.col("__id") - F.shiftleft(F.col("__part"), 33) + F.col("__before"))
        return names.select(*known, F.concat(F.lit(prefix), new, F.lit(" "), (F.lit(start) + F.lit(step) * F.col("__at")).cast("string"), F.lit(unit)).alias("new"))
    return names.withColumn("new", F.concat(F.lit(prefix), new, F.lit(" "), (F.lit(start) + F.lit(step) * at).cast("string"), F.lit(unit)))
