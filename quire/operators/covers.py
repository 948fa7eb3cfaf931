"""Covers of books: candidates in tiers, the first one the default."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from quire.functions import text as T
from quire.operators import series

IMAGE = r"(?i)\.(?:jpe?g|png|webp)$"
FIRST_IMAGE = "(?i)<img[^>]+src=[\"']([^\"']+)[\"']"
# Parts of urls of images that show nothing.
PLACEHOLDERS = ["favicon", "/static/", "placeholder", "noimg", "loading", "thumb/no", "thumb/19", "gnb_"]
#: Sources in order of preference.
SOURCES = ["opf_meta", "guide", "name", "spine_img", "first"]


@F.pandas_udf(StringType())
def inside(folder: pd.Series, ref: pd.Series) -> pd.Series:
    """Where a reference from a folder of an archive leads to."""
    return pd.Series([posixpath.normpath(posixpath.join("/", a or "", b or "")).lstrip("/") for a, b in zip(folder, ref, strict=True)])


def folder(path):
    return F.regexp_replace(path, r"[^/]*$", "")


def candidates(entries: DataFrame, items: DataFrame, order=None) -> DataFrame:
    """path, name, source, place: each image that may be a cover, once, the default first.

    entries and items as from quire.sources.epub. Tiers: the package's cover
    meta (an image, or the first one of a page), its guide, names with
    "cover", the first images of the first three pages, the first image by order
    (a column function; natural order by default).
    """
    known = entries.filter("error IS NULL")
    names = known.select("path", "name", "pos")
    images = names.filter(F.col("name").rlike(IMAGE) & ~F.col("name").contains("__MACOSX") & ~T.base_name(F.col("name")).startswith("._"))
    package = known.filter(F.lower("name").endswith(".opf")).select("path", F.col("name").alias("opf"), T.decoded(F.col("content")).alias("text"))
    a, b = "<meta[^>]+name=[\"']cover[\"'][^>]*content=[\"']([^\"']+)[\"']", "<meta[^>]+content=[\"']([^\"']+)[\"'][^>]*name=[\"']cover[\"']"
    meta = package.select("path", F.coalesce(*(F.nullif(F.regexp_extract("text", p, 1), F.lit("")) for p in (a, b))).alias("id")).filter("id IS NOT NULL")
    guided = package.select("path", "opf", F.explode(F.regexp_extract_all("text", F.lit("(?i)<reference[^>]+type=[\"']cover[\"'][^>]+href=[\"']([^\"'#]+)"), F.lit(1))).alias("href"))
    targets = meta.join(items, ["path", "id"]).select("path", "name", F.lit(0).alias("tier"), F.lit(0).alias("at"))
    targets = targets.unionByName(guided.select("path", inside(folder(F.col("opf")), F.col("href")).alias("name"), F.lit(1).alias("tier"), F.lit(0).alias("at")))
    targets = targets.unionByName(items.filter("spine < 3").select("path", "name", F.lit(3).alias("tier"), F.col("spine").alias("at")))
    markup = known.filter(F.lower("name").rlike(r"\.(xhtml|html|htm)$")).select("path", "name", F.regexp_extract(T.decoded(F.col("content")), FIRST_IMAGE, 1).alias("src")).filter("src <> ''")
    shown = targets.join(markup, ["path", "name"]).select("path", inside(folder(F.col("name")), F.col("src")).alias("name"), "tier", "at")
    direct = targets.filter(F.col("name").rlike(IMAGE)).select("path", "name", "tier", "at")
    named = images.filter(F.lower("name").contains("cover")).select("path", "name", F.lit(2).alias("tier"), F.col("pos").alias("at"))
    key = (order or series.natural_key)(T.base_name(F.col("name")))
    first = images.withColumn("at", F.row_number().over(Window.partitionBy("path").orderBy(key, "name"))).filter("at = 1").select("path", "name", F.lit(4).alias("tier"), "at")
    found = shown.unionByName(direct).join(names.select("path", "name"), ["path", "name"], "left_semi").unionByName(named).unionByName(first)
    best = found.groupBy("path", "name").agg(F.min(F.struct("tier", "at")).alias("best"))
    place = F.row_number().over(Window.partitionBy("path").orderBy("best", "name"))
    return best.select("path", "name", F.get(F.array(*map(F.lit, SOURCES)), F.col("best.tier")).alias("source"), place.alias("place"))


def scored_image_urls(found: DataFrame, preferred: list[str] = [], strict: bool = True) -> DataFrame:  # noqa: B006
    """found (key, pos, source, url) -> key, url, score, place: images of the allowed host by score, then position.

    Placeholders and thumbnails of the smallest kind go (without strict they
    come last); the type query is dropped, so sizes of one image are one url.
    """
    raw = T.strip(F.regexp_replace(F.regexp_replace(T.unescape_html(F.col("url")), r"\\u002[fF]|\\/", "/"), r"^[\"' ]+|[ \t\r\n\"',;)]+$", ""))
    own = found.withColumn("raw", raw).withColumn("host", F.lower(F.regexp_extract("raw", r"^https?://([^/:?#]+)", 1)))
    query = F.lower(F.regexp_extract("raw", r"\?([^#]*)", 1))
    own = own.filter((F.col("host") == "pstatic.net") | F.col("host").endswith(".pstatic.net"))
    empty = F.exists(F.array(*map(F.lit, PLACEHOLDERS)), lambda x: F.contains(F.lower("raw"), x))
    small = query.rlike(r"(?:^|&)type=m101(?:&|$)")
    if strict:
        own = own.filter(~small & ~empty)
    own = own.filter(F.regexp_extract("raw", r"^([^?#]*)", 1).rlike(r"(?i)\.(?:jpe?g|png|gif|webp)$"))
    clean = F.when(query.rlike("(?:^|&)type="), F.regexp_extract("raw", r"^([^?#]*)", 1)).otherwise(F.regexp_extract("raw", r"^([^#]*)", 1))
    lower = F.lower(F.concat_ws(" ", "raw", clean))
    wanted = F.lit(False)
    for x in preferred:
        wanted = wanted | F.col("raw").contains(x)
    size = F.when(lower.contains("thumbnailbig"), -35).when(lower.rlike(r"(?:^|[?&])type=m(?:260|300|400|500|600|690)(?:&| |$)"), -25).when(lower.contains("thumbnail"), -10).otherwise(0)
    score = F.when(wanted, -120).otherwise(0) + F.when(lower.contains("comicthumb"), -40).otherwise(0) + size + F.when(F.col("source") == "og:image", -1).otherwise(0) + F.when(empty, 500).otherwise(0) + F.when(small, 60).otherwise(0)
    from quire.operators.pages import scored_urls

    return scored_urls(own.withColumn("url", clean), "key", "url", score, "pos")


def first_episode(covers: DataFrame) -> DataFrame:
    """covers (key, pos, title, url) -> the one of the first episode, else of the least number, else the first."""
    number = F.regexp_extract("title", r"(?:제\s*)?(\d+)\s*화", 1).try_cast("int")
    one = F.col("title").rlike(r"(?:^|\D)(?:제\s*)?1\s*화(?:\D|$)")
    rank = F.struct(F.when(one, 0).when(number.isNotNull(), 1).otherwise(2).alias("kind"), F.when(one, 1).otherwise(F.coalesce(number, F.lit(999_999))).alias("n"), F.col("pos"))
    return covers.groupBy("key").agg(F.min_by(F.struct("title", "url"), rank).alias("best")).select("key", "best.title", "best.url")
