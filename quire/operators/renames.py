"""Batch renames and cleanups as plans: tables of what to do, which a driver-side action may carry out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import names
from quire.functions import text as T
from quire.operators import series
from quire.sources.shared import written

AUTHOR = r"^\[([^\]]+)\]"


def _parsed(rows: DataFrame, name: str) -> DataFrame:
    none = F.lit(None)
    own = rows.select("path", F.col(name).alias("name"), none.cast("string").alias("title"), none.cast("string").alias("creator"), none.cast("array<string>").alias("headings"))
    found = names.parsed(own).withColumn("key", names.series_key()).select("path", "author", "series", "volume", "part", "episode", "suffix", "completed", "stem", "key")
    return written(found, "names")  # read several times; the expressions are long


def _first_replaced(text: str, old: str, new: str) -> Column:
    """text with the first occurrence of old as new."""
    at = F.instr(F.col(text), F.col(old))
    return F.concat(F.substring(text, F.lit(1), at - 1), F.col(new), F.substring(text, at + F.length(old), F.length(text)))


def preview(rows: DataFrame) -> DataFrame:
    """rows (path, pos, name, new) -> path, name, new: series, authors and units as most of a group have them.

    Groups are formed once, by the loose series key of the proposed names: the
    key that most members have takes the place of others; then the author that
    most have, by series and once more by series without author; then volumes
    or episodes, of equal numbers volumes.
    """
    own = rows.join(_parsed(rows, "new").select("path", "key"), "path").withColumn("norm", T.group_key(F.col("key")))
    best = series.majority(own, ["norm"], "key", "pos").select("norm", F.col("key").alias("best"))
    own = own.join(best, "norm", "left")
    own = own.withColumn("new", F.when(F.contains("new", "key") & (F.col("best") != F.col("key")), _first_replaced("new", "key", "best")).otherwise(F.col("new"))).drop("best", "key")
    own = written(own, "renames")
    bare = T.group_key(F.regexp_replace("series", r"^\[[^\]]+\]\s*", ""))
    for by in ("norm", "bare"):
        if by == "bare":
            own = own.join(_parsed(own, "new").select("path", bare.alias("bare")), "path")
        own = own.withColumn("author", F.regexp_extract("new", AUTHOR, 1))
        top = series.majority_author(own.filter(F.col(by) != ""), [by]).select(by, F.col("author").alias("top"))
        own = own.join(top, by, "left")
        changed = F.concat(F.lit("["), "top", F.lit("]"), F.regexp_replace("new", AUTHOR, ""))
        own = own.withColumn("new", F.when((F.col("author") != "") & (F.col("top") != F.col("author")), changed).otherwise(F.col("new"))).drop("author", "top")
        own = written(own, "renames")
    own = own.drop("bare")
    units = own.select("path", "pos", "name", "new", "norm").join(_parsed(own, "new"), "path")
    volume, episode = F.col("volume") != "", (F.col("episode") != "") & (F.col("volume") == "")
    most = series.unit_majority(units, ["norm"], volume, episode).select("norm", "unit")
    units = units.join(most, "norm")
    to_volume = (F.col("unit") == "volume") & episode & (F.col("part") == "") & F.col("episode").rlike(r"^\d+$")
    to_episode = (F.col("unit") == "episode") & volume & (F.col("part") == "")
    number = F.regexp_extract("volume", r"(\d+)", 1)
    units = units.withColumn("__change", F.coalesce(to_volume | to_episode, F.lit(False)))
    changed = units.select("*", F.when(to_volume, F.concat("episode", F.lit("권"))).when(to_episode, "").otherwise(F.col("volume")).alias("v"), F.when(to_volume, "").when(to_episode, number).otherwise(F.col("episode")).alias("e")).drop("volume", "episode").withColumnsRenamed({"v": "volume", "e": "episode"})
    return changed.withColumn("new", F.when(F.col("__change"), names.rename(changed)).otherwise(F.col("new"))).select("path", "name", "new")


def removals(members: DataFrame, trash: str) -> DataFrame:
    """Members of groups that aren't kept: path, to (a free name in the trash folder), size and mtime to check before the move."""
    own = members.filter(~F.col("keep")).withColumn("folder", F.lit(trash)).withColumn("stem", T.stem(F.col("path"))).withColumn("ext", T.suffix(F.col("path")))
    from quire.operators import nav

    named = nav.unique_names(own.withColumn("where", F.concat_ws("|", "folder", "ext")), "where", "stem", "path")
    return named.select("path", F.concat("folder", F.lit("/"), "unique", "ext").alias("to"), "size", "mtime")


def restore(moved: DataFrame, existing: DataFrame) -> DataFrame:
    """moved (path, to) -> status: missing (no longer in the trash), conflict (its old place is taken) or restored."""
    there, taken = existing.select(F.col("path").alias("to"), F.lit(True).alias("there")), existing.select("path", F.lit(True).alias("taken"))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("taken"), "conflict").otherwise("restored")
    return moved.select("path", "to").join(there, "to", "left").join(taken, "path", "left").select("path", "to", status.alias("status"))
