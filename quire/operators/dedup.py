"""Duplicate files and texts: parse names, block, compare, connect, choose what to keep, and verify by content."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from quire.functions import edits, grammar
from quire.functions import text as T
from quire.operators.graph import components
from quire.sources.shared import written

# Patterns of file names, tags and messages.
EXTENSIONS = [".epub", ".txt", ".zip", ".7z", ".rar", ".pdf"]
COMPLETE_WORDS, INCOMPLETE_WORDS = ["완결", "完"], ["미완", "연중", "중단", "incomplete"]
SIDE_WORDS = ["외전", "번외", "특전", "합본"]
RISKY_WORDS = ["구버전", "old", "backup", "백업", "깨짐", "임시", "중복", "복사본"]
SIDE_STORY, NO_RANGE, DANGEROUS = "외전/합본", "범위 없음", "위험 태그"
AUTHORS_CLASH, HAS_SIDE, HAS_NO_RANGE, ALIKE = "작가 충돌", "외전/합본 포함", "범위 없는 파일 포함", "유사 제목 확인 필요"
SOME_UNKNOWN, EQUAL, UNLIKE = "해시 일부 미확인", "해시 일치", "해시 다름 확인 필요"
HIGH, MEDIUM, LOW = "높음", "중간", "낮음"
KEPT, REMOVABLE, FILE = "남김", "정리 후보: {} 우선", "파일"
MISSING = "__HASH_MISSING__"
SIMILAR, LEAST_RATIO = 0.72, 0.65
#: Titles of a block that all meet in a join; of a piece of a larger one, which has no more than so many pieces.
SMALL_BLOCK, PIECE, PIECES = 256, 4096, 64
#: Edits between a title and its centre; characters of the piece by which they meet.
RADIUS, GRAM = 2, 12


@F.pandas_udf(StringType())
def title_of(names: pd.Series) -> pd.Series:
    """A name without author, range, state and extension."""
    return names.map(lambda x: None if x is None else grammar.duplicate_title(x))


def has_any(text: Column, words: list[str]) -> Column:
    """Whether one of the words is anywhere in a text, in any case."""
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(text), w))


def is_complete(words: Column) -> Column:
    """Whether a name says so, in a word or in brackets; `미완결` doesn't."""
    said = F.regexp_replace(F.lower(words), "미완결?", "")
    bracketed = F.exists(F.split(F.translate(said, "[({", "((("), r"\("), lambda x: F.trim(F.substring_index(F.translate(x, "])}", ")))"), ")", 1)).isin("완", "完", "완결") & F.contains(F.translate(x, "])}", ")))"), F.lit(")")))
    return has_any(said, COMPLETE_WORDS) | bracketed | F.array_contains(F.split(said, r"[^0-9a-z가-힣]+"), "fin")


def author_and_body(stem: Column) -> tuple[Column, Column]:
    """The author in brackets in front, else behind an @ at the end, else empty; and the rest."""
    closes = F.instr(stem, "]")
    tag = F.startswith(stem, F.lit("[")) & closes.between(3, 82) & (closes < F.length(F.rtrim(stem)))
    body = F.when(tag, F.ltrim(F.substring(stem, closes + 1, F.length(stem)))).otherwise(stem)
    signed = F.substring_index(body, "@", -1)
    before = F.substring(body, F.lit(1), F.length(body) - F.length(signed) - 1)
    sign = F.contains(body, F.lit("@")) & (F.length(F.trim(signed)).between(1, 80)) & ~signed.rlike(r"[\[\](){},]") & ((before == "") | F.substring(before, F.length(before), F.lit(1)).isin(" ", "_"))
    author = F.when(tag, F.substring(stem, F.lit(2), closes - 2)).when(sign, signed).otherwise("")
    return T.norm_spaces(author), F.when(sign, F.rtrim(before, F.lit(" _-.,，"))).otherwise(body)


def candidates(files: DataFrame) -> DataFrame:
    """files (path, size, mtime) with what their names say; those without a title go."""
    df = files.withColumn("name", T.base_name(F.col("path"))).withColumn("ext", T.suffix(F.col("path"))).withColumn("stem", T.stem(F.col("path")))
    author, body = author_and_body(F.col("stem"))
    df = df.withColumn("author", author).withColumn("body", body)
    words = T.norm_spaces(F.col("body"))
    df = df.withColumn("words", words).withColumn("title", title_of("body")).withColumn("range", T.number_range(F.col("body")))
    df = df.withColumn("side", has_any(F.col("words"), SIDE_WORDS)).withColumn("incomplete", has_any(F.col("words"), INCOMPLETE_WORDS))
    df = df.withColumn("complete", is_complete(F.col("words")) & ~F.col("incomplete"))
    risks = F.array_compact(F.array(F.when(F.col("side"), SIDE_STORY), F.when(F.col("range.end").isNull(), NO_RANGE), F.when(has_any(F.col("words"), RISKY_WORDS), DANGEROUS)))
    df = df.withColumn("key", T.sortable(F.col("title"))).filter("key <> ''")
    return df.select("path", "name", "ext", "size", "mtime", "author", "key", F.when(F.col("side"), "side").otherwise("main").alias("kind"), F.coalesce(F.nullif("title", F.lit("")), T.norm_spaces(F.col("stem"))).alias("title"), "complete", "incomplete", F.col("range.start").alias("range_start"), F.col("range.end").alias("range_end"), "side", risks.alias("risks"))


def extension_rank(ext: Column, priority: list[str] = EXTENSIONS) -> Column:
    names = [x.lower() if x.startswith(".") else f".{x.lower()}" for x in priority]
    at = F.array_position(F.array(*map(F.lit, names)), F.lower(ext))
    return F.when(at > 0, at - 1).otherwise(len(names) + 10)


def score(priority: list[str] = EXTENSIONS) -> list[Column]:
    """Sort order of candidates, the one to keep first; ties by name, the last in lower case first."""
    end, start = F.coalesce("range_end", F.lit(0)), F.coalesce("range_start", F.lit(0))
    return [F.desc("complete"), F.asc("incomplete"), end.desc(), (end - start).desc(), extension_rank(F.col("ext"), priority).asc(), F.desc("size"), F.desc("mtime"), F.size("risks").asc(), F.lower("name").desc(), F.asc("path")]


def islands(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """df with island: within keys (not null), rows whose closed ranges overlap, directly or over others, have one number (from 0). A row without a range overlaps all.

    Only distinct ranges are sorted, so a key that a third of the rows have
    costs as much as it has ranges; its rows meet them in a join that can split.
    """
    spans = df.filter(F.col(start).isNotNull() & F.col(end).isNotNull()).select(*keys, start, end).distinct()
    order = Window.partitionBy(*keys).orderBy(start, end)
    opens = F.when(F.col(start) > F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1)), 1).otherwise(0)
    numbered = spans.withColumn("__opens", opens).withColumn("island", F.sum("__opens").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__opens")
    bridged = df.filter(F.col(start).isNull() | F.col(end).isNull()).select(*keys).distinct().withColumn("__bridged", F.lit(True))
    joined = df.join(numbered, [*keys, start, end], "left").join(bridged, keys, "left")
    return joined.select(*df.columns, F.when(F.col("__bridged"), 0).otherwise(F.col("island")).alias("island"))


def most_edits(length: Column, threshold: float) -> Column:
    """Edits that two titles may be apart, the longer of which has this length."""
    return F.floor((1 - max(threshold, LEAST_RATIO)) * length + 1e-9).cast("int")


def _compared(block: list[str], threshold: float):
    """An Arrow function: centres (key) of two pieces of a block (own: which of i and j), or one, to the pairs (a, b) whose titles may be similar."""

    def compare(rows: pa.Table) -> pa.Table:
        which, i, j = (np.asarray(rows.column(c)) for c in ("own", "i", "j"))
        one, other = (edits.Titles(rows.column("key").filter(pa.array(which == own)).to_pylist()) for own in (i[0], j[0]))
        lengths = np.arange(max(x.length[-1] if len(x.length) else 0 for x in (one, other)) + 1) + RADIUS
        reach = np.floor(lengths / max(threshold, LEAST_RATIO) + 1e-9).astype(np.int64) + RADIUS
        most = np.floor((1 - max(threshold, LEAST_RATIO)) * lengths + 1e-9).astype(np.int64) + 2 * RADIUS
        x, y = edits.near(one, None if i[0] == j[0] else other, reach, most)
        a, b = pa.array(one.text, pa.string()).take(pa.array(x)), pa.array(other.text, pa.string()).take(pa.array(y))
        return pa.table({**{c: rows.column(c).take(pa.array(np.zeros(len(x), np.int64))) for c in block}, "a": a, "b": b})

    return compare


def _centred(titles: DataFrame, block: list[str]) -> DataFrame:
    """Titles (block, key) with centre: a title of the block at most RADIUS edits away, often one for all titles of which this can be said.

    Titles meet by their piece of GRAM characters that has the least hash; any
    choice is right, as only the distance to the centre counts.
    """
    last = F.length("key") - GRAM + 1
    piece = F.when(last > 0, F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda at: F.xxhash64(F.substring("key", at, F.lit(GRAM)))))).otherwise(F.xxhash64("key"))
    own = titles.withColumn("piece", piece)
    least = own.groupBy(*block, "piece").agg(F.min("key").alias("least"))
    near = F.levenshtein("key", "least", RADIUS) >= 0
    return own.join(least, [*block, "piece"]).withColumn("centre", F.when(near, F.col("least")).otherwise(F.col("key"))).drop("piece", "least")


def similar_pairs(titles: DataFrame, block: list[str], threshold: float = SIMILAR) -> DataFrame:
    """Distinct titles (key and block columns) -> a, b: pairs in a block that are similar enough: 1 less edits by the longer length.

    At these thresholds two titles share pieces of three letters, which most
    titles of a language do, so an index of pieces is larger than all pairs.
    Titles of a small block meet in a join. Those of a large one that are a few
    edits from a centre are looked at through it, with as many more edits
    allowed. Centres are dealt in pieces of about PIECE (larger ones where there
    would be more than PIECES), each two pieces meet in a group of their own,
    and a bound on the distance (`quire.functions.edits`) that loses no pair
    leaves few of their pairs. No others are listed; the distance of each is
    found at the end, and no further than allowed. The time grows with the
    square of a block's centres.
    """
    own = titles.select(*block, "key").filter("length(key) > 0").distinct()
    own = own.join(own.groupBy(*block).agg(F.count("*").alias("n")), block)
    own = written(_centred(own, block), "titles")
    spark = own.sparkSession

    def near(pairs: DataFrame, more: int) -> DataFrame:
        """Pairs in any order -> the shorter, or lesser, as a; those that are similar, or may be by as many edits of each."""
        swapped = (F.length("a") > F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") > F.col("b")))
        pairs = pairs.select(*block, F.when(swapped, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swapped, F.col("a")).otherwise(F.col("b")).alias("b"))
        reach = F.floor((F.length("a") + more) / max(threshold, LEAST_RATIO) + 1e-9) + more
        pairs = pairs.filter(F.length("b") <= reach).withColumn("d", most_edits(F.length("b") + more, threshold) + 2 * more)
        return pairs.filter(F.expr("levenshtein(a, b, d) >= 0")).select(*block, "a", "b")

    few, many = own.filter(F.col("n") <= SMALL_BLOCK), own.filter(F.col("n") > SMALL_BLOCK)
    small = few.select(*block, F.col("key").alias("a")).join(few.select(*block, F.col("key").alias("b")), block).filter("a < b")
    centres = many.select(*block, F.col("centre").alias("key")).distinct()
    centres = centres.join(centres.groupBy(*block).agg(F.count("*").alias("n")), block)
    pieces = F.least(F.ceil(F.col("n") / PIECE), F.lit(PIECES)).cast("int")
    dealt = centres.withColumn("own", F.pmod(F.xxhash64("key"), pieces).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), pieces - 1)))
    dealt = dealt.select(*block, "key", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    # a number of its own, as the work is far more than the bytes that partitions are merged by
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *block, "i", "j")
    out = own.select(*block, F.col("key").alias("a"), F.col("key").alias("b")).schema
    met = near(dealt.groupBy(*block, "i", "j").applyInArrow(_compared(block, threshold), out), RADIUS)
    met = met.unionByName(centres.select(*block, F.col("key").alias("a"), F.col("key").alias("b"))).withColumnsRenamed({"a": "ca", "b": "cb"})
    members = lambda c: many.select(*block, F.col("centre").alias(f"c{c}"), F.col("key").alias(c))
    large = met.join(members("a"), [*block, "ca"]).join(members("b"), [*block, "cb"]).filter("ca <> cb or a < b")
    return near(small.unionByName(large.select(*block, "a", "b")), 0)


def buckets(found: DataFrame, per_extension: bool = True, fuzzy: bool = False, threshold: float = SIMILAR) -> DataFrame:
    """candidates with bucket: equal titles (and kinds, and extensions), or with fuzzy those connected by similar ones."""
    parts = ["kind"] + ["ext"] * per_extension
    exact = F.concat_ws("|", "key", *parts)
    if not fuzzy:
        return found.withColumn("bucket", exact)
    titles = found.select(*parts, F.substring("key", 1, 1).alias("first"), "key").distinct()
    name = lambda c: F.concat_ws("|", c, *parts)
    links = similar_pairs(titles, [*parts, "first"], threshold).select(name("a").alias("u"), name("b").alias("v"))
    joined = found.withColumn("node", exact).join(components(links), "node", "left")
    return joined.withColumn("bucket", F.concat(F.lit("fuzzy|"), F.coalesce("component", "node"))).drop("component", "node")


def groups(found: DataFrame, priority: list[str] = EXTENSIONS) -> DataFrame:
    """candidates with bucket (and hash, where known) -> members of groups of two or more: group, place, keep, reason, warnings, confidence and title of the group."""
    df = islands(found, ["bucket"], "range_start", "range_end")
    df = df.withColumn("group", F.when(F.col("island") == 0, F.col("bucket")).otherwise(F.concat("bucket", F.lit("|range_group_"), "island")))
    if "hash" not in df.columns:
        df = df.withColumn("hash", F.lit(None).cast("string"))
    own = Window.partitionBy("group")
    df = df.withColumn("members", F.count("*").over(own)).filter("members > 1")
    df = df.withColumn("place", F.row_number().over(own.orderBy(*score(priority)))).withColumn("keep", F.col("place") == 1)
    first = own.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("group_title", F.first("title").over(first)).withColumn("keeper", F.first("name").over(first))
    real = F.nullif("hash", F.lit(MISSING))
    distinct = lambda c: F.min(c).over(own) != F.max(c).over(own)
    missing, known = F.max((F.col("hash") == MISSING).cast("int")).over(own), F.count("hash").over(own)
    hashes = F.when(missing == 1, SOME_UNKNOWN).when(distinct(real), UNLIKE).when((known == F.col("members")) & (F.count(real).over(own) > 0), EQUAL)
    warnings = [F.when(distinct(F.nullif("author", F.lit(""))), AUTHORS_CLASH), F.when(F.max("side").over(own), HAS_SIDE), F.when(F.max(F.col("range_end").isNull()).over(own), HAS_NO_RANGE), F.when(distinct("key"), ALIKE), hashes]
    df = df.withColumn("warnings", F.array_compact(F.array(*warnings)))
    df = df.withColumn("confidence", F.when(F.size("warnings") == 0, HIGH).when(F.col("warnings") == F.array(F.lit(EQUAL)), MEDIUM).otherwise(LOW))
    span = F.when(F.coalesce("range_end", F.lit(0)) != 0, F.concat("range_start", F.lit("-"), "range_end"))
    kind = F.coalesce(F.nullif(F.upper(F.ltrim("ext", F.lit("."))), F.lit("")), F.lit(FILE))
    why = F.concat_ws(" / ", F.lit(KEPT), F.when(F.col("complete"), "완결"), span, kind, F.when(F.col("size") > 0, F.concat(F.format_number("size", 0), F.lit(" bytes"))))
    rest = F.concat(F.lit(REMOVABLE.split("{}")[0]), "keeper", F.lit(REMOVABLE.split("{}")[1]))
    return df.withColumn("reason", F.when(F.col("keep"), why).otherwise(rest)).drop("island", "keeper")


def needing_hash(members: DataFrame) -> DataFrame:
    """Members of groups (group, range_start, range_end) whose content should be compared: of one range, or of a group without any range."""
    same = F.count("*").over(Window.partitionBy("group", "range_start", "range_end"))
    own = Window.partitionBy("group")
    none = F.count("range_end").over(own) == 0
    return members.withColumn("__same", same).withColumn("__none", none).filter((F.col("__same") > 1) & (F.col("range_end").isNotNull() | F.col("__none"))).drop("__same", "__none")


def with_hashes(found: DataFrame, asked: DataFrame, hashes: DataFrame) -> DataFrame:
    """candidates with hash: of asked paths the known one or MISSING, null for others."""
    known = asked.select("path").distinct().join(hashes.select("path", "hash"), "path", "left").select("path", F.coalesce("hash", F.lit(MISSING)).alias("hash"))
    return found.drop("hash").join(known, "path", "left")


def exact_texts(docs: DataFrame, text: str, prefer: list[str]) -> DataFrame:
    """docs that share their text with another: hash, members, keep (true for the one whose preferred columns are greatest).

    Groups are summed up before the shuffle; a text that a third of the rows
    have is one row there, and its members meet it in a join that can split.
    """
    hashed = docs.withColumn("hash", F.sha2(text, 256)).drop(text)
    best = hashed.groupBy("hash").agg(F.count("*").alias("members"), F.max(F.struct(*prefer)).alias("best")).filter("members > 1")
    return hashed.join(best, "hash").withColumn("keep", F.struct(*prefer) == F.col("best")).drop("best")
