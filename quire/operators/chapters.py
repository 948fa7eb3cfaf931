"""Lines to chapters, and repair of their numbering. Chapters: doc, pos, title, lines (array of escaped lines)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType
from pyspark.sql.window import Window

from quire.functions import segmenting
from quire.functions import text as T

# Words of titles.
TAGS = ["#"]
SPECIAL_STARTS, REMARKS = ["특전"], ["해석", "때문"]
OPENING_WORDS, SECTION_WORDS = ["프롤로그", "에필로그"], ["프롤로그", "에필로그", "외전", "번외"]
NEAR, FULL, SHORT, HEADING = 3, 1200, 250, 80
STYLES = [("unit", r"(?U)^(?:제\s*)?0*(\d{1,5})\s*[화장편회]\s*(?:[.)．:：\-–—]\s*)?(.*)$"), ("dot", r"(?U)^(?:제\s*)?0*(\d{1,5})\s*[.)．]\s*(.*)$")]
CHAPTERS = StructType([StructField("subtitles", BooleanType()), StructField("chapters", ArrayType(StructType([StructField("title", StringType()), StructField("lines", ArrayType(StringType()))])))])

number = T.chapter_number


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def title_text(title: Column) -> Column:
    return T.collapse(T.nfkc(F.coalesce(title, F.lit(""))))


@F.pandas_udf(BooleanType())
def is_pure_marker(titles: pd.Series) -> pd.Series:
    return titles.map(lambda x: segmenting.is_pure_marker(x or ""))


def body_size(lines: str = "lines") -> Column:
    return F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(x))


def segments(lines: DataFrame, keys: list[str], order: str, is_head: Column) -> DataFrame:
    """lines with segment: how many heads are at or before the line. Streams within keys, in order."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("segment", F.sum(is_head.cast("int")).over(upto))


def detect(docs: DataFrame, strength: str = "normal", pattern: str = "", consistent: bool = True) -> DataFrame:
    """docs (doc, text) -> chapters. strength: weak, normal or strong; pattern: a heading of one's own, tried first; consistent: only the kind of heading that most have, and special ones.

    A text is one book and is read where it lies: nothing is shuffled. A null
    text has no chapters, an empty one an empty body.
    """

    @F.pandas_udf(CHAPTERS)
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if x is None else segmenting.detect(x, strength, pattern, consistent) for x in texts]
        return pd.DataFrame({"subtitles": [s for _, s in rows], "chapters": [None if own is None else [{"title": t, "lines": list(n)} for t, n in own] for own, _ in rows]})

    own = docs.select("doc", F.posexplode(found("text")["chapters"]).alias("pos", "x"))
    return own.select("doc", "pos", "x.title", "x.lines")


def neighbours(chapters: DataFrame) -> DataFrame:
    """chapters with num, and prev and next: the nearest numbers before and after."""
    order = Window.partitionBy("doc").orderBy("pos")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    numbered = chapters.withColumn("num", number(F.col("title")))
    return numbered.withColumn("prev", F.last("num", True).over(before)).withColumn("next", F.first("num", True).over(after))


def absorbed(chapters: DataFrame, into_previous: Column, marker: Column | None = None) -> DataFrame:
    """Chapters of which those marked become lines of the last that isn't, title first. One at the start of a document stays."""
    marker = F.concat(F.lit("<b>"), escaped(F.col("title")), F.lit("</b>")) if marker is None else marker
    order = Window.partitionBy("doc").orderBy("pos")
    own = chapters.withColumn("__goes", F.coalesce(into_previous, F.lit(False)) & (F.row_number().over(order) > 1))
    own = own.withColumn("__lines", F.when(F.col("__goes"), F.concat(F.array(marker), "lines")).otherwise(F.col("lines")))
    own = segments(own, ["doc"], "pos", ~F.col("__goes"))
    parts = F.sort_array(F.collect_list(F.struct("pos", "__lines")))
    return own.groupBy("doc", "segment").agg(F.min("pos").alias("pos"), F.min_by("title", "pos").alias("title"), F.flatten(F.transform(parts, lambda x: x["__lines"])).alias("lines")).drop("segment")


def _bare(shown: Column) -> Column:
    """Without dashes and bullets in front."""
    return F.ltrim(shown, F.lit(" -–—•"))


def _starts(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.startswith(F.lower(text), F.lower(w)))


def is_remark(shown: Column) -> Column:
    """A tag, a bonus part, or a remark about an epilogue."""
    words = F.split(_bare(shown), r"\s+")
    about = (F.get(words, F.lit(0)) == OPENING_WORDS[1]) & F.exists(F.array(*map(F.lit, REMARKS)), lambda w: F.startswith(F.coalesce(F.get(words, F.lit(1)), F.lit("")), w))
    return _starts(shown, TAGS) | _starts(_bare(shown), SPECIAL_STARTS) | about


def absorb_subheadings(chapters: DataFrame) -> DataFrame:
    """Headings without a number between close numbers go into the chapter before."""
    own = neighbours(chapters).withColumn("shown", title_text(F.col("title")))
    opening = _starts(_bare(F.col("shown")), [*OPENING_WORDS, "prologue", "epilogue"])
    section = F.exists(F.array(*map(F.lit, SECTION_WORDS)), lambda w: F.contains("shown", w))
    plain = (body_size() < FULL) & ~section
    close = (F.col("next") > F.col("prev")) & (F.col("next") - F.col("prev") <= NEAR) & (F.length("shown") <= HEADING)
    return absorbed(own, F.col("num").isNull() & close & (is_remark(F.col("shown")) | opening | plain)).select("doc", "pos", "title", "lines")


def absorb_interruptions(chapters: DataFrame) -> DataFrame:
    """Numbers that don't fit between close neighbours go into the chapter before."""
    own = neighbours(chapters)
    close = (F.col("next") > F.col("prev")) & (F.col("next") - F.col("prev") <= 3)
    return absorbed(own, close & ~((F.col("num") > F.col("prev")) & (F.col("num") < F.col("next")))).select("doc", "pos", "title", "lines")


def suspects(chapters: DataFrame) -> DataFrame:
    """doc, pos, kind, auto_merge of chapters that deserve a look; one row each."""
    own = neighbours(chapters).withColumn("shown", title_text(F.col("title")))
    rest = F.ltrim(F.regexp_replace(_bare(F.col("shown")), rf"^(?:#\s*)?(?:제\s*)?\d+\s*(?:[{T.UNITS}]|[.)：:])", ""))
    items = F.filter(F.split(rest, r"(?<=[.!?。])\s+"), lambda x: x.rlike(r"^\d{1,3}\s*\.$"))
    listed = (F.size(items) > 0) & ~F.array_contains(items, F.element_at(F.split(rest, r"(?<=[.!?。])\s+"), -1))
    between = (F.col("prev") < F.col("num")) & (F.col("num") < F.col("next"))
    apart = F.col("next") - F.col("prev")
    mark = F.regexp_replace("shown", r"^#?\s*\d{1,5}\s*", "")
    kind = (
        F.when(F.col("num").isNull(), F.when(F.col("prev").isNotNull() & F.col("next").isNotNull() & (is_remark(F.col("shown")) | (apart <= NEAR)), "flow"))
        .when(listed & between & (apart <= NEAR), "inline-list")
        .when(F.col("num") <= F.col("prev"), "order")
        .when(F.col("num") > F.col("prev") + 1, "gap")
        .when(between & (apart <= 2) & (body_size() < SHORT) & mark.isin("", ".", ")", ":", "："), "short")
    )
    return own.withColumn("kind", kind).filter("kind IS NOT NULL").select("doc", "pos", "kind", F.col("kind").isin("flow", "inline-list", "order").alias("auto_merge"))


def merge_suspects(chapters: DataFrame) -> DataFrame:
    sure = suspects(chapters).filter("auto_merge").select("doc", "pos", "auto_merge")
    return absorbed(chapters.join(sure, ["doc", "pos"], "left"), F.col("auto_merge")).select("doc", "pos", "title", "lines")


def _planned(chapters: DataFrame, plan, title: str = "title") -> DataFrame:
    """chapters with what and new, as plan says for the titles and sizes of each document in order; lines don't travel."""
    kind = dict(chapters.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        what = plan(list(pdf["title"]), [int(x) for x in pdf["size"]])
        return pd.DataFrame({"doc": pdf["doc"], "pos": pdf["pos"], "what": [w for w, _ in what], "new": [t for _, t in what]})

    short = chapters.select("doc", "pos", "title", body_size().alias("size"))
    found = short.groupBy("doc").applyInPandas(run, f"doc {kind['doc']}, pos {kind['pos']}, what string, new string")
    return chapters.join(found, ["doc", "pos"])


def merge_short(chapters: DataFrame, least: int) -> DataFrame:
    """Chapters without a body go, their titles to the next; short ones without a structured title go into the one before, a first one takes in the next."""
    own = _planned(chapters, lambda titles, sizes: segmenting.short_plan(titles, sizes, least)).filter("what <> 'drop'").drop("title").withColumnRenamed("new", "title")
    return absorbed(own, F.col("what") == "join", F.concat(F.lit("<b>"), "title", F.lit("</b>")))


def with_style(chapters: DataFrame) -> DataFrame:
    """Titles in the form (N화 or N.) that most of a document's titles have; of equal numbers, N화."""
    own = chapters.withColumn("shown", title_text(F.col("title")))
    (_, unit), (_, dot) = STYLES
    kind = F.when(F.col("shown").rlike(dot), "dot").when(F.col("shown").rlike(unit), "unit")
    own = own.withColumn("kind", kind)
    num = F.when(F.col("kind") == "dot", F.regexp_extract("shown", dot, 1)).otherwise(F.regexp_extract("shown", unit, 1)).try_cast("int")
    rest = T.collapse(F.when(F.col("kind") == "dot", F.regexp_extract("shown", dot, 2)).otherwise(F.regexp_extract("shown", unit, 2)))
    own = own.withColumn("num", num).withColumn("rest", rest)
    whole = Window.partitionBy("doc")
    units = F.count_if(F.col("kind") == "unit").over(whole) >= F.count_if(F.col("kind") == "dot").over(whole)
    new = F.rtrim(F.when(units, F.concat("num", F.lit("화 "), "rest")).otherwise(F.concat("num", F.lit(". "), "rest")))
    keep = F.col("kind").isNull() | ((F.col("kind") == "unit") & (F.col("rest") == ""))
    return own.withColumn("title", F.when(keep, F.col("title")).otherwise(new)).select("doc", "pos", "title", "lines")


def without_subtitles(chapters: DataFrame) -> DataFrame:
    """Only the marker of each numbered title, in the form that most have; of equal numbers, N."""
    own = chapters.withColumn("shown", F.regexp_replace(title_text(F.col("title")), r"(?U)^시작\s+", ""))
    unit, dot = rf"(?U)^(?:#\s*)?(?:제\s*)?0*(\d{{1,5}})\s*([{T.UNITS}])(?:\b|[.)\s:：-]|$)", r"(?U)^(?:#\s*)?0*(\d{1,5})\s*[.):：]"
    own = own.withColumn("kind", F.when(F.col("shown").rlike(unit), "unit").when(F.col("shown").rlike(dot), "dot").when(F.col("shown").rlike(r"(?U)^#\s*0*\d{1,5}\b"), "hash"))
    num = F.regexp_extract("shown", r"(?U)^(?:#\s*)?(?:제\s*)?0*(\d{1,5})", 1).try_cast("int")
    whole = Window.partitionBy("doc")
    units, dots = F.count_if(F.col("kind") == "unit").over(whole), F.count_if(F.col("kind") == "dot").over(whole)
    mark = F.when(F.col("kind") == "unit", F.regexp_extract("shown", unit, 2)).otherwise("화")
    new = F.when((F.col("kind") == "hash") & (units == 0) & (dots == 0), F.concat(F.lit("#"), num)).when(units > dots, F.concat(num, mark)).otherwise(F.concat(num, F.lit(".")))
    return own.withColumn("title", F.when(F.col("kind").isNull(), F.col("title")).otherwise(new)).select("doc", "pos", "title", "lines")


def keep_ascending(chapters: DataFrame) -> DataFrame:
    """The longest ascending sequence of numbers stays, with special titles; others, and lines of the body among near numbers, go into the chapter before."""

    def plan(titles: list[str], _) -> list[tuple[str, str]]:
        return [("join", t) if new is None else ("keep", new) for t, new in zip(titles, segmenting.place_titles(titles), strict=True)]

    own = _planned(chapters, plan).withColumn("old", F.col("title")).drop("title").withColumnRenamed("new", "title")
    return absorbed(own, F.col("what") == "join", F.concat(F.lit("<b>"), escaped(F.col("old")), F.lit("</b>")))


def absorb_low_runs(chapters: DataFrame) -> DataFrame:
    """Runs of numbers that have passed already go into the chapter before, if the next number follows on it."""
    plan = lambda titles, _: [("join" if x else "keep", t) for t, x in zip(titles, segmenting.low_runs([segmenting.chapter_number(t or "") for t in titles]), strict=True)]
    return absorbed(_planned(chapters, plan), F.col("what") == "join").select("doc", "pos", "title", "lines")


def _folded(chapters: DataFrame, step) -> DataFrame:
    """step over the chapters of each document, which come together in order; pos from 0 anew."""
    kind = dict(chapters.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        rows = step([(t, list(x)) for t, x in zip(pdf["title"], pdf["lines"], strict=True)], pdf)
        return pd.DataFrame({"doc": [pdf["doc"].iloc[0]] * len(rows), "pos": range(len(rows)), "title": [t for t, _ in rows], "lines": [x for _, x in rows]})

    return chapters.groupBy("doc").applyInPandas(run, f"doc {kind['doc']}, pos int, title string, lines array<string>")


def fill_gaps(chapters: DataFrame) -> DataFrame:
    """With chapters whose numbers are missing between neighbours, from the lines of the body that name them."""
    return _folded(chapters.select("doc", "pos", "title", "lines"), lambda own, _: segmenting.fill_gaps(own))


def numbered_titles(chapters: DataFrame) -> DataFrame:
    """Titles as `N. rest`, without a rest as they were."""

    @F.pandas_udf(StringType())
    def new(titles: pd.Series) -> pd.Series:
        return pd.Series([t for t, _ in segmenting.numbered_titles([(x or "", []) for x in titles])], dtype=object)

    return chapters.withColumn("title", new("title"))


def without_angles(chapters: DataFrame) -> DataFrame:
    """Titles without decoration in angles."""

    @F.pandas_udf(StringType())
    def new(titles: pd.Series) -> pd.Series:
        return pd.Series([t for t, _ in segmenting.without_angles([(x or "", []) for x in titles])], dtype=object)

    return chapters.withColumn("title", new("title"))


def restored_titles(chapters: DataFrame, docs: DataFrame) -> DataFrame:
    """Titles with the rest that the lines of their document (doc, text) give them."""
    both = chapters.join(docs.select("doc", F.col("text").alias("source")), "doc", "left")
    return _folded(both.select("doc", "pos", "title", "lines", F.when(F.row_number().over(Window.partitionBy("doc").orderBy("pos")) == 1, F.col("source")).alias("source")), lambda own, pdf: segmenting.restored_titles(own, pdf["source"].iloc[0] or ""))


@F.pandas_udf(StringType())
def one_marker_style(texts: pd.Series) -> pd.Series:
    """A text whose lines that are bare numbers read N화, where most of three or more ascend."""
    return texts.map(lambda x: None if x is None else segmenting.one_marker_style(x))


def gaps(numbered: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, missing: the values between neighbours that don't occur."""
    order = Window.partitionBy(*keys).orderBy(value)
    after = numbered.select(*keys, value).distinct().withColumn("__next", F.lead(value).over(order))
    return after.filter(F.col("__next") > F.col(value) + 1).select(*keys, F.explode(F.sequence(F.col(value) + 1, F.col("__next") - 1)).alias("missing"))


