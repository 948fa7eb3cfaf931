"""Titles and authors from file names, headers and captured pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import names
from quire.functions import text as T

# Fixed values.
UNKNOWN = "미상"
TITLE_LABELS = ["제목", "Title"]
AUTHOR_LABELS = ["작가", "작자", "지은이", "Author"]
CREATOR_LABELS = ["글", "저자", "작가"]
ABOUT_WORK = ["end_info", "endInfo", "detail_info"]
OTHER_WORKS = ["recommend", "ranking", "top", "lst_thum"]
SITE = "네이버 시리즈"
ROW_NUMBERS = ["volumeNo", "seriesNo"]
ROW_NAMES = ["volumnNameText", "volumeName", "subProductName", "productName", "expansionProductName"]
#: Characters of a text in which a title and an author are looked for.
HEADER = 1500


def filled(*values: Column) -> Column:
    """The first that isn't empty, else null."""
    return F.coalesce(*(F.nullif(T.strip(v), F.lit("")) for v in values))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(T.strip(F.regexp_extract(text, pattern, group)), F.lit(""))


def labelled(lines: Column, labels: list[str]) -> Column:
    """The value on the first line that one of the labels and a colon begin; blanks within a label don't matter."""
    said = F.transform(lines, lambda x: F.struct(F.lower(F.regexp_replace(F.substring_index(F.translate(x, "：", ":"), ":", 1), r"(?U)\s", "")).alias("label"), T.strip(F.regexp_replace(x, "^[^:：]*[:：]?", "")).alias("value")))
    return F.nullif(F.get(F.filter(said, lambda x: x["label"].isin(*map(str.lower, labels)) & (x["value"] != "")), F.lit(0))["value"], F.lit(""))


def _apart(text: Column, mark: str) -> tuple[Column, Column]:
    """What stands before and after the first mark, null without it."""
    at = F.instr(F.lower(text), mark)
    return F.when(at > 0, filled(F.substring(text, F.lit(1), at - 1))), F.when(at > 0, filled(F.substring(text, at + len(mark), F.length(text))))


def text_title_author(name: Column, text: Column) -> Column:
    """Title and author of a text file, from its name, else from its first lines; UNKNOWN without an author."""
    stem = T.strip(T.stem(name))
    closes = F.instr(stem, "]")
    tag = F.startswith(stem, F.lit("[")) & (closes > 2) & (closes < F.length(stem))
    sources = [(F.when(tag, F.substring(stem, closes + 1, F.length(stem))), F.when(tag, F.substring(stem, F.lit(2), closes - 2))), _apart(stem, " - "), _apart(stem, " by ")]
    lines = F.filter(F.transform(F.split(F.substring(F.coalesce(text, F.lit("")), 1, HEADER), r"\R"), T.strip), lambda x: x != "")
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    signed = _apart(first, "@")
    signs = (F.instr(first, "@") <= 81) & ~F.substring(first, F.instr(first, "@") + 1, F.lit(1)).isin("", " ", "@")
    title = F.coalesce(*(filled(t) for t, _ in sources), labelled(lines, TITLE_LABELS), F.when(signs, signed[0]), stem)
    author = F.coalesce(*(filled(a) for _, a in sources), labelled(lines, AUTHOR_LABELS), F.when(signs, signed[1]), F.lit(UNKNOWN))
    return F.struct(names.shown(title, author).alias("title"), T.collapse(author).alias("author"))


def product_number(value: Column) -> Column:
    asked = F.transform(F.split(F.substring_index(value, "?", -1), "[&#]"), lambda x: F.split(x, "=", 2))
    of_query = F.get(F.filter(asked, lambda x: (F.get(x, F.lit(0)) == "productNo") & (F.size(x) == 2)), F.lit(0))
    of_query = F.get(of_query, F.lit(1))
    return F.coalesce(found(value, r"^\s*(\d+)\s*$"), found(of_query, r"^(\d+)"))


def elements(markup: Column) -> Column:
    """Markup as an array of tag and text: each tag with what follows it up to the next one."""
    pieces = F.split(F.coalesce(markup, F.lit("")), "<")
    return F.transform(pieces, lambda x: F.struct(F.substring_index(x, ">", 1).alias("tag"), F.when(F.contains(x, F.lit(">")), F.regexp_replace(x, "(?s)^[^>]*>", "")).otherwise(x).alias("text")))


def page_title(markup: Column) -> Column:
    """The page's og:title, without the site's name."""
    tags = F.filter(F.transform(elements(markup), lambda x: x["tag"]), lambda x: F.lower(x).startswith("meta") & (F.lower(T.attribute(x, "property")) == "og:title"))
    title = T.flat_text(F.coalesce(F.get(F.transform(tags, lambda x: T.attribute(x, "content")), F.lit(0)), F.lit("")))
    ends = F.regexp_replace(title, rf"(?U)\s*-\s*{SITE.replace(' ', chr(92) + 's*')}\s*$", "")
    return T.strip(ends)


def _named(element: Column, words: list[str]) -> Column:
    """Whether the class or id of an element has one of the words."""
    name = F.concat_ws(" ", T.attribute(element["tag"], "class"), T.attribute(element["tag"], "id"))
    return reduce(lambda a, b: a | b, [F.contains(F.lower(name), F.lit(w.lower())) for w in words])


def page_author(markup: Column) -> Column:
    """From the part about the work; without such a part, from what is before other works: the text after a creator's label, or behind its colon."""
    own = elements(markup)
    at = F.transform(own, lambda x, i: F.struct(i.alias("i"), _named(x, ABOUT_WORK).alias("about"), _named(x, OTHER_WORKS).alias("other")))
    begins = F.coalesce(F.get(F.filter(at, lambda x: x["about"]), F.lit(0))["i"], F.lit(0))
    ends = F.coalesce(F.array_min(F.transform(F.filter(at, lambda x: x["other"] & (x["i"] > begins)), lambda x: x["i"])), F.size(own))
    texts = F.filter(F.transform(F.slice(own, begins + 1, ends - begins), lambda x: T.strip(x["text"])), lambda x: x != "")
    alone = F.transform(texts, lambda x, i: F.when(F.rtrim(x, F.lit(" :：")).isin(*CREATOR_LABELS), i))
    place = F.array_min(alone)
    return T.flat_text(F.coalesce(F.when(place.isNotNull(), F.get(texts, place + 1)), labelled(texts, CREATOR_LABELS), F.lit("")))


def episode_number(row: Column) -> Column:
    """Of a JSON row: its number, else the one in its names, else null."""
    number = [F.get_json_object(row, f"$.{k}").try_cast("int") for k in ROW_NUMBERS]
    said = F.concat_ws(" / ", *(F.nullif(F.get_json_object(row, f"$.{k}"), F.lit("")) for k in ROW_NAMES))
    return F.coalesce(*(F.when(n > 0, n) for n in number), T.number_before(said, "화"), T.number_before(said, "회"))
