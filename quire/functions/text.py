"""Column functions on names, lines and markup; Arrow functions where Spark has no equivalent."""

from __future__ import annotations

import html
import html.entities
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values.
HANGUL = "가-힣"
UNITS = "화장편권부회"
FORBIDDEN_IN_NAMES = r'[\\/:*?"<>|]'
#: Name of each invisible character, and its code point.
INVISIBLE = {
    f"U+{c:04X}": c
    for c in (0x00AD, 0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x180E, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0x2066, 0x2067, 0x2068, 0x2069, 0x206A, 0x206B, 0x206C, 0x206D, 0x206E, 0x206F, 0x034F, 0xFEFF, 0xFFF9, 0xFFFA, 0xFFFB, 0xE0001)
}
TAG_BLOCK = r"[\x{E0020}-\x{E00BF}]"


# Arrow functions are given nulls for rows that they aren't needed for, as Spark runs them for all.


@F.pandas_udf(StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(text: Column) -> Column:
    """In NFKC; ASCII stays in the JVM."""
    odd = text.rlike(r"[^\x00-\x7F]")
    return F.when(odd, _nfkc(F.when(odd, text))).otherwise(text)


#: Entities that are decoded in the JVM, the ampersand last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", "\u00a0"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
_NOT_COMMON = "&(?!(?:" + "|".join(name[1:] for name, _ in ENTITIES) + "))"
_OTHER_ENTITY = _NOT_COMMON + "[#A-Za-z]"
_OTHER_CLOSED = _NOT_COMMON + "(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][0-9A-Za-z]*);"


@F.pandas_udf(StringType())
def _unescape(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if x is None else html.unescape(x))


_CLOSED = re.compile(r"&(#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][0-9A-Za-z]*);")


@F.pandas_udf(StringType())
def _unescape_closed(values: pd.Series) -> pd.Series:
    def character(found: re.Match) -> str:
        whole = found[0]
        return html.unescape(whole) if whole[1] == "#" or whole[1:] in html.entities.html5 else whole

    return values.map(lambda x: None if x is None else _CLOSED.sub(character, x))


def unescape_html(text: Column, closed: bool = False) -> Column:
    """Entities as the characters that they stand for, with closed only those that end in a semicolon; only a text with uncommon ones goes through Python."""
    odd = text.rlike(_OTHER_CLOSED if closed else _OTHER_ENTITY)
    common = text
    for name, character in ENTITIES:
        common = F.replace(common, F.lit(name), F.lit(character))
    decode = _unescape_closed if closed else _unescape
    return F.when(odd, decode(F.when(odd, text))).otherwise(common)


@F.pandas_udf(StringType())
def decode_bytes(values: pd.Series) -> pd.Series:
    """Bytes of unknown encoding: UTF-16 by its mark, UTF-8, the Korean code pages, else UTF-8 without what is invalid."""

    def decode(x: bytes | None) -> str | None:
        if x is None:
            return None
        x = bytes(x)
        for encoding in (*(["utf-16"] if x[:2] in (b"\xff\xfe", b"\xfe\xff") else []), "utf-8-sig", "cp949", "euc-kr"):
            try:
                return x.decode(encoding)
            except UnicodeDecodeError:
                pass
        return x.decode("utf-8", "ignore")

    return values.map(decode)


def decoded(content: Column) -> Column:
    """Only what isn't plain UTF-8 goes through Python."""
    text = content.cast("string")
    odd = ~F.is_valid_utf8(text) | text.startswith("\ufeff")
    return F.when(odd, decode_bytes(F.when(odd, content))).otherwise(text)


def strip(text: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def norm_spaces(text: Column) -> Column:
    return collapse(F.translate(text, "_", " "))


def sortable(text: Column) -> Column:
    """Only digits, letters of ASCII and Hangul, in lower case."""
    return F.lower(F.regexp_replace(text, f"[^0-9A-Za-z{HANGUL}]+", ""))


def group_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\s._\-]+", ""))


def safe_title(text: Column) -> Column:
    return strip(F.regexp_replace(text, FORBIDDEN_IN_NAMES, " "))


def safe_filename(text: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(text, FORBIDDEN_IN_NAMES, "_"), F.lit(" .")), F.lit("")), F.lit("untitled"))


def base_name(path: Column) -> Column:
    return F.substring_index(F.translate(path, "\\", "/"), "/", -1)


def stem(path: Column) -> Column:
    """Of the last part of a path, without its last suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r".(\.[^.]+)$", 1))


def human_size(size: Column) -> Column:
    out = F.concat(F.format_string("%.1f", size / 1024**4), F.lit(" TB"))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(size < 1024 ** (power + 1), F.concat(F.format_string("%.1f", size / 1024**power), F.lit(f" {unit}"))).otherwise(out)
    return out


def markup_lines(markup: Column) -> Column:
    """Markup as lines of text before entities are decoded: scripts and styles out, breaks and ends of blocks as new lines, tags as spaces."""
    text = F.regexp_replace(markup, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(?:p|div|li|tr|td|th|h[1-6])\s*>", "\n")
    return F.regexp_replace(text, r"<[^>]+>", " ")


def tidy_lines(text: Column) -> Column:
    text = F.regexp_replace(text, r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(text, r"[ \t\f\x0B]+", " "), r"\n{3,}", "\n\n"))


def plain_text(markup: Column, closed: bool = False) -> Column:
    return tidy_lines(unescape_html(markup_lines(markup), closed))


def flat_text(markup: Column) -> Column:
    """On one line, tags left out."""
    return collapse(unescape_html(F.regexp_replace(markup, r"<[^>]+>", "")))


def clean_lines(text: Column) -> Column:
    """Each line trimmed with single blanks, structural names out, runs of empty lines as one, none at the ends."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")
    lines = F.transform(lines, lambda x: strip(F.regexp_replace(x, r"[ \t\f\x0B]+", " ")))
    lines = F.filter(lines, lambda x: ~x.rlike(r"(?i)^(?:front|frontmatter|bodymatter|backmatter|section[\s_-]*0*\d{1,6})(?:\.(?:xhtml|html|htm|xml))?$"))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def indented(text: Column) -> Column:
    """A wide blank before each line that has text and doesn't start with a blank."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n")
    own = lambda x: F.when(strip(x) == "", "").when(x.rlike("^[ \t　]"), x).otherwise(F.concat(F.lit("　"), strip(x)))
    return F.regexp_replace(F.array_join(F.transform(lines, own), "\n"), r"^\n+|\n+$", "")


def image_name(ref: Column) -> Column:
    """The file name that a reference leads to, in lower case. Entities of `ref` are decoded already."""
    path = F.substring_index(F.substring_index(ref, "#", 1), "?", 1)
    return F.lower(base_name(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))))


def attribute(tag: Column, name: str) -> Column:
    return strip(F.regexp_extract(tag, rf"(?i)\b{name}\s*=\s*[\"']([^\"']+)[\"']", 1))


def without_invisible(text: Column) -> Column:
    return F.regexp_replace(text, "[" + "".join(f"\\x{{{c:X}}}" for c in INVISIBLE.values()) + "]|" + TAG_BLOCK, "")


def invisible_counts(text: Column) -> Column:
    """Name and count of each invisible character that occurs."""
    counts = [F.struct(F.lit(n).alias("name"), F.regexp_count(text, F.lit(f"\\x{{{c:X}}}")).alias("n")) for n, c in INVISIBLE.items()]
    counts.append(F.struct(F.lit("U+E0020~").alias("name"), F.regexp_count(text, F.lit(TAG_BLOCK)).alias("n")))
    return F.filter(F.array(*counts), lambda x: x["n"] > 0)


def number_before(text: Column, unit: str) -> Column:
    """The first number that a unit follows, which is no part of a longer word; null without one."""
    return F.regexp_extract(text, rf"(\d+)\s*{unit}(?![{HANGUL}])", 1).try_cast("int")


def chapter_number(title: Column) -> Column:
    """The number that a chapter title starts with, or null."""
    found = F.regexp_extract(strip(F.coalesce(title, F.lit(""))), rf"(?U)^(?:#\s*)?(?:제\s*)?(\d+)(?:\s*(?:[{UNITS}]\b|[:)]|[.](?!\d))|\s+\S)", 1)
    return found.try_cast("bigint")


def number_range(text: Column) -> Column:
    """The least start and greatest end of all `a-b` in a text, as a struct with nulls where there is none."""
    pattern = rf"(?<![0-9A-Za-z{HANGUL}])(\d{{1,5}})\s*[-~_]\s*(\d{{1,5}})"
    # two passes over the matches: numbers on the left and on the right of each
    left = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("int"))
    right = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: x.cast("int"))
    return F.struct(F.least(F.array_min(left), F.array_min(right)).alias("start"), F.greatest(F.array_max(left), F.array_max(right)).alias("end"))
