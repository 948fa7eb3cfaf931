"""License scans by canonical digest lookup. DataFrame functions only.

A text is made canonical, a line at a time: A-Z in lower case, copyright
clauses dropped, equivalent spellings made one (licence/license, sub-license,
http/https, curly quotes), punctuation and white space to single spaces, so
that wrapping and comment marks don't matter. Its SHA-256 meets the digests of
known licence texts, made canonical in the same way, in a hash join. Units are
the entire text of a document; each of its paragraphs (lines without an empty
one between) and each of its lines, entire. No part of a unit matches.

Known are the texts in `licences/` (by SPDX name), and one-line notices. Of a
text, what follows its end mark is optional, and a heading that names it.

Null texts count as empty and match nothing. Repeated rows get a row each;
repeated lines count as often as they occur; extra columns aren't read; an
empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import pathlib
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

# One-line notices, by SPDX name.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
]
# What a text may begin with, and the marks after which it is optional.
HEADINGS = {"MIT": "MIT License", "ISC": "ISC License", "0BSD": "BSD Zero Clause License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": "BSD 3-Clause License", "Zlib": "zlib License"}
ENDS = ["END OF TERMS AND CONDITIONS"]
#: Equivalent spellings, in lower case.
SPELLINGS = [("licence", "license"), ("sub-license", "sublicense"), ("non-infringement", "noninfringement"), ("https:", "http:"), ("owner", "holder")]
#: Of known units, whose table is broadcast.
MOST_KNOWN = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A copyright clause, and what may follow it on its line.
_COPYRIGHT = r"^[ \t#*/;%-]*(?:copyright *(?:\(c\)|©|:|[0-9][0-9][0-9][0-9])|\(c\) *[0-9][0-9][0-9][0-9]|© *[0-9][0-9][0-9][0-9]|all rights reserved)"
_CLAUSE = _COPYRIGHT + r"[^\n]*?((?:licen[cs]ed under|released under|this work is|spdx-)[^\n]*)?$"
_OTHER = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
_QUOTES, _PLAIN = "“”‘’«»–—", '""\'\'""--'


def canonical(line: Column) -> Column:
    """Of one line in lower case: one spelling, and words with single spaces between; empty if it has none."""
    rest = F.when(line.rlike(_COPYRIGHT), F.regexp_replace(line, _CLAUSE, "$1")).otherwise(line)
    spelled = reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), SPELLINGS, rest)
    return F.trim(F.regexp_replace(F.translate(spelled, _QUOTES, _PLAIN), _OTHER, " "))


def canonical_lines(text: str) -> list[str]:
    """The same of each line of a known text."""
    out = []
    for line in text.translate(str.maketrans(_UPPER + "\r", _LOWER + "\n")).split("\n"):
        line = re.sub(_CLAUSE, r"\1", line) if re.search(_COPYRIGHT, line) else line
        for a, b in SPELLINGS:
            line = line.replace(a, b)
        line = line.translate(str.maketrans(_QUOTES, _PLAIN))
        out.append(re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", line).strip(" "))
    return out


def paragraphs(lines: list[str]) -> list[str]:
    return [" ".join(x.split("\n")) for x in re.split("\n\n+", "\n".join(lines).strip("\n")) if x]


def _digest(unit: str) -> str:
    return hashlib.sha256(unit.encode()).hexdigest()


@functools.lru_cache(1)
def known_texts() -> list[tuple[str, str]]:
    """SPDX name and text of each file."""
    folder = pathlib.Path(__file__).with_name("licences")
    return [(p.stem, p.read_text()) for p in sorted(folder.glob("*.txt"))]


def known(texts: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] = NOTICES) -> tuple[dict[str, str], dict[str, str], dict[str, set[str]], tuple[int, int]]:
    """Licence by digest of a whole text, and of a notice; digests of the paragraphs of each licence; least and greatest length of a unit. Of equal digests the first licence by name."""
    whole, parts, sizes = {}, {}, []
    for name, text in sorted(known_texts() if texts is None else texts, reverse=True):
        bodies = [text, *(text[: text.index(x) + len(x)] for x in ENDS if x in text)]
        for body in bodies:
            for head in ("", HEADINGS.get(name, "")):
                whole[_digest(" ".join(x for x in canonical_lines(head + "\n" + body) if x))] = name
        own = paragraphs(canonical_lines(bodies[-1]))
        parts[name] = {_digest(x) for x in own}
        sizes += map(len, own)
    single = {}
    for name, text in sorted(notices, reverse=True):
        unit = " ".join(x for x in canonical_lines(text) if x)
        single[_digest(unit)] = name
        sizes.append(len(unit))
    if len(single) + sum(map(len, parts.values())) > MOST_KNOWN:
        raise ValueError(f"at most {MOST_KNOWN} known units")
    return whole, single, parts, (min(sizes, default=0), max(sizes, default=0))


def _tables(spark: SparkSession, texts, notices) -> tuple[DataFrame, DataFrame, tuple[int, int]]:
    """digest, licence of whole texts; digest, licence, notice, parts, wider of units: parts says how many paragraphs the licence has, wider which licences have all of them and more."""
    whole, single, parts, sizes = known(texts, notices)
    rows = [(d, name, True, 0, []) for d, name in single.items()]
    for name, own in parts.items():
        wider = [x for x, other in parts.items() if own < other]
        rows += [(d, name, False, len(own), wider) for d in own]
    whole_table = spark.createDataFrame(list(whole.items()), "digest string, licence string")
    return whole_table, spark.createDataFrame(rows, "digest string, licence string, notice boolean, parts int, wider array<string>"), sizes


def scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """doc_id, digest (of the whole text; null: no words), licence (of the whole text, or null), notices (licences of its lines that are notices, sorted, with repeats), contained (sorted licences all of whose paragraphs it has, without those that a longer one includes).

    Texts are read once; digests of their units are written, and meet the
    table of known ones, which has MOST_KNOWN rows at most, in a hash join.
    Only the few that match are grouped.
    """
    whole_table, units, (least, most) = _tables(docs.sparkSession, texts, notices)
    lines = F.transform(F.split(F.translate(F.coalesce(F.col("text"), F.lit("")), _UPPER + "\r", _LOWER + "\n"), "\n"), canonical)
    own = docs.select("doc_id", lines.alias("lines"))
    full = F.filter("lines", lambda x: x != "")
    many = F.filter(F.split(F.array_join("lines", "\n"), "\n\n+"), lambda x: F.contains(x, F.lit("\n")))
    own = own.select("doc_id", F.when(F.size(full) > 0, F.sha2(F.array_join(full, " "), 256)).alias("digest"), F.concat("lines", F.transform(many, lambda x: F.trim(F.translate(x, "\n", " ")))).alias("units"))
    fits = F.filter("units", lambda x: F.length(x).between(least, most))
    own = written(own.select("doc_id", "digest", F.transform(fits, lambda x: F.unhex(F.sha2(x, 256))).alias("units"), F.monotonically_increasing_id().alias("row")), "units")
    hits = own.select("row", F.explode("units").alias("key")).join(F.broadcast(units.withColumn("key", F.unhex("digest"))), "key")
    hits = hits.groupBy("row", "licence").agg(F.count_if("notice").alias("lines"), F.countDistinct(F.when(~F.col("notice"), F.col("key"))).alias("found"), F.max("parts").alias("parts"), F.max("wider").alias("wider"))
    hits = hits.withColumn("whole", (F.col("parts") > 0) & (F.col("found") == F.col("parts")))
    hits = hits.filter("lines > 0 OR whole").groupBy("row").agg(
        F.array_sort(F.flatten(F.collect_list(F.expr("array_repeat(licence, CAST(lines AS INT))")))).alias("notices"),
        F.collect_list(F.when(F.col("whole"), F.struct("licence", "wider"))).alias("all"),
    )
    kept = F.filter("all", lambda x: ~F.arrays_overlap(x["wider"], F.col("all.licence")))
    hits = hits.select("row", "notices", F.array_sort(F.transform(kept, lambda x: x["licence"])).alias("contained"))
    none = F.array().cast("array<string>")
    named = own.drop("units").join(F.broadcast(whole_table), "digest", "left").join(hits, "row", "left")
    return named.select("doc_id", "digest", "licence", F.coalesce("notices", none).alias("notices"), F.coalesce("contained", none).alias("contained"))


def _sql_canonical(line: str) -> str:
    line = f"CASE WHEN regexp_matches({line}, '{_COPYRIGHT}') THEN regexp_replace({line}, '{_CLAUSE}', '\\1') ELSE {line} END"
    for a, b in SPELLINGS:
        line = f"replace({line}, '{a}', '{b}')"
    quotes, plain = _QUOTES, _PLAIN.replace("'", "''")
    return f"trim(regexp_replace(translate({line}, '{quotes}', '{plain}'), '{_OTHER}', ' ', 'g'))"


def sql() -> str:
    whole, single, parts, _ = known()
    values = lambda rows: ", ".join(f"('{a}', '{b}')" for a, b in rows)
    lines = f"string_split(translate(coalesce(text, ''), '{_UPPER}' || chr(13), '{_LOWER}' || chr(10)), chr(10))"
    wider = values([(a, b) for a, own in parts.items() for b, other in parts.items() if own < other]) or "('', '')"
    return f"""WITH w(digest, licence) AS (VALUES {values(whole.items())}),
n(digest, licence) AS (VALUES {values(single.items())}),
p(digest, licence) AS (VALUES {values((d, name) for name, own in parts.items() for d in own)}),
wider(licence, longer) AS (VALUES {wider}),
d AS (SELECT row_number() OVER () AS id, doc_id, list_transform({lines}, lambda x: {_sql_canonical('x')}) AS lines FROM documents),
e AS (SELECT id, doc_id, lines, list_filter(lines, lambda x: x <> '') AS words, list_filter(regexp_split_to_array(array_to_string(lines, chr(10)), '\\n\\n+'), lambda x: contains(x, chr(10))) AS many FROM d),
f AS (SELECT id, doc_id, CASE WHEN len(words) > 0 THEN sha256(array_to_string(words, ' ')) END AS digest, list_concat(words, list_transform(many, lambda x: trim(replace(x, chr(10), ' ')))) AS units FROM e),
u AS (SELECT id, sha256(unnest(units)) AS digest FROM f),
lines_ AS (SELECT id, list(licence ORDER BY licence) AS notices FROM u JOIN n USING (digest) GROUP BY id),
whole_ AS (SELECT id, licence FROM u JOIN p USING (digest) GROUP BY id, licence HAVING count(DISTINCT digest) = (SELECT count(*) FROM p q WHERE q.licence = p.licence)),
kept AS (SELECT id, list(licence ORDER BY licence) AS contained FROM whole_ a WHERE NOT EXISTS (SELECT 1 FROM whole_ b JOIN wider ON longer = b.licence WHERE b.id = a.id AND wider.licence = a.licence) GROUP BY id)
SELECT doc_id, f.digest, w.licence, coalesce(notices, []) AS notices, coalesce(contained, []) AS contained
FROM f LEFT JOIN w ON f.digest = w.digest LEFT JOIN lines_ ON f.id = lines_.id LEFT JOIN kept ON f.id = kept.id"""


SQL = sql()
