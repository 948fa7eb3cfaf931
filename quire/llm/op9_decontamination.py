"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact verification. DataFrame functions only.

Words are runs of letters, digits and non-ASCII characters of the text in
lower case; a shingle is five words, or all words of an item with fewer. The
similarity of a window of a document and a benchmark item is that of their
bags of shingles, each weighing as often as it occurs: the sum of the lesser
counts over the sum of the greater. Pairs of SIMILARITY or more are reported.

1. Windows: every window of an item's size counts that has as many shingles of
   items of this size, in any order, as two bags of SIMILARITY must have in
   common; no other window can be as similar, so nothing is lost here. A
   document shorter than the item is one window.
2. Each window has a 64-bit SimHash of its shingles. Multi-index: fingerprints
   within RADIUS bits are within PROBE = RADIUS / BLOCKS bits in one of BLOCKS
   blocks, so items are entered under every value within PROBE of each of
   their blocks, and a window looks up its own BLOCKS values: all pairs within
   RADIUS meet, and few others (4 x 697 of 65,536 values). Windows with equal
   fingerprints look up once.
3. Pairs within RADIUS are verified by the exact similarity.

At SIMILARITY the shingle vectors are at most 28 degrees apart: 9.7 of 64 bits
differ on average, deviation 2.9. RADIUS is two deviations above: of the pairs
right at SIMILARITY about 98 of 100 are found, at 0.85 over 999 of 1,000.

Items with equal shingles are looked up once. An item without words matches
nothing, nor do null or empty texts; an item of one to four words matches
documents that have these words in a row. Rows with one doc_id and unlike texts
are judged apart; repeated rows give one row; extra columns aren't read; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, unboxed, written

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 15, 4
WIDTH, PROBE = 64 // BLOCKS, RADIUS // BLOCKS
#: Rows of a table of at most 40 bytes a row that is broadcast.
MOST_SENT = 1_000_000
_NOT_WORD = r"[^0-9a-z\x{80}-\x{10FFFF}]+"


def _words(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _NOT_WORD, " ")), " ")


def _shingles(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of each so many words in a row; none if there are fewer."""
    at = F.sequence(F.lit(0), F.size(words) - size)
    return F.when(F.size(words) >= size, F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))).otherwise(F.array().cast("array<bigint>"))


def simhash(shingles: str) -> Column:
    """64 bits: each is 1 if set in over half of the hashes."""
    bits = (f"IF(2 * aggregate({shingles}, 0, (n, h) -> n + CAST(shiftright(h, {b}) & 1L AS INT)) > size({shingles}), shiftleft(1L, {b}), 0L)" for b in range(64))
    return F.expr(" | ".join(bits))


def _blocks(print_: str) -> Column:
    """Each block of a fingerprint: its number and value."""
    return F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.col(print_), WIDTH * k).bitwiseAND(F.lit((1 << WIDTH) - 1)).cast("int").alias("value")) for k in range(BLOCKS)])


def _near(value: Column) -> Column:
    """All values of a block within PROBE bits of one."""
    return F.transform(F.expr(f"filter(sequence(0, {(1 << WIDTH) - 1}), x -> bit_count(x) <= {PROBE})"), lambda x: x.bitwiseXOR(value))


def _bag_similarity(a: str, b: str) -> Column:
    """Of two arrays with repeats."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(count(F.col(a), x), count(F.col(b), x)))
    return common / (F.size(a) + F.size(b) - common)


def _starts(similarity: float) -> Column:
    """Starts of windows that hold at least as many of the sorted spots as two bags of this similarity have in common.

    The nth spot is the first of a window that starts after the spot before
    it; the window must reach the spot that makes up the number. So each start
    comes once. n is the number of shingles of the document, own of the item.
    """
    width = "least(own, n)"
    need = f"greatest(1, CAST(ceil(({width} + own) * {similarity / (1 + similarity)!r}D - 1e-9D) AS INT))"
    lo = f"greatest(0, IF(i = 0, 0, get(spots, i - 1) + 1), get(spots, i + {need} - 1) - {width} + 1)"
    hi = f"least(get(spots, i), n - {width})"
    return F.expr(f"IF(size(spots) >= {need}, flatten(transform(sequence(0, size(spots) - {need}), i -> IF({lo} <= {hi}, sequence({lo}, {hi}), array()))), array())")


def _sent(table: DataFrame) -> DataFrame:
    """To be broadcast if it is small enough."""
    return F.broadcast(table) if table.count() <= MOST_SENT else table


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct items: item (the least id), size, length (of a shingle), own (number of shingles), shingles; and the ids that each stands for."""
    read = benchmark.select("item_id", _words(F.col("text")).alias("words")).withColumn("size", F.size("words")).filter("size > 1 OR words[0] <> ''")
    shingles = _shingles(F.col("words"))
    for k in range(1, SHINGLE):
        shingles = F.when(F.col("size") == k, _shingles(F.col("words"), k)).otherwise(shingles)
    own = read.withColumn("shingles", shingles)
    own = written(own.select("item_id", "size", F.least("size", F.lit(SHINGLE)).alias("length"), F.size("shingles").alias("own"), "shingles", F.xxhash64("size", "shingles").alias("same")).distinct(), "items")
    one = own.groupBy("same").agg(F.min("item_id").alias("item")).join(own.withColumnRenamed("item_id", "item"), ["same", "item"])
    return one.select("same", "size", "length", "own", "shingles"), own.select("same", "item_id")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), _words(F.col("text")).alias("words"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, mark (a hash of the text), item_id, similarity, start: the most alike window (the first of equals) of each document and item that have one."""
    items, ids = _items(benchmark)
    items = written(items.withColumn("other", simhash("shingles")), "distinct")
    texts, spots, windows_of = _texts(docs), None, None
    key = ["doc_id", "mark", "length"]
    for length in sorted(r[0] for r in items.select("length").distinct().collect()) or [SHINGLE]:  # five at most
        known = _sent(items.filter(F.col("length") == length).select("length", "size", "own", F.explode("shingles").alias("shingle")).distinct())
        grams = texts.withColumn("shingles", _shingles(F.col("words"), length)).withColumn("n", F.size("shingles"))
        # posexplode_outer, as a filter for empty arrays would make them all over again
        own = grams.select("doc_id", "mark", "n", F.posexplode_outer("shingles").alias("spot", "shingle")).join(known, "shingle")
        spots = own if spots is None else spots.unionByName(own)
        grams = grams.select("doc_id", "mark", F.lit(length).alias("length"), "shingles")
        windows_of = grams if windows_of is None else windows_of.unionByName(grams)
    # counts first, so that only documents with a window to look up give lists
    found = spots.groupBy(*key, "size", "own", "n").agg(F.array_sort(F.collect_set("spot")).alias("spots")).withColumn("starts", _starts(similarity)).filter("size(starts) > 0")
    found = written(found.select(*key, "size", "own", "starts"), "starts")
    asked = found.select("doc_id", "mark").distinct().withColumns({"id": F.coalesce("doc_id", F.lit(0)), "none": F.col("doc_id").isNull()}).drop("doc_id")
    shown = windows_of.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "none": F.col("doc_id").isNull()}).join(_sent(asked), ["id", "mark", "none"], "left_semi").dropDuplicates(["id", "mark", "none", "length"]).drop("doc_id")
    places = found.withColumns({"id": F.coalesce("doc_id", F.lit(0)), "none": F.col("doc_id").isNull()}).drop("doc_id")
    cut = places.join(shown, ["id", "mark", "none", "length"]).withColumn("start", F.explode("starts"))
    windows = cut.select("id", "mark", "none", "size", "start", F.slice("shingles", F.col("start") + 1, F.col("own")).alias("shingles"))
    windows = written(windows.withColumn("print", simhash("shingles")), "windows")

    entered = items.select("same", "size", "other", F.explode(_blocks("other")).alias("key")).select("same", "size", "other", "key.block", F.explode(_near(F.col("key.value"))).alias("value"))
    asking = windows.select("size", "print").distinct().select("size", "print", F.explode(_blocks("print")).alias("key")).select("size", "print", "key.*")
    near = asking.join(_sent(entered), ["size", "block", "value"]).filter(F.bit_count(F.col("print").bitwiseXOR(F.col("other"))) <= RADIUS)
    near = near.select("size", "print", "same").distinct()
    both = windows.join(near, ["size", "print"]).join(items.select("same", F.col("shingles").alias("others")), "same")
    pairs = both.select("id", "mark", "none", "same", "start", _bag_similarity("shingles", "others").alias("similarity")).filter(F.col("similarity") >= similarity)
    best = pairs.groupBy("id", "mark", "none", "same").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")).join(ids, "same")
    return best.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "mark", "item_id", "best.similarity", (-F.col("best.back")).alias("start"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text holds no benchmark item."""
    id_, none, mark = F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.xxhash64(F.coalesce("text", F.lit("")))
    bad = leaks(docs, benchmark).select(id_.alias("id"), none.alias("none"), "mark").distinct()
    return unboxed(boxed(docs, id_.alias("id"), none.alias("none"), mark.alias("mark")).join(bad, ["id", "none", "mark"], "left_anti"))


SQL = f"""WITH w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '{_NOT_WORD}', ' ', 'g')), ' ') AS words FROM documents),
i AS (SELECT item_id, string_split(trim(regexp_replace(lower(coalesce(text, '')), '{_NOT_WORD}', ' ', 'g')), ' ') AS words FROM benchmark),
bs AS (SELECT item_id, len(words) AS size, least(len(words), {SHINGLE}) AS length, unnest(range(0, len(words) - least(len(words), {SHINGLE}) + 1)) AS place, words FROM i WHERE words[1] <> ''),
b AS (SELECT item_id, size, length, array_to_string(words[place + 1:place + length], ' ') AS s FROM bs),
ds AS (SELECT doc_id, length, len(words) - length + 1 AS n, unnest(range(0, len(words) - length + 1)) AS pos, words FROM w, (SELECT DISTINCT length FROM b) WHERE len(words) >= length),
d AS (SELECT doc_id, length, n, pos, array_to_string(words[pos + 1:pos + length], ' ') AS s FROM ds),
spots AS (SELECT DISTINCT doc_id, length, n, size, size - length + 1 AS own, least(size - length + 1, n) AS width, pos FROM d JOIN (SELECT DISTINCT size, length, s FROM b) USING (length, s)),
starts AS (SELECT doc_id, length, size, own, width, start FROM (SELECT *, unnest(range(greatest(0, pos - width + 1), least(pos, n - width) + 1)) AS start FROM spots)
  GROUP BY ALL HAVING count(*) >= greatest(1, ceil((width + own) * {SIMILARITY / (1 + SIMILARITY)!r} - 1e-9))),
wins AS (SELECT starts.doc_id, starts.length, size, own, width, start, s, count(*) AS c FROM starts JOIN d ON d.doc_id = starts.doc_id AND d.length = starts.length AND pos BETWEEN start AND start + width - 1 GROUP BY ALL),
bc AS (SELECT item_id, size, s, count(*) AS c FROM b GROUP BY ALL),
both_ AS (SELECT doc_id, item_id, size, own, width, start, sum(least(wins.c, bc.c)) AS common FROM wins JOIN bc USING (size, s) GROUP BY ALL),
sims AS (SELECT doc_id, item_id, start, common::DOUBLE / (width + own - common)::DOUBLE AS similarity FROM both_)
SELECT doc_id, item_id, max(similarity) AS similarity, arg_max(start, struct_pack(a := similarity, b := -start))::INTEGER AS start FROM sims WHERE similarity >= {SIMILARITY} GROUP BY doc_id, item_id"""
