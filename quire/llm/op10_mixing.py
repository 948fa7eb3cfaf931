"""Mixing sources to target weights by temperature.

Weights: each source's share of the tokens to the power alpha, normalised;
alpha between 0 and 1 is found by bisection: the least exponent at which no
source is repeated more than `repetitions` times in the budget, or, with a
target entropy (as a part of the greatest one possible), the greatest
exponent that reaches it, if that is more.

Realised: a source with weight w gets w times the budget of tokens. Whole
epochs of it are taken in full; of the last one, blocks in the order of a
permutation (a hash of epoch, source and block) as long as they fit, then
documents of the next block in the order of another, as long as they fit. So
no source exceeds its budget, and it falls short by less than a document.

Tokens are words [^\\x20\\x09-\\x0D]+; null and empty texts have none, and come
with any source that takes part in an epoch if their turn comes; a source
without tokens has no weight and is left out. A null source is a source. Rows with equal doc_id come together; a null doc_id
counts as the text "null". Extra columns are kept by `mixed`. An empty table, or one
without tokens, gives no rows. The driver gets one row for each source, of
which there are MOST_SOURCES at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import boxed, quoted, unboxed, written

#: Shares of the corpus in tokens: budget of the mix.
BUDGET, REPETITIONS, ENTROPY = 1.0, 2.0, 0.97
#: A block is the first hex digits of a hash, so many.
DIGITS, STEPS, MOST_SOURCES = 3, 60, 1_000_000
#: Part of a token by which a budget may be passed, so that rounding errors don't cost a whole document.
ROUND = 0.001


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def weights(tokens: dict, alpha: float) -> dict:
    total = sum(tokens.values())
    raised = {s: math.pow(n / total, alpha) for s, n in tokens.items()}
    whole = sum(raised.values())
    return {s: x / whole for s, x in raised.items()}


def exponent(tokens: dict, budget: float, repetitions: float = REPETITIONS, entropy: float | None = ENTROPY) -> float:
    """tokens: of each source, over 0. budget: as a share of them all."""
    total = sum(tokens.values())

    def least(reached) -> float:
        """The least alpha, to 2**-STEPS, at which reached is true; it is for any larger one."""
        low, high = 0.0, 1.0
        if reached(low):
            return low
        for _ in range(STEPS):
            middle = (low + high) / 2
            low, high = (low, middle) if reached(middle) else (middle, high)
        return high

    def few(alpha: float) -> bool:
        return max(w * budget * total / tokens[s] for s, w in weights(tokens, alpha).items()) <= repetitions

    def flat(alpha: float) -> bool:
        return -sum(w * math.log(w) for w in weights(tokens, alpha).values()) < entropy * math.log(len(tokens))

    alpha = least(few)
    return max(alpha, least(flat)) if entropy is not None and len(tokens) > 1 else alpha


def _key(*parts) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def plan(docs: DataFrame, budget: float, repetitions: float, entropy: float | None) -> tuple[DataFrame, DataFrame]:
    """docs in boxes with tokens and keys, and a row for each source: its epochs in full, and of the last one the keys below which it is taken."""
    spark = docs.sparkSession
    counted = boxed(docs, token_count(F.col("text")).alias("tokens"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("id"), F.coalesce("source", F.lit("")).alias("source"), F.col("source").isNull().alias("none"))
    counted = counted.withColumn("block", F.substring(F.md5("id"), 1, DIGITS))
    keys = ["source", "none"]
    sizes = written(counted.groupBy(*keys, "block").agg(F.sum("tokens").alias("n")), "blocks")
    tokens = {(r[0], r[1]): int(r[2]) for r in sizes.groupBy(*keys).agg(F.sum("n").alias("n")).filter("n > 0").limit(MOST_SOURCES + 1).collect()}
    if len(tokens) > MOST_SOURCES:
        raise ValueError(f"at most {MOST_SOURCES} sources")
    schema = "source string, none boolean, epochs long, rest long"
    if not tokens:
        return counted, spark.createDataFrame([], schema + ", cut_block string, cut_doc string")
    total, share = sum(tokens.values()), weights(tokens, exponent(tokens, budget, repetitions, entropy))
    quota = {s: int(w * budget * total + ROUND) for s, w in share.items()}
    rows = [(s[0], s[1], quota[s] // n, quota[s] % n) for s, n in tokens.items()]
    sources = spark.createDataFrame(rows, schema)
    order = Window.partitionBy(*keys).orderBy("block_key")
    ranked = sizes.join(sources, keys).withColumn("block_key", _key("epochs", "source", F.col("block")))
    ranked = ranked.withColumn("upto", F.sum("n").over(order)).filter("upto > rest")
    # the first block that doesn't fit; there is one, as rest is less than all
    edges = ranked.groupBy(*keys).agg(F.min_by(F.struct("block", "block_key", "rest", "epochs", (F.col("upto") - F.col("n")).alias("before")), "block_key").alias("edge")).select(*keys, "edge.*")
    inside = Window.partitionBy(*keys).orderBy("doc_key")
    edge = counted.select(*keys, "block", "id", "tokens").join(F.broadcast(edges) if len(tokens) <= 10_000 else edges, [*keys, "block"])
    cut = edge.withColumn("doc_key", _key("epochs", "id")).withColumn("upto", F.col("before") + F.sum("tokens").over(inside)).filter("upto > rest")
    cuts = {(r[0], r[1]): (r[2], r[3]) for r in cut.groupBy(*keys).agg(F.first("block_key"), F.min("doc_key")).collect()}
    return counted, spark.createDataFrame([(*r, *cuts[r[:2]]) for r in rows], schema + ", cut_block string, cut_doc string")


def mixed(docs: DataFrame, budget: float = BUDGET, repetitions: float = REPETITIONS, entropy: float | None = ENTROPY) -> DataFrame:
    """docs with n_tokens and epoch (from 0; in place of columns of these names): a row for each time that a document is taken."""
    docs = docs.select(*[F.col(quoted(c)) for c in docs.columns if c not in ("n_tokens", "epoch")])
    counted, sources = plan(docs, budget, repetitions, entropy)
    known = counted.join(F.broadcast(sources) if sources.count() <= 10_000 else sources, ["source", "none"])
    block, own = _key("epochs", "source", F.col("block")), _key("epochs", "id")
    more = (block < F.col("cut_block")) | ((block == F.col("cut_block")) & (own < F.col("cut_doc")))
    times = F.col("epochs") + more.cast("long")
    taken = known.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(0).cast("long"), times - 1)).otherwise(F.array().cast("array<long>"))))
    return unboxed(taken, F.col("tokens").alias("n_tokens"), "epoch")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens, epoch: a row for each time that a document is taken."""
    return mixed(docs.select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens", "epoch")


def sql(documents: str = "documents", budget: float = BUDGET, repetitions: float = REPETITIONS, entropy: float = ENTROPY) -> str:
    p = "pow(n / total, a)"
    few = f"(SELECT max({p} / n) * {budget} * max(total) / sum({p}) <= {repetitions} FROM s)"
    flat = f"(SELECT ln(sum({p})) - sum({p} * ln({p})) / sum({p}) < {entropy} * ln(count(*)) FROM s)"

    def bisect(name: str, test: str) -> str:
        return f"""{name}0 AS (SELECT {test} AS ok FROM (SELECT 0.0::DOUBLE AS a)),
{name}(step, low, high) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT step + 1, CASE WHEN ok THEN low ELSE a END, CASE WHEN ok THEN a ELSE high END FROM (SELECT step, low, high, a, {test} AS ok FROM (SELECT *, (low + high) / 2 AS a FROM {name} WHERE step < {STEPS}))),
{name}1 AS (SELECT CASE WHEN (SELECT ok FROM {name}0) THEN 0 ELSE (SELECT high FROM {name} WHERE step = {STEPS}) END AS a)"""

    return f"""WITH RECURSIVE t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM {documents}),
s AS (SELECT source, n::DOUBLE AS n, (sum(n) OVER ())::DOUBLE AS total FROM (SELECT source, sum(n_tokens) AS n FROM t GROUP BY source) WHERE n > 0),
{bisect("few", few)},
{bisect("flat", flat)},
alpha AS (SELECT greatest((SELECT a FROM few1), (SELECT CASE WHEN count(*) > 1 THEN (SELECT a FROM flat1) ELSE 0 END FROM s)) AS a),
w AS (SELECT source, n, total, {p} AS p FROM s, alpha),
q AS (SELECT source, n::BIGINT AS n, floor(p / (sum(p) OVER ()) * {budget} * total + {ROUND})::BIGINT AS quota FROM w),
r AS (SELECT source, quota // n AS epochs, quota % n AS rest FROM q),
k AS (SELECT doc_id, t.source, n_tokens, epochs, rest, md5(epochs || ':' || coalesce(t.source, '') || ':' || substr(md5(doc_id::VARCHAR), 1, {DIGITS})) AS block_key, md5(epochs || ':' || doc_id) AS doc_key
  FROM t JOIN r ON t.source IS NOT DISTINCT FROM r.source),
u AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY block_key, doc_key) AS upto FROM k),
z AS (SELECT *, min(CASE WHEN upto > rest THEN block_key || doc_key END) OVER (PARTITION BY source) AS cut FROM u)
SELECT doc_id, source, n_tokens, unnest(range(0, epochs + CASE WHEN block_key || doc_key < cut THEN 1 ELSE 0 END)) AS epoch FROM z"""


SQL = sql()
