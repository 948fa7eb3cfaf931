"""Connected components of a large graph by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.shared import discard, written


def _rank(seed: int, node: str) -> Column:
    return F.struct(F.xxhash64(F.lit(seed), node).alias("h"), F.col(node).alias("x"))


def contracted(links: DataFrame) -> DataFrame:
    """links (u, v of any orderable type) -> node, component: a row for each node that has a link (to another one); component is one of its nodes.

    Each round, every node moves to the neighbour (itself included) that is
    least in an order drawn anew by hash, and links move with their ends. A
    group of any shape shrinks by a constant factor a round, and nothing but
    the number of links left reaches the driver. Moves are followed back at
    the end.
    """
    links = written(links.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    moves = []
    while not links.isEmpty():
        seed = len(moves)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least(F.min(_rank(seed, "v")), F.first(_rank(seed, "u")))
        move = written(both.groupBy("u").agg(least.alias("least")).select(F.col("u").alias("node"), F.col("least.x").alias("to")), "moves")
        moves.append(move)
        ends = links.join(move.select(F.col("node").alias("u"), F.col("to").alias("a")), "u").join(move.select(F.col("node").alias("v"), F.col("to").alias("b")), "v").filter("a <> b")
        left = written(ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "links")
        discard(links)
        links = left
    if not moves:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    at = moves[0].select("node", F.col("to").alias("component"))
    for move in moves[1:]:
        at = at.join(move.select(F.col("node").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return at


def components(links: DataFrame) -> DataFrame:
    """links (u, v of any orderable type) -> node, component: the least node in reach; a row for each node that has a link."""
    found = written(contracted(links), "components")
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))
