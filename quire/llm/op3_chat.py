"""Chat formatting as prefix trees: initial turns that conversations share are emitted once.

Template: a turn is `<s>[INST] ROLE [/INST]TEXT</s>`. In roles and texts each
of these control strings gets a backslash after its first character (after
those that are there: one more), so no control string is left inside and the
change is undone exactly. All of an assistant's text, and nothing else, is
under the loss mask.

Tree: a node is a turn after a given sequence of turns; conversations with
the same first turns share nodes. Nodes are laid out depth-first in one
sequence of characters (code points are the tokens here; any tokenizer that keeps control
strings apart can be applied to each node's text). Each node has its place in
the sequence, the position id of its first character (its distance from the
start of the conversation) and the intervals of the sequence that it attends
to: its ancestors and, causally, itself.

Depth-first order is the order of the sequences of turn digests: distinct ones
are range-partitioned and sorted, and a node belongs to the first that has
it. Turns are numbered and offsets summed in two steps, within and over
partitions, so texts of one conversation, however long, are spread over tasks.
A conversation is a list of digests in one row, never of texts; its own digest
is read back by one task, a batch at a time.

Null texts and roles count as empty; a null conv_id is one conversation; rows
come by turn (null first), then role and text, so repeated rows are repeated
turns. Extra columns aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shuffle_partitions, written

_CONTROL = r"([<\[])(\\*/?(?:s>|INST\]))"
_ESCAPED = re.compile(r"([<\[])\\(\\*/?(?:s>|INST\]))")
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.DOTALL)
_NONE = -(1 << 63)
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"$1\\$2")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of conv, with nth: the place of each among those of its conversation in this partition."""
    conv, n = None, 0
    for batch in batches:
        nth = []
        for own in batch.column("conv").to_pylist():
            conv, n = own, n + 1 if own == conv else 1
            nth.append(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nth, pa.int64())], names=[*batch.schema.names, "nth"])


def _numbered(rows: DataFrame) -> DataFrame:
    """conv, turn, role, said -> conv, role, said, depth (from 1, within conv).

    Rows are sorted in ranges, so that a conversation of any length is spread
    over tasks; each range counts for itself, and those that go on with a
    conversation (one for each range at most) start where the last one ended.
    """
    n = shuffle_partitions(rows.sparkSession)
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("said")]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    counted = written(dealt.mapInArrow(_counted, "conv long, turn long, role string, said string, nth long").withColumn("part", F.spark_partition_id()), "numbered")
    ends = counted.groupBy("conv", "part").agg(F.max("nth").alias("n"))
    split = ends.groupBy("conv").agg(F.min("part").alias("first"), F.max("part").alias("last")).filter("first < last").select("conv")
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")
    offsets = ends.join(F.broadcast(split), "conv").withColumn("before", before).filter("before > 0").select("conv", "part", "before")  # a row for each range at most
    return counted.join(F.broadcast(offsets), ["conv", "part"], "left").select("conv", "role", "said", (F.col("nth") + F.coalesce("before", F.lit(0))).cast("int").alias("depth"))


def _turns(conversations: DataFrame) -> DataFrame:
    """conv, depth (from 1), text (formatted), digest, size, loss_from, loss_to (within the text; equal: none)."""
    rows = conversations.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(_NONE)).alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("said"))
    rows = _numbered(rows).withColumn("head", F.concat(F.lit("<s>[INST] "), escaped(F.col("role")), F.lit(" [/INST]"))).withColumn("body", escaped(F.col("said")))
    rows = rows.withColumn("text", F.concat("head", "body", F.lit("</s>"))).withColumn("loss_from", F.length("head").cast("long"))
    loss = F.when(F.col("role") == LOSS_ROLE, F.length("body")).otherwise(0)
    return rows.select("conv", "depth", "text", F.md5("text").alias("digest"), F.length("text").cast("long").alias("size"), "loss_from", (F.col("loss_from") + loss).alias("loss_to"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Node ids: each hashes its parent's and its own digest."""
    for batch in batches:
        nodes = []
        for digests in batch.column("digests").to_pylist():
            own, last = [], b""
            for digest in digests:
                last = hashlib.md5(last + bytes.fromhex(digest)).digest()
                own.append(last)
            nodes.append(own)
        yield pa.RecordBatch.from_arrays([batch.column("rank"), batch.column("conv"), batch.column("sizes"), pa.array(nodes, pa.list_(pa.binary()))], names=["rank", "conv", "sizes", "nodes"])


def prefix_trees(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The trees, their paths and the conversations' places.

    nodes: node, parent, tree (ids), depth, start (in the sequence), size,
    position (id of the first character), text, loss_from, loss_to, attends
    (intervals of the sequence, the last of which ends with the node).
    paths: rank, depth, node. places: conv, rank (equal conversations share one).
    """
    spark = conversations.sparkSession
    n = shuffle_partitions(spark)
    turns = written(_turns(conversations), "turns")
    each = turns.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "digest", "size"))).alias("turns")).select("conv", F.col("turns.digest").alias("digests"), F.col("turns.size").alias("sizes"))
    each = each.withColumn("path", F.array_join("digests", ""))
    distinct = each.groupBy("path").agg(F.min("conv").alias("conv")).join(each, ["path", "conv"])
    ranked = distinct.repartitionByRange(n, "path").sortWithinPartitions("path").withColumn("rank", F.monotonically_increasing_id())
    ranked = written(ranked.select("rank", "conv", "path", "digests", "sizes"), "ranks")
    places = each.select("conv", "path").join(ranked.select("rank", "path"), "path").select("conv", "rank")
    chains = written(ranked.select("rank", "conv", "digests", "sizes").mapInArrow(_chained, "rank long, conv long, sizes array<long>, nodes array<binary>"), "chains")

    paths = chains.select("rank", F.posexplode(F.arrays_zip("nodes", "sizes")).alias("at", "x")).select("rank", (F.col("at") + 1).alias("depth"), F.col("x.nodes").alias("node"), F.col("x.sizes").alias("size"))
    owned = written(paths.groupBy("node").agg(F.min("rank").alias("owner"), F.first("depth").alias("depth"), F.first("size").alias("size")), "nodes")
    part = F.shiftright("owner", 33)
    new = owned.groupBy("owner").agg(F.sum("size").alias("new")).withColumn("part", part)
    parts = new.groupBy("part").agg(F.sum("new").alias("whole")).withColumn("before", F.sum("whole").over(Window.orderBy("part")) - F.col("whole"))  # a row for each partition
    inside = F.sum("new").over(Window.partitionBy("part").orderBy("owner")) - F.col("new")
    starts = new.withColumn("inside", inside).join(parts, "part").select("owner", (F.col("before") + F.col("inside")).alias("from"))
    own = Window.partitionBy("owner").orderBy("depth")
    laid = owned.join(starts, "owner").withColumn("start", F.col("from") + F.sum("size").over(own) - F.col("size"))
    laid = written(laid.select("node", "owner", "depth", "size", "from", "start"), "laid")

    # what a path passes through before its own nodes, by owner: one interval each
    passed = paths.select("rank", "depth", "node").join(laid.select("node", "owner", "start", "size"), "node").groupBy("rank", "owner").agg(F.min("start").alias("from"), F.max(F.col("start") + F.col("size")).alias("to"), F.min("depth").alias("depth"))
    ways = passed.filter("owner < rank").groupBy("rank").agg(F.sort_array(F.collect_list(F.struct("depth", "from", "to"))).alias("way")).select(F.col("rank").alias("owner"), F.transform("way", lambda x: F.struct(x["from"].alias("from"), x["to"].alias("to"))).alias("way"))
    starting = F.aggregate("way", F.lit(0).cast("long"), lambda total, x: total + x["to"] - x["from"])
    none = F.array().cast("array<struct<from:bigint,to:bigint>>")
    lines = chains.select(F.col("rank").alias("owner"), "conv", "nodes").join(ways, "owner", "left").withColumn("way", F.coalesce("way", none)).withColumn("passed", starting)
    joined = laid.join(lines, "owner").join(turns.select("conv", "depth", "text", "loss_from", "loss_to"), ["conv", "depth"])
    own_way = F.array(F.struct(F.col("from").alias("from"), (F.col("start") + F.col("size")).alias("to")))
    nodes = joined.select("node", F.when(F.col("depth") > 1, F.get("nodes", F.col("depth") - 2)).alias("parent"), F.get("nodes", F.lit(0)).alias("tree"), "depth", "start", "size", (F.col("passed") + F.col("start") - F.col("from")).alias("position"), "text", "loss_from", "loss_to", F.concat("way", own_way).alias("attends"))
    return written(nodes, "trees"), paths.select("rank", "depth", "node"), places


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (rank, depth) -> a row for each rank, from the formatted text and its loss mask alone."""
    names = ["rank", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    last, out = None, []

    def ended() -> tuple:
        return (last[0], last[1], last[2].hexdigest(), last[3], last[4].hexdigest(), last[5])

    for batch in batches:
        for rank, text, a, b in zip(*(batch.column(c).to_pylist() for c in ("rank", "text", "loss_from", "loss_to")), strict=True):
            if last is None or last[0] != rank:
                if last:
                    out.append(ended())
                last = [rank, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, said = map(unescaped, _TURN.fullmatch(text).groups())
            learned = unescaped(text[a:b])
            last[1] += 1
            last[2].update(f"{role}\n{said}\n".encode())
            last[3] += len(learned)
            last[4].update(learned.encode())
            last[5] += len(text)
        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in out], schema=_SCHEMA)
        out = []
    if last:
        yield pa.RecordBatch.from_pylist([dict(zip(names, ended(), strict=True))], schema=_SCHEMA)


_SCHEMA = pa.schema([("rank", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def digests(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, read back from the trees."""
    nodes, paths, places = prefix_trees(conversations)
    n = shuffle_partitions(conversations.sparkSession)
    rows = paths.join(nodes.select("node", "text", "loss_from", "loss_to"), "node").select("rank", "depth", "text", "loss_from", "loss_to")
    read = rows.repartition(n, "rank").sortWithinPartitions("rank", "depth").mapInArrow(_read, "rank long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return places.join(read, "rank").select(F.when(F.col("conv") != _NONE, F.col("conv")).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


_PLUS = r"regexp_replace({}, '([<\[])(\\*/?(?:s>|INST\]))', '\1\\\2', 'g')"
SQL = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(22 + length({_PLUS.format('role')}) + length({_PLUS.format('text')}))::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
