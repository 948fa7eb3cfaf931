"""SimHash near-duplicates: fingerprints compared around the anchors of a covering code.

Fingerprint: A-Z lower-cased, words [^\\x20\\x09-\\x0D]+, 3-word shingles with
repeats, joined by spaces (fewer words: all of them; none: fingerprint zero);
h is XXH64 of a shingle (UTF-8, seed 42); a bit is set if it is set in over
half the h. Fingerprints at 3 or fewer differing bits link; equal ones are
one node, whatever their number.

Covering: a pair within 3 bits has a half (32 bits) with at most one
differing bit. On 31 bits of each half the Hamming code [31,26] is perfect:
every word is within 1 of one anchor, its home. So the other fingerprint of
the pair is within 1+1 of that home, and each fingerprint visits all anchors
within 2 (at most 16 a half). Per anchor, visitors are compared with those at
home, and a spanning forest of the links found is kept: no pairs of a dense
group are listed, and no link between components is lost. An anchor with many
at home is dealt out in slices, each of which sees all visitors.

Null texts count as empty. Rows with equal doc_id get a row each; a null
doc_id is linked like any other but is never a component_id, unless no other
is in reach. Only doc_id and text are read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quire.operators.graph import contracted

from .common import U64, boxed, pieces, shuffle_partitions, unboxed, utf8, written

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Most fingerprints at home that one task compares with the visitors of their anchor.
AT_HOME = 4096


def fingerprints(column: pa.LargeBinaryArray) -> np.ndarray:
    out = np.zeros(len(column), U64)
    for lo, hi in pieces(column):
        hashes, counts = [], []
        for text in column[lo:hi].to_pylist():
            words = text.lower().split()
            line = b" ".join(words)
            n = len(words) - SHINGLE + 1
            if n <= 1:
                hashes += [xxh64_intdigest(line, SEED)] * bool(words)
                counts.append(int(bool(words)))
                continue
            gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
            starts, ends = [0, *(gaps[: n - 1] + 1).tolist()], [*gaps[SHINGLE - 1 :].tolist(), len(line)]
            hashes += [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, ends, strict=True)]
            counts.append(n)
        n = np.array(counts)
        some = np.flatnonzero(n)
        if len(some):
            at = np.concatenate(([0], np.cumsum(n[some])))
            bits = np.unpackbits(np.array(hashes, U64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones = np.add.reduceat(bits, at[:-1], axis=0, dtype=np.int32)
            out[lo + some] = np.packbits(2 * ones > n[some][:, None], axis=1, bitorder="little").view(U64)[:, 0]
    return out


def _fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(fingerprints(utf8(batch.column("text"))).view(np.int64))], names=["doc_id", "mark", "print"])


def _syndrome(x: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x), np.int64)
    for i in range(31):
        s ^= ((x >> i) & 1) * (i + 1)
    return s


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the fingerprint, anchor, and whether it visits (1) or is at home (0)."""
    who, keys, visits = [], [], []
    index = np.arange(len(prints))
    for half in (0, 1):
        x = ((prints >> U64(32 * half)) & U64(0x7FFFFFFF)).astype(np.int64)
        s, top = _syndrome(x), np.int64(half << 31)
        home = np.where(s > 0, x ^ (np.int64(1) << np.maximum(s - 1, 0)), x)
        for visit in (0, 1):
            who.append(index)
            keys.append(home | top)
            visits.append(np.full(len(x), visit, np.int32))
        for a in range(1, 32):
            b = a ^ s
            two = np.flatnonzero((s > 0) & (a < b))
            who.append(two)
            keys.append((x[two] ^ (1 << (a - 1)) ^ (np.int64(1) << (b[two] - 1))) | top)
            visits.append(np.ones(len(two), np.int32))
    return np.concatenate(who), np.concatenate(keys), np.concatenate(visits)


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column("print").to_numpy().view(U64)
        who, keys, visits = anchors(prints)
        yield pa.RecordBatch.from_arrays([pa.array(prints[who].view(np.int64)), pa.array(keys), pa.array(visits)], names=["print", "anchor", "visit"])


def _forest(home: np.ndarray, visitors: np.ndarray, label: np.ndarray, out: list) -> None:
    """Adds links of visitors to those at home until label has the components; changes label in place."""
    step = max(1, (1 << 21) // len(home))
    for lo in range(0, len(visitors), step):
        part = visitors[lo : lo + step]
        near = np.bitwise_count(part[:, None] ^ home[None, :]) <= RADIUS
        near[part[:, None] == home[None, :]] = False
        some = np.flatnonzero(near.any(axis=1))
        if not len(some):
            continue
        out.append((part[some], home[near[some].argmax(axis=1)]))
        at = {int(p): i for i, p in enumerate(home)}
        for row in some:
            if label.min() == label.max():
                break
            linked = np.flatnonzero(near[row])
            if (own := at.get(int(part[row]))) is not None:
                linked = np.append(linked, own)
            names, first = np.unique(label[linked], return_index=True)
            if len(names) > 1:
                ends = home[linked[first]]
                out.append((np.full(len(ends), part[row]), ends))
                label[np.isin(label, names)] = names[0]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (anchor, slice, visit): those at home come before the visitors."""
    key, home, label = None, np.zeros(0, U64), None
    for batch in batches:
        out: list = []
        prints = batch.column("print").to_numpy().view(U64)
        anchor, part, visit = (batch.column(c).to_numpy() for c in ("anchor", "slice", "visit"))
        heads = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1]))))
        ends = np.append(heads[1:], len(anchor))
        at_home = np.add.reduceat(1 - visit, heads)
        first, last = (int(anchor[0]), int(part[0])) == key, len(heads) - 1
        useful = np.flatnonzero((at_home > 0) & (ends - heads - at_home > 1))
        for r in np.unique(np.concatenate((useful, [0] * first, [last])).astype(int)):
            if not (r == 0 and first):
                key, home, label = (int(anchor[heads[r]]), int(part[heads[r]])), np.zeros(0, U64), None
            cut = heads[r] + at_home[r]
            if at_home[r]:
                home = np.unique(np.concatenate((home, prints[heads[r] : cut])))
            if len(home) and cut < ends[r]:
                label = np.arange(len(home)) if label is None else label
                _forest(home, prints[cut : ends[r]], label, out)
        if out:
            u, v = (np.concatenate([x[i] for x in out]).view(np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def links(prints: DataFrame) -> DataFrame:
    """Distinct fingerprints (print long) -> links u, v whose components are those of all links within RADIUS bits."""
    spark = prints.sparkSession
    placed = prints.mapInArrow(_anchored, "print long, anchor long, visit int")
    crowds = placed.filter("visit = 0").groupBy("anchor").agg(F.ceil(F.count("*") / AT_HOME).cast("int").alias("slices")).filter("slices > 1")
    crowds = written(crowds, "anchors")
    dealt = placed.withColumn("slice", F.lit(0))
    if not crowds.isEmpty():
        spread = placed.join(crowds, "anchor", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
        own = F.array(F.pmod(F.xxhash64("print"), F.col("slices")).cast("int"))
        dealt = spread.select("print", "anchor", "visit", F.explode(F.when(F.col("visit") == 0, own).otherwise(F.sequence(F.lit(0), F.col("slices") - 1))).alias("slice"))
    dealt = dealt.repartition(shuffle_partitions(spark), "anchor", "slice").sortWithinPartitions("anchor", "slice", "visit")
    return dealt.mapInArrow(_linked, "u long, v long")


def _mark() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, mark (a hash of the text), print, first: the doc_id and mark of the first row (null last) of its component."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), "text")
    known = written(base.mapInArrow(_fingerprinted, "doc_id long, mark long, print long"), "simhash")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")
    nodes = written(known.groupBy("print").agg(F.min(row).alias("least")), "prints")
    found = contracted(links(nodes.select("print")))
    joined = nodes.join(found, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("component", "print").alias("component"))
    label = joined.join(joined.groupBy("component").agg(F.min("least").alias("first")), "component").select("print", "first")
    return known.join(label, "print")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach): a row for each row."""
    return _labelled(docs).select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs without all but the first (by doc_id, null last) of each component."""
    own = F.col("doc_id").cast("long")
    keys = ["own", "mark", "void"]
    first = _labelled(docs).select("first.*").distinct().select(F.coalesce("doc_id", F.lit(0)).alias("own"), "mark", F.col("none").alias("void"))
    kept = boxed(docs, F.coalesce(own, F.lit(0)).alias("own"), _mark().alias("mark"), own.isNull().alias("void")).join(first, keys, "left_semi")
    return unboxed(kept.dropDuplicates(keys))
