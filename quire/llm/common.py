"""Shared helpers: rows in boxes and vectorised word arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.shared import discard, shared_dir, written

__all__ = ["boxed", "discard", "lowered", "mixed", "pieces", "quoted", "raw", "shared_dir", "shingles", "shuffle_partitions", "text_of", "unboxed", "utf8", "written", "Sieve", "Words", "U64"]

U64 = np.uint64
#: [\x20\x09-\x0D]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once, so that scratch arrays stay in the cache.
_SPAN = 1 << 18
_powers: dict[str, np.ndarray] = {}


def quoted(name: str) -> str:
    """A column name as Spark's parser reads it back, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def boxed(docs: DataFrame, *read: str | Column) -> DataFrame:
    """`row`, a struct of all columns of docs, and the columns that an operator reads: names of its own can't clash with theirs.

    `unboxed` gives the columns of docs back as they were.
    """
    return docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), *read)


def unboxed(rows: DataFrame, *more: str | Column) -> DataFrame:
    return rows.select("row.*", *more)


def text_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """A column of the rows that a batch carries in boxes."""
    return batch.column("row").field(name)


class Sieve:
    """A Bloom table of fixed size: which rows may be among known ones, told in the tasks that read them.

    known has the key columns; bits are the two places of a row's key, from
    its columns of the same names. The more is known the more rows get past
    it, so a join must decide; nothing is lost.
    """

    WORDS = 1 << 20  # of 64 bits

    def __init__(self, known: DataFrame, keys: list[str]):
        spark = known.sparkSession
        self.bits = [F.pmod(F.xxhash64(F.lit(k), *keys), F.lit(64 * self.WORDS)) for k in range(2)]
        marks = known.select(F.explode(F.array(*self.bits)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("place")).agg(F.expr("bit_or(shiftleft(1L, CAST(bit & 63 AS INT)))").alias("bits"))
        table = np.zeros(self.WORDS, np.int64)
        for place, word in marks.toPandas().itertuples(index=False):  # WORDS rows at most
            table[place] = word
        self.table = spark.sparkContext.broadcast(table.view(U64))

    def marked(self, rows: DataFrame) -> DataFrame:
        """rows with the columns a and b, their places."""
        return rows.withColumns({"a": self.bits[0], "b": self.bits[1]})

    def over(self, may: bool, then: Callable) -> Callable:
        """An Arrow function: then, over the marked rows that may be known, or over the others."""
        table = self.table

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def own() -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    places = [batch.column(c).to_numpy() for c in ("a", "b")]
                    bits = [table.value[x >> 6] >> (x & 63).astype(U64) & U64(1) for x in places]
                    yield batch.filter(pa.array((bits[0] & bits[1]).astype(bool) == may))

            yield from then(own())

        return run


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(column: pa.Array) -> pa.LargeBinaryArray:
    """A string column as UTF-8 with 64-bit offsets; null becomes empty."""
    return column.cast(pa.large_string()).fill_null("").cast(pa.large_binary())


def raw(column: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column without nulls, and its n+1 offsets."""
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8))[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column: pa.LargeBinaryArray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each, so that scratch arrays stay small; a longer text makes its own range."""
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to
        at = to


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of many texts: start and end in data, and for each text the index of its first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        solid = ~_SPACE[data]
        before = np.empty_like(solid)
        after = np.empty_like(solid)
        if len(data):
            before[0], after[-1] = False, False
            before[1:], after[:-1] = solid[:-1], solid[1:]
            cuts = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
            before[cuts] = False
            after[cuts - 1] = False
        self.data = data
        self.start = np.flatnonzero(solid & ~before)
        self.end = np.flatnonzero(solid & ~after) + 1
        self.first = np.searchsorted(self.start, offsets)

    def hashes(self) -> np.ndarray:
        """64 bits for each word, of its bytes alone."""
        out = np.empty(len(self.start), U64)
        lo = 0
        while lo < len(out):
            base = self.start[lo]
            hi = max(lo + 1, int(np.searchsorted(self.end, base + _SPAN, "right")))
            part = self.data[base : self.end[hi - 1]]
            power, inverse = _power(len(part) + 1)
            total = np.zeros(len(part) + 1, U64)
            total[1:] = part
            total[1:] += U64(1)
            total[1:] *= power[: len(part)]
            np.cumsum(total, out=total)
            at = self.start[lo:hi] - base
            out[lo:hi] = (total[self.end[lo:hi] - base] - total[at]) * inverse[at]
            lo = hi
        return mixed(out)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 2 * _SPAN)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"], _powers["down"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return _LOWER[data]


def shingles(word: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of `size` words (a shorter text: one run of all its words) and n+1 offsets."""
    counts = np.diff(first)
    made = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    offsets = np.concatenate(([0], np.cumsum(made)))
    out = np.empty(offsets[-1], U64)
    if len(out) == 0:
        return out, offsets
    long = np.flatnonzero(counts >= size)
    if len(long):
        total = np.zeros(max(0, len(word) - size + 1), U64)
        for k in range(size):
            total = (total + word[k : k + len(total)]) * U64(0x9FB21C651E98DF25 + 2 * k)
        total = mixed(total)
        keep = np.repeat(counts >= size, made)
        at = np.arange(len(out)) - np.repeat(offsets[:-1], made) + np.repeat(first[:-1], made)
        out[keep] = total[at[keep]]
    for i in np.flatnonzero((counts < size) & (counts > 0)):
        total = U64(size - counts[i])
        with np.errstate(over="ignore"):
            for w in word[first[i] : first[i + 1]]:
                total = (total ^ w) * U64(_BASE)
        out[offsets[i]] = total
    return out, offsets
