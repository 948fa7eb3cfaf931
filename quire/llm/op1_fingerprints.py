"""Document fingerprints: MinHash by universal hash permutations over word shingles, in vectorised numpy.

Definitions: words are runs of characters other than ASCII white space, A-Z
in lower case; a shingle is five words, or all words of a shorter text. A
null text counts as empty; an empty text has the fingerprint of all-ones
values, which is like that of other empty texts only. Repeated rows get a row
each. Only doc_id and text are read, so extra columns don't matter; an empty
table gives an empty result. A null doc_id comes after all others.

Near duplicates: texts that agree in one of BANDS bands of BAND_ROWS values
are candidates, which finds a pair at SIMILARITY with a chance of 0.998, and
more alike ones almost surely. Bands join in Spark; texts that bands connect
come together once, and there each is compared with all others that it isn't
already connected with, by exact Jaccard of the shingle sets. So no link
between classes is lost, no pairs of a class are listed, and a text travels
once. Where more than CROWD texts (or CROWD_CHARS) are connected, they travel
to each of their bands' values instead, which are dealt out in slices that
all visit: memory stays bounded whatever the size of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quire.operators.graph import contracted

from .common import U64, Sieve, Words, lowered, mixed, pieces, raw, shingles, shuffle_partitions, utf8, written

SHINGLE, PERMUTATIONS, BANDS, BAND_ROWS, SIMILARITY = 5, 128, 20, 6, 0.8
#: Connected texts, and their characters, that one task compares.
CROWD, CROWD_CHARS = 4096, 16 << 20
#: Estimates this far below the similarity (seven deviations) aren't verified.
MARGIN = 0.25
#: Texts that a task remembers to have banded.
REMEMBERED = 1_000_000
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(1, 1 << 63, PERMUTATIONS, dtype=np.int64).astype(U64) << U64(1)) | U64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.int64).astype(U64)
_LEAST = np.iinfo(np.int64).min


def signatures(column: pa.LargeBinaryArray) -> np.ndarray:
    """16 bits of a mix of the whole least value of each permutation a*x+b, for each text.

    The top bits alone would be near zero for any long text, so unlike long
    texts would agree; the mix depends on all 64 bits.
    """
    out = np.full((len(column), PERMUTATIONS), 0xFFFF, np.uint16)
    for lo, hi in pieces(column):
        data, offsets = raw(column[lo:hi])
        words = Words(lowered(data), offsets)
        x, at = shingles(words.hashes(), words.first, SHINGLE)
        out[lo:hi] = _least(x >> U64(32), at)
    return out


def _least(x: np.ndarray, at: np.ndarray, width: int = 1024) -> np.ndarray:
    least = np.full((len(at) - 1, PERMUTATIONS), np.iinfo(np.uint64).max, U64)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    for lo in range(0, len(x), width):
        part, own = x[lo : lo + width], owner[lo : lo + width]
        heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        values = _A[:, None] * part[None, :]
        values += _B[:, None]
        rows = own[heads]
        least[rows] = np.minimum(least[rows], np.minimum.reduceat(values, heads, axis=1).T)
    out = (mixed(least) & U64(0xFFFF)).astype(np.uint16)
    out[np.diff(at) == 0] = 0xFFFF
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of permutations on which two fingerprints agree: an estimate of the Jaccard similarity."""
    return (a == b).mean(axis=1)


def as_hex(signature: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in signature.astype(">u2")]


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _text_id(text: Column) -> Column:
    """128 bits of its SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def fingerprint_with_edits(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text: its last half replaced by the start of the next text (descending doc_id, in a ring).

    The next text reaches its neighbour without a global sort: rows are dealt
    by ranges of doc_id, and the largest row of each range also goes, as a
    guest, to the range above. Each range is then read in order, a batch at a
    time; so whole texts are shuffled once. classes (doc_id, text_id,
    class_id) travel to the same places, ahead of the texts.
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text"))
    n = shuffle_partitions(spark)
    ranges = 4 * n
    bounds = np.unique(np.array(base.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.2 / ranges), dtype="float64")).astype("int64")

    def buckets(ids: pd.Series) -> np.ndarray:
        return np.searchsorted(bounds, ids.fillna(_LEAST).astype("int64").to_numpy(), "right").astype("int32")

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(buckets(ids))

    # one row for each range, by partial aggregation
    tops = sorted((r[0], _LEAST if r[1] is None else r[1]) for r in base.groupBy(bucket("doc_id").alias("b")).agg(F.max("doc_id")).collect())
    order = [b for b, _ in tops]
    above = {top: order[(i + 1) % len(order)] for i, (_, top) in enumerate(tops)}

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series) -> pd.Series:
        """The range of a row, then those that it visits."""
        own = buckets(ids)
        keys = ids.fillna(_LEAST).astype("int64").to_numpy()
        return pd.Series([[b, above[k]] if k in above else [b] for b, k in zip(own.tolist(), keys.tolist(), strict=True)])

    dealt = base.select("doc_id", "text", F.posexplode(places("doc_id")).alias("guest", "bucket"))
    none = {"text_id": F.lit(None).cast("binary"), "class_id": F.lit(None).cast("long")}
    if classes is None:
        dealt = dealt.withColumns(none)
    else:
        ahead = classes.select("doc_id", F.lit(None).cast("string").alias("text"), F.lit(0).alias("guest"), bucket("doc_id").alias("bucket"), "text_id", "class_id")
        dealt = dealt.withColumns({**none, "text_id": _text_id(F.col("text"))}).unionByName(ahead)
    # of one doc_id, texts come by their digests, and behind the class of each
    dealt = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), "text_id", F.col("text").asc_nulls_first())
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long"
    found = dealt.mapInArrow(_edited, schema)
    return found.drop("class_id") if classes is None else found


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None  # doc_id, bucket, text, fingerprint and class of the row before
    known = (None, None, None)  # document, text and class that were announced last
    for whole in batches:
        found = []
        for doc_id, text_id, class_id, announced in zip(*(whole.column(c).to_pylist() for c in ("doc_id", "text_id", "class_id")), whole.column("text").is_null().to_pylist(), strict=True):
            if announced:
                known = (doc_id, text_id, class_id)
            else:
                found.append(known[2] if known[:2] == (doc_id, text_id) else None)
        whole = whole.filter(whole.column("text").is_valid())
        column = whole.column("text")
        for lo, hi in pieces(utf8(column), 8 << 20):
            batch = whole.slice(lo, hi - lo)
            ids, bucket, guest = batch.column("doc_id").to_pylist(), batch.column("bucket").to_pylist(), batch.column("guest").to_pylist()
            texts, signature, classes = batch.column("text").to_pylist(), signatures(utf8(batch.column("text"))), found[lo:hi]
            if last:
                ids, bucket, guest, texts, classes = [last[0], *ids], [last[1], *bucket], [0, *guest], [last[2], *texts], [last[4], *classes]
                signature = np.concatenate([last[3][None], signature])
            pairs = [i for i in range(len(ids) - 1) if not guest[i] and bucket[i] == bucket[i + 1]]
            last = None if guest[-1] else (ids[-1], bucket[-1], texts[-1], signature[-1], classes[-1])
            if not pairs:
                continue
            edited = []
            for i in pairs:
                text = texts[i]
                half = len(text) // 2
                edited.append((text[: len(text) - half] + texts[i + 1][:half]).encode())
            own, other = signature[pairs], signatures(pa.array(edited, pa.large_binary()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[i] for i in pairs], pa.int64()),
                    pa.array([len(texts[i]) for i in pairs], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
                    pa.array(as_hex(own), pa.string()),
                    pa.array(as_hex(other), pa.string()),
                    pa.array(likeness(own, other), pa.float64()),
                    pa.array(likeness(own, signature[[i + 1 for i in pairs]]), pa.float64()),
                    pa.array([classes[i] for i in pairs], pa.int64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"],
            )


def _bands(signature: np.ndarray) -> np.ndarray:
    """A hash of each band's number and values (texts x BANDS)."""
    own = signature[:, : BANDS * BAND_ROWS].reshape(len(signature), BANDS, BAND_ROWS).astype(U64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), own.shape[:2]).copy()
    for k in range(BAND_ROWS):
        out = mixed(out * U64(0x9FB21C651E98DF25) + own[:, :, k])
    return out.view(np.int64)


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key (of a band's value) and mark (a hash of the text), for each text once a task."""
    seen: set[int] = set()
    for batch in batches:
        whole = utf8(batch.column("text"))
        for lo, hi in pieces(whole, 8 << 20):
            new = {}
            for i, text in enumerate(whole[lo:hi].to_pylist(), lo):
                mark = xxh64_intdigest(text, 42)
                if mark not in seen:
                    new.setdefault(mark, i)
            seen = seen | new.keys() if len(seen) < REMEMBERED else set(new)
            if new:
                keys = _bands(signatures(whole.take(pa.array(list(new.values())))))
                marks = np.repeat(np.array(list(new), U64).view(np.int64), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(marks)], names=["key", "mark"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, mark) -> links of each mark with the first of its key."""
    last = None
    for batch in batches:
        key, mark = batch.column("key").to_numpy(), batch.column("mark").to_numpy()
        if not len(key):
            continue
        heads = np.concatenate(([last is None or key[0] != last[0]], key[1:] != key[:-1]))
        first = mark[np.maximum.accumulate(np.where(heads, np.arange(len(key)), 0))]
        if not heads[0]:
            first[: int(np.argmax(heads)) if heads.any() else len(key)] = last[1]
        last = (key[-1], first[-1])
        apart = first != mark
        yield pa.RecordBatch.from_arrays([pa.array(first[apart]), pa.array(mark[apart])], names=["u", "v"])


class _Group:
    """Texts at home in one place, with labels of those that are linked."""

    def __init__(self):
        self.ids, self.sets, self.label = [], [], []
        self.prints = np.empty((16, PERMUTATIONS), np.uint16)

    def links(self, own: np.ndarray, print_: np.ndarray, similarity: float) -> list[int]:
        """Members that a text is alike to: one of each label that has any."""
        n = len(self.ids)
        near = (self.prints[:n] == print_).mean(axis=1)
        found, done = [], set()
        for k in np.argsort(-near, kind="stable").tolist():
            if near[k] < similarity - MARGIN:
                break
            if self.label[k] in done:
                continue
            common = len(np.intersect1d(own, self.sets[k], assume_unique=True))
            if common >= similarity * (len(own) + len(self.sets[k]) - common):
                found.append(k)
                done.add(self.label[k])
        return found

    def add(self, text_id: bytes, own: np.ndarray, print_: np.ndarray, linked: list[int]) -> None:
        n = len(self.ids)
        if n == len(self.prints):
            self.prints = np.concatenate((self.prints, np.empty_like(self.prints)))
        self.prints[n] = print_
        names = {self.label[k] for k in linked}
        if len(names) > 1:
            self.label = [n if x in names else x for x in self.label]
        self.ids.append(text_id)
        self.sets.append(own)
        self.label.append(n if len(names) != 1 else names.pop())


def _sets(column: pa.LargeBinaryArray) -> list[np.ndarray]:
    out = []
    for lo, hi in pieces(column):
        data, offsets = raw(column[lo:hi])
        words = Words(lowered(data), offsets)
        x, at = shingles(words.hashes(), words.first, SHINGLE)
        out += [np.unique(x[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    return out


def _verifier(similarity: float):
    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of (place, slice, visit) -> links u, v."""
        key, group = None, _Group()
        for batch in batches:
            whole = utf8(batch.column("text"))
            for lo, hi in pieces(whole, 4 << 20):
                column, part = whole[lo:hi], batch.slice(lo, hi - lo)
                u, v = [], []
                rows = zip(*(part.column(c).to_pylist() for c in ("place", "slice", "visit", "text_id")), _sets(column), signatures(column), strict=True)
                for place, slice_, visit, text_id, own, print_ in rows:
                    if (place, slice_) != key:
                        key, group = (place, slice_), _Group()
                    linked = group.links(own, print_, similarity)
                    u += [text_id] * len(linked)
                    v += [group.ids[k] for k in linked]
                    if not visit:
                        group.add(text_id, own, print_, linked)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], names=["u", "v"])

    return verified


def _rebanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = _bands(signatures(utf8(batch.column("text"))))
        yield pa.RecordBatch.from_arrays([batch.column("text_id"), batch.column("text"), pa.array(list(keys), pa.list_(pa.int64()))], names=["text_id", "text", "keys"])


def _links(docs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links u, v between text_ids whose components are those of all candidates at the similarity. texts: text_id, mark, doc_id."""
    n = shuffle_partitions(docs.sparkSession)
    keys = docs.select(_text().alias("text")).mapInArrow(_banded, "key long, mark long")
    stars = keys.repartition(n, "key").sortWithinPartitions("key", "mark").mapInArrow(_stars, "u long, v long")
    connected = contracted(stars)
    asked = written(texts.join(connected.withColumnRenamed("node", "mark"), "mark").select("text_id", "doc_id", "component"), "asked")
    sieve = Sieve(asked, ["doc_id", "text_id"])
    shown = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text().alias("text")).withColumn("text_id", _text_id(F.col("text")))
    shown = sieve.marked(shown)
    shown = shown.mapInArrow(sieve.over(True, iter), shown.schema).groupBy("text_id").agg(F.first("text").alias("text"))
    members = written(asked.select("text_id", "component").join(shown, "text_id"), "members")
    crowds = members.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).filter((F.col("n") > CROWD) | (F.col("chars") > CROWD_CHARS)).select("component", F.lit(True).alias("crowded"))
    crowds = written(crowds, "crowds")
    placed = members.join(crowds, "component", "left_anti").select(F.col("component").alias("place"), F.lit(0).alias("slice"), F.lit(0).alias("visit"), "text_id", "text")
    if not crowds.isEmpty():
        banded = written(members.join(crowds, "component", "left_semi").select("text_id", "text").mapInArrow(_rebanded, "text_id binary, text string, keys array<long>"), "rebanded")
        each = banded.select("text_id", "text", F.explode("keys").alias("key"))
        sizes = banded.select(F.explode("keys").alias("key"), F.length("text").alias("chars")).groupBy("key").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")).filter("n > 1")
        sizes = sizes.select("key", F.greatest(F.ceil(F.col("n") / CROWD), F.ceil(F.col("chars") / CROWD_CHARS)).cast("int").alias("slices"))
        spread = each.join(sizes, "key").withColumn("home", F.pmod(F.xxhash64("text_id"), F.col("slices")).cast("int"))
        spread = spread.select("text_id", "text", F.xxhash64(F.lit("band"), "key").alias("place"), "home", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"))
        placed = placed.unionByName(spread.withColumn("visit", (F.col("home") != F.col("slice")).cast("int")).drop("home"))
    placed = placed.repartition(n, "place", "slice").sortWithinPartitions("place", "slice", "visit")
    return placed.mapInArrow(_verifier(similarity), "u binary, v binary")


def _classes(docs: DataFrame, similarity: float) -> DataFrame:
    """text_id, class_id: a row for each distinct text."""
    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_id(_text()).alias("text_id"), F.xxhash64(_text()).alias("mark"))
    texts = written(each.groupBy("text_id", "mark").agg(F.min("doc_id").alias("doc_id")), "texts")
    found = written(contracted(_links(docs, texts, similarity)).withColumnRenamed("node", "text_id"), "classes")
    linked = found.join(texts, "text_id")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("class_id"))
    labels = found.join(least, "component").select("text_id", "class_id", F.lit(True).alias("linked"))
    return texts.join(labels, "text_id", "left").select("text_id", F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, text_id (128 bits of the text's SHA-256), class_id: the smallest doc_id that links reach (null if no row of the class has one).

    Equal texts are one class from the start; texts without words are alike.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_id(_text()).alias("text_id"))
    return own.join(_classes(docs, similarity), "text_id").select("doc_id", "text_id", "class_id")


def fingerprints_and_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """`fingerprint_with_edits` with class_id, as from `near_duplicates`."""
    return fingerprint_with_edits(docs, near_duplicates(docs, similarity).distinct())
