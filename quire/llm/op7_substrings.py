"""Substring dedup: windows of 20 words that occur earlier, found in super-k-mers.

Words are [^\\x20\\x09-\\x0D]+, unchanged. Each window's minimiser is the least
hash of its 3-word runs; consecutive windows with one minimiser form a
super-k-mer, and travel as one string of words to the minimiser's bucket.
Equal windows have equal minimisers, so each bucket can sort its windows and
tell exactly which of them start earlier elsewhere (hashes order the windows,
their words decide). Before travelling, equal super-k-mers of a batch are
combined: only the earliest goes. Those that repeat are remembered by the
task, up to REMEMBERED bytes, and later copies stay too: so of a passage in a
third of all documents a bucket gets about one copy a task. Minimisers that a
sample finds very frequent are refined by a second minimiser; the list is a
hint, the same for all tasks, and any list gives the same result. The number of
partitions grows with the corpus, so that what a task reads and holds does not.

Null and empty texts have no words. Documents are ordered by doc_id (null
last), then by a checksum of the text, so rows with one doc_id and unlike
texts are judged in that order; rows equal in both get the same result. Only
doc_id and text are read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import U64, Sieve, Words, _power, boxed, mixed, pieces, raw, shuffle_partitions, text_of, utf8, written

WINDOW, MINIMISER, LONGEST = 20, 3, 256
#: Buckets of a partition, which are judged one after another.
BUCKETS = 8
#: Windows of a bucket that are sorted at once; more take several passes.
AT_ONCE = 500_000
#: Super-k-mers of a shuffle partition, about; bytes of repeated ones that a task remembers.
A_PARTITION, REMEMBERED = 100_000, 16 << 20
#: Bytes of text whose super-k-mers are packed together, those for one partition as one compressed string.
PACKED = 4 << 20
#: One document in so many is read to find frequent minimisers.
SAMPLE = 64
_LAST = np.iinfo(np.int64).max


def _normal(column: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
    return pa.array([b" ".join(x.split()) for x in column.to_pylist()], pa.large_binary())


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values (fewer at the end)."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x, np.concatenate((x[step:], np.full(min(step, len(x)), ~U64(0)))))
        have += step
    return x


def _runs(words: Words, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of windows and minimiser of each super-k-mer; hashes of words."""
    word = words.hashes()
    n = len(word)
    padded = np.concatenate((word, np.zeros(MINIMISER, U64)))
    grams = mixed(padded[:n] * U64(0xD6E8FEB86659FD93) + padded[1 : n + 1] * U64(0xA3B195354A39B70D) + padded[2 : n + 2] * U64(0x1B03738712FAD5C9))
    least = _least(grams, WINDOW - MINIMISER + 1)
    if len(hot):
        again = _least(mixed(grams ^ U64(0x5851F42D4C957F2D)), WINDOW - MINIMISER + 1)
        least = np.where(np.isin(least, hot), mixed(least + again * U64(0x2545F4914F6CDD1D)), least)
    counts = np.diff(words.first)
    left = np.repeat(words.first[1:], counts) - np.arange(n)
    valid = left >= WINDOW
    head = valid.copy()
    head[1:] &= ~valid[:-1] | (least[1:] != least[:-1])
    at = np.flatnonzero(valid)
    if not len(at):
        return at, at, least[at], word
    own = np.cumsum(head[at]) - 1
    inside = np.arange(len(at)) - np.flatnonzero(head[at])[own]
    head[at] |= inside % LONGEST == 0
    start = np.flatnonzero(head)
    size = np.diff(np.append(np.searchsorted(at, start), len(at)))
    return start, size, least[start], word


def _sums(word: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A hash of the words from at up to to."""
    power, inverse = _power(len(word) + 1)
    total = np.zeros(len(word) + 1, U64)
    np.cumsum(word * power[: len(word)], out=total[1:])
    return mixed((total[to] - total[at]) * inverse[at])


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = _normal(utf8(batch.column("text")))
        for lo, hi in pieces(column):
            yield pa.RecordBatch.from_arrays([pa.array(_runs(Words(*raw(column[lo:hi])), np.zeros(0, U64))[2].view(np.int64))], names=["least"])


def _packer(partitions: int, hot: np.ndarray):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        seen: dict[bytes, tuple] = {}  # repeated super-k-mers: where the earliest starts that went
        room = REMEMBERED
        for batch in batches:
            ids = batch.column("doc_id").fill_null(_LAST).to_numpy(zero_copy_only=False)
            checks = batch.column("mark").to_numpy(zero_copy_only=False)
            whole = utf8(batch.column("text"))
            for lo, hi in pieces(whole, PACKED):
                column = _normal(whole[lo:hi])
                data, offsets = raw(column)
                words = Words(data, offsets)
                start, size, least, word = _runs(words, hot)
                if not len(start):
                    continue
                to = start + size + WINDOW - 1
                digest = _sums(word, start, to)
                doc = np.searchsorted(words.first, start, "right") - 1
                at = start - words.first[doc]
                doc_id, mark = ids[lo:hi][doc], checks[lo:hi][doc]
                head, tail, text = words.start[start], words.end[to - 1], data.tobytes()
                order = np.lexsort((at, mark, doc_id, digest))
                again = np.flatnonzero(digest[order][1:] == digest[order][:-1]) + 1
                goes = np.ones(len(start), bool)
                earliest = np.arange(len(order))
                earliest[again] = 0
                earliest = order[np.maximum.accumulate(earliest)]
                for i in again:
                    a, b = order[i], earliest[i]
                    if (doc_id[a], mark[a], at[a]) != (doc_id[b], mark[b], at[b]):
                        goes[a] = (words_of := text[head[a] : tail[a]]) != text[head[b] : tail[b]]
                        if not goes[a] and words_of not in seen and room > 0:
                            seen[words_of] = (_LAST, 0, 0)
                            room -= len(words_of) + 200
                for i in np.flatnonzero(goes).tolist() if seen else ():
                    if (before := seen.get(key := text[head[i] : tail[i]])) is not None:
                        spot = (int(doc_id[i]), int(mark[i]), int(at[i]))
                        if before < spot and before[0] != _LAST:
                            goes[i] = False
                        elif spot < before:
                            seen[key] = spot
                rows, blobs = [], []
                stay = np.flatnonzero(~goes)
                if len(stay):
                    rows.append(-1)
                    blobs.append(_blob(doc_id[stay], mark[stay], at[stay], size[stay].astype(np.int32).tobytes()))
                bucket = (least[goes] % U64(partitions * BUCKETS)).astype(np.int64)
                sent = np.flatnonzero(goes)[np.argsort(bucket, kind="stable")]
                bucket = np.sort(bucket)
                part, sub = bucket // BUCKETS, (bucket % BUCKETS).astype(np.uint8)
                strings = [text[a:b] for a, b in zip(head[sent].tolist(), tail[sent].tolist(), strict=True)]
                cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sent)], strict=True):
                    own = sent[a:b]
                    rows.append(int(part[a]))
                    blobs.append(squeeze(_blob(doc_id[own], mark[own], at[own], sub[a:b].tobytes() + b"\n".join(strings[a:b]))))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    return pack


def _blob(doc_id: np.ndarray, mark: np.ndarray, at: np.ndarray, rest: bytes) -> bytes:
    return struct.pack("<q", len(doc_id)) + np.diff(doc_id, prepend=np.int64(0)).tobytes() + mark.astype(np.int32).tobytes() + at.astype(np.int32).tobytes() + rest


def _open(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    (n,) = struct.unpack_from("<q", blob)
    return np.cumsum(np.frombuffer(blob, np.int64, n, 8)), np.frombuffer(blob, np.int32, n, 8 + 8 * n), np.frombuffer(blob, np.int32, n, 8 + 12 * n), blob[8 + 16 * n :]


def _found(doc_id: np.ndarray, mark: np.ndarray, at: np.ndarray, size: np.ndarray) -> pa.Table:
    return pa.table({"doc_id": pa.array(doc_id.astype(np.int64)), "mark": pa.array(mark.astype(np.int32)), "at": pa.array(at.astype(np.int32)), "size": pa.array(size.astype(np.int32))})


def _judge_all(table: pa.Table) -> pa.Table:
    """Runs of windows of one partition that start earlier elsewhere, a bucket at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    parts: list[list] = [[] for _ in range(BUCKETS)]
    for blob in table.column("blob").to_pylist():
        doc_id, mark, at, rest = _open(unpack(blob))
        n = len(doc_id)
        edges = np.searchsorted(np.frombuffer(rest, np.uint8, n), np.arange(BUCKETS + 1))
        strings = rest[n:].split(b"\n")
        for k, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if a < b:
                parts[k].append((doc_id[a:b], mark[a:b], at[a:b], b"\n".join(strings[a:b])))
    found = []
    while parts:
        if own := parts.pop():
            found.append(_judge(own))
    return pa.concat_tables(found)


def _judge(parts: list[tuple]) -> pa.Table:
    """The same of one bucket."""
    doc_id, mark, at = (np.concatenate([x[i] for x in parts]) for i in range(3))
    text = b"\n".join(x[3] for x in parts)
    data = np.frombuffer(text, np.uint8)
    offsets = np.concatenate(([0], np.flatnonzero(data == 0x0A) + 1, [len(data)]))
    words = Words(data, offsets)
    word = words.hashes()
    made = np.diff(words.first) - WINDOW + 1
    passes = -(-int(made.sum()) // AT_ONCE)
    out = [_found(*[np.zeros(0, np.int64)] * 4)]
    own = np.repeat(np.arange(len(made)), made)
    place = np.arange(len(own)) - np.repeat(np.cumsum(made) - made, made)
    start = words.first[own] + place
    digest = _sums(word, start, start + WINDOW)
    for k in range(passes):
        mine = np.flatnonzero(digest % U64(passes) == U64(k)) if passes > 1 else np.arange(len(digest))
        s, w = own[mine], place[mine]
        order = np.lexsort((at[s] + w, mark[s], doc_id[s], digest[mine]))
        mine = mine[order]
        s, w, d = own[mine], place[mine], digest[mine]
        heads = np.concatenate(([True], d[1:] != d[:-1]))
        first = np.maximum.accumulate(np.where(heads, np.arange(len(d)), 0))
        t, v = s[first], w[first]
        later = np.flatnonzero((doc_id[s] != doc_id[t]) | (mark[s] != mark[t]) | (at[s] + w != at[t] + v))
        if not len(later):
            continue
        # in order of their super-k-mers, windows that repeat consecutive windows are compared as one passage
        later = later[np.lexsort((w[later], s[later]))]
        s, w, t, v, e = s[later], w[later], t[later], v[later], first[later]
        cut = np.concatenate(([True], (s[1:] != s[:-1]) | (w[1:] != w[:-1] + 1) | (t[1:] != t[:-1]) | (v[1:] != v[:-1] + 1)))
        a = np.flatnonzero(cut)
        n = np.diff(np.append(a, len(cut)))
        x, y = words.first[s[a]] + w[a], words.first[t[a]] + v[a]
        span = n + WINDOW - 2
        same = [text[p:q] == text[r:z] for p, q, r, z in zip(words.start[x].tolist(), words.end[x + span].tolist(), words.start[y].tolist(), words.end[y + span].tolist(), strict=True)]
        if not all(same):  # unlike words with one hash: sort those groups by their words
            return _by_words(doc_id, mark, at, text, words, own, place)
        out.append(_found(doc_id[s[a]], mark[s[a]], at[s[a]] + w[a], n))
    return pa.concat_tables(out)


def _by_words(doc_id, mark, at, text, words, own, place) -> pa.Table:
    start = words.first[own] + place
    seen: dict[bytes, tuple] = {}
    keys = [text[a:b] for a, b in zip(words.start[start].tolist(), words.end[start + WINDOW - 1].tolist(), strict=True)]
    spots = list(zip(doc_id[own].tolist(), mark[own].tolist(), (at[own] + place).tolist(), strict=True))
    for key, spot in zip(keys, spots, strict=True):
        seen[key] = min(spot, seen.get(key, spot))
    found = np.array([spot for key, spot in zip(keys, spots, strict=True) if spot != seen[key]], np.int64).reshape(-1, 3)
    return _found(found[:, 0], found[:, 1], found[:, 2], np.ones(len(found), np.int64))


def _mark() -> Column:
    return (F.crc32(F.coalesce("text", F.lit("")).cast("binary")) - F.lit(1 << 31)).cast("int")


def repeated(docs: DataFrame) -> DataFrame:
    """doc_id (null: the greatest long), mark (checksum of the text), at, size: runs of windows whose words start earlier elsewhere."""
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _mark().alias("mark"))
    sample = base.filter(F.pmod(F.xxhash64("doc_id", "mark"), F.lit(SAMPLE)) == 0).select("text").mapInArrow(_sampled, "least long").groupBy("least").count()
    total = sample.agg(F.sum("count")).first()[0] or 0
    n = max(shuffle_partitions(spark), total * SAMPLE // A_PARTITION)
    # at most 4n rows
    hot = np.sort(np.array([r[0] for r in sample.filter(F.col("count") > max(8, total / (4 * n))).collect()], np.int64).view(U64))
    schema = "doc_id long, mark int, at int, size int"
    packed = base.mapInArrow(_packer(n, hot), "part long, blob binary")
    # runs settled in their task take no part in the sort: they go to groups of their own
    spread = packed.withColumn("group", F.when(F.col("part") < 0, -1 - F.pmod(F.xxhash64("blob"), F.lit(n))).otherwise(F.col("part"))).repartition(n, "group")

    def judge(table: pa.Table) -> pa.Table:
        if table.column("part")[0].as_py() < 0:
            return pa.concat_tables(_found(*(x := _open(b))[:3], np.frombuffer(x[3], np.int32)) for b in table.column("blob").to_pylist())
        return _judge_all(table)

    return spread.groupBy("group").applyInArrow(judge, schema)


def covered(runs: list[dict], n: int) -> np.ndarray:
    """Which of n words lie in a window of the runs."""
    step = np.zeros(n + 1, np.int64)
    at, size = np.array([r["at"] for r in runs], np.int64), np.array([r["size"] for r in runs], np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + size + WINDOW - 1, -1)
    return np.cumsum(step[:-1]) > 0


def _left(text: str | None, runs: list[dict] | None) -> tuple[int, list[bytes]]:
    """How many words a text has, and those not covered."""
    words = (text or "").encode().split()
    if not runs:
        return len(words), words
    return len(words), [w for w, gone in zip(words, covered(runs, len(words)).tolist(), strict=True) if not gone]


def _runs_of(batch: pa.RecordBatch) -> list:
    return batch.column("runs").to_pylist() if "runs" in batch.schema.names else [None] * len(batch)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(n, n - len(left), hashlib.sha256(b" ".join(left)).hexdigest()) for n, left in map(_left, text_of(batch).to_pylist(), _runs_of(batch))]
        n, gone, digest = zip(*found, strict=True) if found else ((), (), ())
        yield pa.RecordBatch.from_arrays([text_of(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.column("row")
        texts = [b" ".join(_left(text, runs)[1]).decode() if runs else text for text, runs in zip(text_of(batch).to_pylist(), _runs_of(batch), strict=True)]
        names = [f.name for f in rows.type]
        kept = [pa.array(texts, pa.string()) if c == "text" else rows.field(k) for k, c in enumerate(names)]
        yield pa.RecordBatch.from_arrays(kept, names=names)


def _split(docs: DataFrame, finish: Callable, schema: str | StructType) -> DataFrame:
    """finish (an Arrow function) over the rows of docs in boxes, with runs where a row may have some; only those are shuffled."""
    runs = written(repeated(docs).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("at", "size")).alias("runs")), "runs").withColumnRenamed("doc_id", "id")
    sieve = Sieve(runs, ["id", "mark"])
    own = sieve.marked(boxed(docs, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), _mark().alias("mark")))
    some = own.mapInArrow(sieve.over(True, iter), own.schema).join(runs, ["id", "mark"], "left").select("row", "runs")
    return own.mapInArrow(sieve.over(False, finish), schema).unionByName(some.mapInArrow(finish, schema))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256: a row for each row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _split(base, _digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs, where the text of documents that lose words is their other words, joined by spaces."""
    return _split(docs, _cut, docs.schema)


SQL = f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - {WINDOW - 1})) AS pos FROM d WHERE len(w) >= {WINDOW}),
x AS (SELECT doc_id, pos, array_to_string(w[pos + 1:pos + {WINDOW}], ' ') AS s FROM p),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY s ORDER BY doc_id, pos) AS n FROM x),
g AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {WINDOW})) AS pos FROM r WHERE n > 1),
l AS (SELECT doc_id, list(pos) AS gone FROM g GROUP BY doc_id),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept FROM e ANTI JOIN g USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN l USING (doc_id) LEFT JOIN k USING (doc_id)"""
