"""Language ID as a mixture of languages, by expectation-maximisation.

A model has, for each language, the likelihood of each byte trigram of
lower-cased text (non-letters of ASCII as space; trigrams hashed to 16 bits,
add-half smoothing), learned from all training texts. A text's trigrams are a
mixture of languages and a flat noise part; EM estimates the proportions. The
language set is chosen by penalised likelihood: languages join in order of
their proportion as long as each raises the log-likelihood by more than the
penalty. The prediction is the largest of the chosen set, the score its
proportion; explained is the proportion of the whole set, all but noise.

Null texts and texts without a letter are `und` with score and explained 0, as is every
text if nothing could be learned. Repeated rows get a row each, extra columns
aren't read, an empty table gives no rows, a null doc_id is never held out.
Every label is learned. A model of more than MOST_BYTES (4,096 labels) is an
error, as workers hold it whole; no label is ever left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import boxed, discard, pieces, quoted, text_of, unboxed, utf8, written

GRAMS, ROUNDS = 1 << 16, 12
#: Size of the broadcast model, and labels whose counts come to the driver at once.
MOST_BYTES, AT_ONCE = 1 << 30, 32
#: Log-likelihood that a further language must add, for each doubling of the trigrams; neighbouring trigrams share letters, so this is more than half of log 2.
PENALTY = 4.0
_letter = regex.compile(r"\p{L}").search
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = [c if chr(c).isalpha() else 0x20 for c in range(128)]


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of texts with a space at each end, and the text each is from."""
    lowered = [b" " + t.decode().lower().encode() + b" " for t in texts]
    data = _FOLD[np.frombuffer(b"".join(lowered), np.uint8)]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
    owner = np.repeat(np.arange(len(lowered)), sizes)
    code = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    keep = (owner[2:] == owner[:-2]) & (code != 0x202020)
    return (code[keep] * np.uint32(0x9E3779B1)) >> np.uint32(16), owner[:-2][keep]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        column, langs = utf8(batch.column("text")), np.array(batch.column("lang").to_pylist(), object)
        for lo, hi in pieces(column):
            gram, owner = _grams(column[lo:hi].to_pylist())
            names, at = np.unique(langs[lo:hi].astype(str), return_inverse=True)
            both = np.bincount(at[owner] * GRAMS + gram, minlength=len(names) * GRAMS).reshape(-1, GRAMS)
            for name, row in zip(names.tolist(), both, strict=True):
                counts[name] = counts.get(name, 0) + row
    for name, row in counts.items():
        some = np.flatnonzero(row)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(row[some], pa.int64())], names=["lang", "gram", "n"])


def learn(training: DataFrame) -> tuple[list[str], np.ndarray]:
    """text, lang -> names and log-likelihoods (GRAMS x names) from all rows; counts of AT_ONCE labels at a time reach the driver."""
    known = training.filter("text is not null and lang is not null").select("text", "lang")
    counts = written(known.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    most = MOST_BYTES // (4 * GRAMS)
    names = sorted(r[0] for r in counts.select("lang").distinct().limit(most + 1).collect())
    if len(names) > most:
        raise ValueError(f"more than {most} labels: the model would not fit in {MOST_BYTES} bytes")
    log = np.empty((GRAMS, len(names)), np.float32)
    for at in range(0, len(names), AT_ONCE):
        part = names[at : at + AT_ONCE]
        rows = counts.filter(F.col("lang").between(part[0], part[-1])).toPandas()
        own = np.full((GRAMS, len(part)), 0.5)
        own[rows["gram"].to_numpy(), np.searchsorted(np.array(part, object), rows["lang"].to_numpy(object))] += rows["n"].to_numpy()
        log[:, at : at + len(part)] = np.log(own / own.sum(axis=0))
    discard(counts)
    return names, log


def _mixture(p: np.ndarray, n: np.ndarray, heads: np.ndarray, owner: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM for each text: proportions (texts x parts) and log-likelihoods. p: likelihood of each trigram under each part."""
    share = np.full((len(total), p.shape[1]), 1 / p.shape[1], p.dtype)
    for _ in range(ROUNDS):
        joint = p * share[owner]
        joint *= (n / joint.sum(axis=1))[:, None]
        share = np.add.reduceat(joint, heads, axis=0) / total[:, None]
    return share, np.add.reduceat(n * np.log((p * share[owner]).sum(axis=1)), heads)


def predict(texts: list[bytes], log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The language number (-1: none) and score of each text."""
    return explain(texts, log)[:2]


def explain(texts: list[bytes], log: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The language number (-1: none) and score of each text, and the share that the whole chosen set explains."""
    best, score, explained = np.full(len(texts), -1), np.zeros(len(texts)), np.zeros(len(texts))
    some = np.array([i for i, t in enumerate(texts) if _letter(t.decode())], dtype=int)
    if not len(some) or not log.shape[1]:
        return best, score, explained
    gram, owner = _grams([texts[i] for i in some])
    key = np.sort(owner * GRAMS + gram)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    n = np.diff(np.append(first, len(key))).astype(np.float32)
    gram, owner = key[first] % GRAMS, key[first] // GRAMS
    heads = np.searchsorted(owner, np.arange(len(some)))
    total = np.add.reduceat(n, heads)
    width = log.shape[1]
    p = np.empty((len(gram), width + 1), np.float32)
    p[:, :width] = np.exp(log[gram])
    p[:, width] = 1 / GRAMS
    share, most = _mixture(p, n, heads, owner, total)
    order = np.argsort(-share[:, :width], axis=1, kind="stable")
    # one language and noise, then two, and so on, for those that may gain
    fee = PENALTY * np.log2(total + 1)
    chosen, value, kept, known = order[:, 0].copy(), np.full(len(some), -np.inf), np.zeros(len(some)), np.zeros(len(some))
    going = np.arange(len(some))
    for k in range(1, width + 1):
        inside = np.isin(owner, going)
        at = np.searchsorted(going, owner[inside])
        parts = np.concatenate((order[going, :k], np.full((len(going), 1), width)), axis=1)
        own = np.take_along_axis(p[inside], parts[at], axis=1)
        share, found = _mixture(own, n[inside], np.searchsorted(at, np.arange(len(going))), at, total[going])
        better = found - fee[going] * k > value[going]
        rows = going[better]
        top = share[better, :k].argmax(axis=1)
        chosen[rows], kept[rows], value[rows] = parts[better][np.arange(len(rows)), top], share[better][np.arange(len(rows)), top], found[better] - fee[rows] * k
        known[rows] = share[better, :k].sum(axis=1)
        going = rows[most[rows] - fee[rows] * (k + 1) > value[rows]]
        if not len(going):
            break
    best[some], score[some], explained[some] = chosen, np.minimum(kept, 1), np.minimum(known, 1)
    return best, score, explained


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _identified(rows: DataFrame, training: DataFrame) -> DataFrame:
    """rows in boxes -> row, lang_pred, score, explained."""
    names, log = learn(training)
    model = rows.sparkSession.sparkContext.broadcast((names, log))  # MOST_BYTES at most
    room = max(1, (1 << 20) // max(1, len(names) // 64))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, log = model.value
        for batch in batches:
            column = utf8(text_of(batch))
            for lo, hi in pieces(column, room):
                best, score, explained = explain(column[lo:hi].to_pylist(), log)
                found = pa.array([names[k] if k >= 0 else "und" for k in best], pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(lo, hi - lo), found, pa.array(score, pa.float64()), pa.array(explained, pa.float64())], names=["row", "lang_pred", "score", "explained"])

    more = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("explained", DoubleType())]
    return rows.mapInArrow(scored, StructType([*rows.select("row").schema.fields, *more]))


def identify(docs: DataFrame, training: DataFrame) -> DataFrame:
    """docs with lang_pred, score and explained (in place of columns of these names). training: text, lang."""
    kept = [F.col(quoted(c)) for c in docs.columns if c not in ("lang_pred", "score", "explained")]
    return unboxed(_identified(boxed(docs.select(*kept)), training), "lang_pred", "score", "explained")


def explained(docs: DataFrame, training: DataFrame, least: float) -> DataFrame:
    """The rows of docs whose text has letters and languages that together explain at least this share of it."""
    return unboxed(_identified(boxed(docs), training).filter((F.col("lang_pred") != "und") & (F.col("explained") >= least)))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents that are not held out."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    found = identify(base, docs.filter(~held_out()))
    return found.select("doc_id", "held_out", "lang_pred", "score")
