"""Against brute force, on odd rows and on the smallest table."""

import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quire.llm import op1_fingerprints as op1
from quire.llm import op2_simhash as op2
from quire.llm import op7_substrings as op7
from quire.operators.graph import components

WORD = re.compile("[^\x20\x09-\x0d]+")


def odd_rows(seed=5):
    r = random.Random(seed)
    vocabulary = ["the", "of", "Ünder", "x", "été", "long-er", "A", "b,", "日本", "z" * 30]
    texts = [None, "", " \n\t ", "one", "one two", "a b c d", " ".join(["same"] * 200)]
    base = [r.choice(vocabulary) for _ in range(120)]
    texts += [" ".join(base)] * 3 + ["  \n".join(base)]
    for k in (3, 40, 90):
        edited = list(base)
        edited[k] = "edit"
        texts.append(" ".join(edited))
    texts += [" ".join(r.choice(vocabulary) for _ in range(r.randrange(1, 90))) for _ in range(25)]
    texts.append(" ".join(r.choice(vocabulary) for _ in range(4000)) + " " + " ".join(base))
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names the operators use themselves."""
    rows = [(i, t, "q", 1, 2, "r") for i, t in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, bucket string, mark int, print int, runs string")


def shingles(text, k):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []


def test_fingerprints(docs):
    got = {r["doc_id"]: r for r in op1.fingerprint_with_edits(docs).collect()}
    texts = {i: t or "" for i, t in odd_rows()}
    order = sorted(texts, reverse=True)
    assert sorted(got) == sorted(texts)
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        text, after = texts[a], texts[b]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[a]["n_chars"] == len(text)
        assert got[a]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(got[a]["near_edited"] - jaccard(set(shingles(text, 5)), set(shingles(edited, 5)))) < 0.2
        assert abs(got[a]["near_next"] - jaccard(set(shingles(text, 5)), set(shingles(after, 5)))) < 0.2
    by_text = {}
    for i, t in texts.items():
        by_text.setdefault(" ".join(WORD.findall(t)), set()).add(got[i]["fingerprint"])
    assert all(len(x) == 1 for x in by_text.values())


def test_fingerprints_of_long_texts():
    """Texts of 100,000 words and more: the likeness is still that of the shingle sets."""
    text = lambda lo, hi: " ".join(f"w{i}" for i in range(lo, hi)).encode()
    long = [text(0, 120_000), text(200_000, 320_000), text(60_000, 180_000), text(400_000, 700_000), text(700_000, 1_000_000), b"", b"  "]
    got = op1.signatures(pa.array(long, pa.large_binary()))
    alike = lambda a, b: float(op1.likeness(got[a : a + 1], got[b : b + 1])[0])
    assert alike(0, 1) < 0.05 and alike(3, 4) < 0.05 and alike(0, 5) < 0.05
    assert abs(alike(0, 2) - 1 / 3) < 0.15 and alike(5, 6) == 1.0 and (got[5] == 0xFFFF).all()


def test_fingerprints_of_few_rows(spark):
    assert op1.fingerprint_with_edits(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    one = op1.fingerprint_with_edits(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abab").hexdigest() and one["near_next"] == 1.0
    rows = op1.fingerprint_with_edits(spark.createDataFrame([(None, "x"), (3, "abcd"), (3, "abcd"), (9, None)], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_chars"]) for r in rows) == [(-1, 1), (3, 4), (3, 4), (9, 0)]


def jaccard_classes(texts, at=0.8):
    """The least id that pairs of texts at the similarity reach, from all pairs."""
    sets = {i: set(shingles(t, 5)) for i, t in texts.items()}
    alike = lambda a, b: not (a | b) or len(a & b) >= at * len(a | b)
    return union_find(sorted(sets), [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if alike(sets[a], sets[b])])


def test_minhash_classes(docs):
    got = {r["doc_id"]: r["class_id"] for r in op1.near_duplicates(docs.select("doc_id", "text")).collect()}
    assert got == jaccard_classes(dict(odd_rows()))
    both = {r["doc_id"]: r["class_id"] for r in op1.fingerprints_and_classes(docs).collect()}
    assert both == got


@pytest.mark.parametrize("size", ["1", "3"])
def test_classes_at_the_edges_of_batches(spark, docs, size):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    try:
        got = {r["doc_id"]: r["class_id"] for r in op1.fingerprints_and_classes(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == jaccard_classes(dict(odd_rows()))


@pytest.mark.parametrize("crowd", [4096, 7])
def test_minhash_classes_of_variants(spark, monkeypatch, crowd):
    """Dense groups with outliers: variants of one text, 3 to 8 edits each, and texts that are like one variant only; also dealt out by bands and slices."""
    monkeypatch.setattr(op1, "CROWD", crowd)
    r = random.Random(11)
    rows = []
    for g in range(4):
        base = [f"w{g}.{r.randrange(400)}" for _ in range(300)]
        for _ in range(40):
            words = list(base)
            for k in r.sample(range(300), r.randrange(3, 9)):
                words[k] = f"e{r.randrange(10**6)}"
            rows.append(words)
        for _ in range(6):
            words = list(r.choice(rows[-40:]))
            for k in r.sample(range(300), 6):
                words[k] = f"f{r.randrange(10**6)}"
            rows.append(words)
    r.shuffle(rows)
    texts = {i: " ".join(w) for i, w in enumerate(rows)}
    texts[900], texts[901] = texts[3], texts[3]
    got = {x["doc_id"]: x["class_id"] for x in op1.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == jaccard_classes(texts)


def test_minhash_classes_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert op1.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "a b"), (None, "a b"), (3, "a b"), (3, "x y z"), (3, "x y z"), (None, "alone"), (4, None), (2, " ")]
    got = op1.fingerprints_and_classes(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(x["doc_id"]), x["n_chars"], str(x["class_id"])) for x in got) == [("2", 1, "2"), ("3", 3, "3"), ("3", 5, "3"), ("3", 5, "3"), ("4", 0, "2"), ("None", 3, "3"), ("None", 3, "3"), ("None", 5, "None")]


def union_find(ids, pairs):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_simhash(text):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, 3)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(docs):
    got = {r["doc_id"]: r for r in op2.near_duplicates(docs).collect()}
    prints = {i: brute_simhash(t) for i, t in odd_rows()}
    pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r["component_id"] for i, r in got.items()} == union_find(prints, pairs)


@pytest.mark.parametrize("at_home", [4096, 3])
def test_simhash_links(spark, monkeypatch, at_home):
    """Dense groups, chains and pairs at each distance; also with anchors dealt in slices."""
    monkeypatch.setattr(op2, "AT_HOME", at_home)
    r = random.Random(1)
    prints = set()
    for _ in range(30):
        x = r.getrandbits(64)
        prints.add(x)
        for _ in range(r.choice([1, 2, 60])):
            if r.random() < 0.3:
                x = r.choice(sorted(prints))
            for b in r.sample(range(64), r.randrange(1, 6)):
                x ^= 1 << b
            prints.add(x)
    prints = [int(np.uint64(p).view(np.int64)) for p in prints]
    links = op2.links(spark.createDataFrame([(p,) for p in prints], "print long"))
    mask = (1 << 64) - 1
    pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if ((a ^ b) & mask).bit_count() <= 3]
    assert all(((a ^ b) & mask).bit_count() <= 3 for a, b in links.collect())
    got = {r["node"]: r["component"] for r in components(links).collect()}
    want = union_find(prints, pairs)
    groups = lambda of: {frozenset(i for i in of if of[i] == c) for c in set(of.values())}
    assert groups({p: got.get(p, p) for p in prints}) == groups(want)


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and got[1000] == got[1001] != got[0] and len(got) == 303


def test_keeps_one(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (3, "other words here now"), (None, "a b c d e"), (None, "only here with no id"), (None, "only here with no id")]
    left = op2.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in left) == [(-1, "only here with no id"), (1, "a b c d e"), (3, "other words here now")]


def brute_substrings(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - 19):
            key = tuple(words[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("sample, at_once", [(64, 2_000_000), (1, 50)])
def test_substrings(docs, monkeypatch, sample, at_once):
    monkeypatch.setattr(op7, "SAMPLE", sample)
    monkeypatch.setattr(op7, "AT_ONCE", at_once)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op7.digests(docs).collect()}
    assert got == brute_substrings(odd_rows())


def test_substrings_of_hot_words(spark, monkeypatch):
    """A phrase in every document, and one document of a repeated word."""
    monkeypatch.setattr(op7, "SAMPLE", 1)
    r = random.Random(2)
    rows = []
    for i in range(300):
        words = [f"w{r.randrange(50)}" for _ in range(60)]
        words[r.randrange(50) : 0] = ["very", "common", "phrase"] * r.randrange(1, 9)
        rows.append((i, " ".join(words)))
    rows += [(500, "on " * 3000), (501, rows[7][1] + " " + rows[9][1])]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op7.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_substrings(rows)


def test_substrings_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op7.digests(empty).collect() == [] and op2.near_duplicates(empty).collect() == []
    text = " ".join(f"w{i}" for i in range(30))
    rows = op7.digests(spark.createDataFrame([(4, text), (4, text), (None, text), (5, text + " x")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in rows) == [(-1, 30), (4, 0), (4, 0), (5, 30)]
    left = op7.deduplicated(spark.createDataFrame([(4, text, "k"), (5, text + " x", None)], "doc_id long, text string, runs string")).collect()
    assert sorted((r["doc_id"], r["text"], r["runs"]) for r in left) == [(4, text, "k"), (5, "x", None)]


def test_substrings_of_a_passage_in_a_third(spark, monkeypatch):
    """One passage in every third document: tasks remember it, whatever the order of the rows."""
    monkeypatch.setattr(op7, "SAMPLE", 1)
    r = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"v{r.randrange(10**6)}" for _ in range(30)) + (" " + passage if i % 3 == 0 else "")) for i in range(600)]
    r.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in op7.digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == brute_substrings(rows)
