"""Licences, leaks and mixes on small fixtures; the pipeline against brute force."""

import math
import random
import re
import textwrap
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import op8_licences as op8
from quire.llm import op9_decontamination as op9
from quire.llm import op10_mixing as op10


def test_licences(spark):
    mit = dict(op8.known_texts())["MIT"]
    changed = "MIT License\n\nCopyright (c) 2019 Someone, Inc.\nAll rights reserved.\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace('"', "“") + "\r\n"
    rows = [(1, mit, "x"), (2, changed, "x"), (3, "Some words.\nReleased under the MIT LICENCE\nmore. \nLicensed under CC BY-NC 4.0\nreleased under the mit license!", "x"), (4, "text " + mit, "x"), (5, None, "x"), (6, "", "x"), (None, "...\n--", "x")]
    rows += [(7, "Copyright 2020 X, Inc. Licensed under the MIT License.\nbody", "x"), (8, "# Licensed under\n# the Apache License, Version 2.0.\n\ncode", "x"), (8, "# Licensed under\n# the Apache License, Version 2.0.\n\ncode", "x")]
    got = {r["doc_id"]: r for r in op8.scan(spark.createDataFrame(rows, "doc_id long, text string, licence string")).collect()}
    assert {i: r["licence"] for i, r in got.items()} == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None, 7: None, 8: None, None: None}
    assert got[3]["notices"] == ["CC-BY-NC-4.0", "MIT", "MIT"] and got[6]["notices"] == [] and got[None]["digest"] is None
    assert got[7]["notices"] == ["MIT"] and got[8]["notices"] == ["Apache-2.0"]
    assert op8.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_licences_in_full(spark):
    """Each known text, rewrapped and with a copyright line, is found whole; inside a document, by all of its paragraphs."""
    texts = op8.known_texts()
    # paragraphs with copyright lines, rules or boxes keep their lines
    wrapped = lambda t: "\n\n".join(x if "(c)" in x.lower() or re.search(r"(?m)^\W+$", x) else textwrap.fill(x, 61, initial_indent=" * ") for x in re.split(r"\n\s*\n", t) if x.strip())
    rows = [(k, t) for k, (_, t) in enumerate(texts)]
    rows += [(100 + k, "(c) 2001 A. Nybody\n" + t.replace("\n", "  \r\n\t")) for k, (_, t) in enumerate(texts)]
    rows += [(200 + k, "Some program.\n\n" + wrapped(t) + "\n\nint main() { }") for k, (_, t) in enumerate(texts)]
    got = {r["doc_id"]: r for r in op8.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (name, _) in enumerate(texts):
        assert got[k]["licence"] == got[100 + k]["licence"] == name
        assert got[200 + k]["licence"] is None and got[k]["contained"] == [name] and got[200 + k]["contained"] == [name], name


def words(text):
    return "".join(c if c.isalnum() and c.isascii() or ord(c) >= 0x80 else " " for c in (text or "").lower()).split()


def bag(w, size=5):
    return Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute_leaks(docs, items):
    """The best of all windows of the item's size."""
    out = {}
    for d, text in docs:
        w = words(text)
        whole = {k: bag(w, k) for k in range(1, 6)}
        for j, item in items:
            v = words(item)
            if not v:
                continue
            k = min(5, len(v))
            want = bag(v, k)
            if not want & whole[k]:
                continue
            for start in range(max(1, len(w) - len(v) + 1)):
                have = bag(w[start : start + len(v)], k)
                if (s := sum((have & want).values()) / max(1, sum((have | want).values()))) >= 0.8:
                    out[d, j] = max(s, out.get((d, j), 0))
    return out


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_leaks_against_all_windows(spark, monkeypatch, sent):
    monkeypatch.setattr(op9, "MOST_SENT", sent)
    r = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    draw = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(j, " ".join(draw(r.randrange(14, 60)))) for j in range(12)] + [(50, "one two"), (51, None), (52, "go " * 30), (53, "Two plus two, is"), (54, "one TWO!"), (55, "zebra"), (56, "..")]
    docs = [(1, None), (2, ""), (3, "short one"), (4, "go " * 200), (5, "go " * 12), (6, "two plus two is"), (7, "say one two three; two plus two is"), (8, "a zebra")]
    for i in range(80):
        item = r.choice(items[:12])[1].split()
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            k = r.randrange(len(item))
            item[k : k + r.choice([0, 1])] = r.choice([[], ["new"], ["two", "new"]])
        text = draw(r.choice([0, 3, 80])) + [w.upper() + "," for w in item] + draw(r.choice([0, 2, 50]))
        docs.append((10 + i, "\n".join(text)))
    frame = spark.createDataFrame([(*x, 7, 8) for x in docs], "doc_id long, text string, size int, start int")
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in op9.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = brute_leaks(docs, items)
    assert got == pytest.approx(want) and len(got) > 20
    left = {x["doc_id"] for x in op9.clean(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}


def test_leaks_of_reordered_items(spark):
    """Halves and thirds of an item that have changed places, in the midst and at the ends of documents."""
    r = random.Random(10)
    vocabulary = [f"w{i}" for i in range(300)]
    draw = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(j, " ".join(draw(r.choice([60, 60, 90, 120])))) for j in range(8)] + [(60, "go " * 60)]
    docs = [(1, "go " * 40 + "on " * 20 + "go " * 70)]
    for i in range(50):
        item = r.choice(items[:8])[1].split()
        cuts = [0, *sorted(r.sample(range(10, len(item) - 10), r.choice([1, 1, 2]))), len(item)]
        parts = [item[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        text = draw(r.choice([0, 70])) + sum(parts[::-1], []) + draw(r.choice([0, 3, 90]))
        docs.append((10 + i, " ".join(text)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["similarity"] for x in op9.leaks(frame, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == pytest.approx(brute_leaks(docs, items)) and len(got) > 30


def test_leaks_of_odd_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(None, "a b c d e f g"), (1, "x")], "doc_id long, text string")
    assert op9.leaks(docs, none).collect() == [] and op9.clean(docs, none).count() == 2
    items = spark.createDataFrame([(1, "A b c d, e f"), (1, "A b c d, e f")], "item_id long, text string")
    assert [x["item_id"] for x in op9.leaks(docs, items).collect()] == [1] and op9.clean(docs, items).count() == 1
    assert op9.leaks(docs.limit(0), items).collect() == []


def corpus(spark):
    r = random.Random(9)
    sizes = {"big": 400, "mid": 80, "small": 20, None: 30}
    rows = [(f"{s}", s, k) for s, n in sizes.items() for k in range(n)]
    return spark.createDataFrame([(i, "w " * r.randrange(1, 40), s, 1, 2) for i, (_, s, _) in enumerate(rows)] + [(9999, None, "void", 1, 2)], "doc_id long, text string, source string, n_tokens int, rest int")


def test_mixing(spark):
    docs = corpus(spark)
    got = op10.mixed(docs, budget=1.5, repetitions=3.0, entropy=0.9).collect()
    tokens = Counter()
    for r in docs.collect():
        tokens[r["source"]] += len((r["text"] or "").split())
    del tokens["void"]
    alpha = op10.exponent(dict(tokens), 1.5, 3.0, 0.9)
    share = op10.weights(dict(tokens), alpha)
    budget = 1.5 * sum(tokens.values())
    assert 0 < alpha < 1 and max(share[s] * budget / tokens[s] for s in tokens) <= 3.0 + 1e-9
    entropy = -sum(w * math.log(w) for w in share.values())
    assert entropy <= 0.9 * math.log(len(tokens)) + 1e-9
    taken, epochs = Counter(), {}
    for r in got:
        taken[r["source"]] += r["n_tokens"]
        epochs.setdefault((r["source"], r["doc_id"]), []).append(r["epoch"])
    for s in tokens:
        assert share[s] * budget - 41 < taken[s] <= share[s] * budget + op10.ROUND
    assert all(sorted(e) == list(range(len(e))) for e in epochs.values())
    for s in tokens:  # no document comes again before all others of its source have come
        counts = [len(epochs.get((s, r["doc_id"]), [])) for r in docs.collect() if r["source"] == s]
        assert max(counts) - min(counts) <= 1


def test_mixing_exponents():
    assert op10.exponent({"a": 5}, 1.0) == 0.0 or op10.exponent({"a": 5}, 1.0) == pytest.approx(0.0)
    assert op10.exponent({"a": 100, "b": 100}, 1.0, 2.0, 0.5) == 1.0
    alpha = op10.exponent({"a": 1000, "b": 10}, 1.0, 5.0, None)
    assert op10.weights({"a": 1000, "b": 10}, alpha)["b"] * 1010 / 10 == pytest.approx(5.0)


def test_mixing_of_odd_tables(spark):
    schema = "doc_id long, text string, source string"
    assert op10.mix(spark.createDataFrame([], schema)).collect() == []
    assert op10.mix(spark.createDataFrame([(1, None, "a"), (2, " ", None)], schema)).collect() == []
    rows = spark.createDataFrame([(None, "a b", "a"), (3, "c", "a"), (3, "c", "a")], schema)
    assert sorted((r["doc_id"] or -1, r["epoch"]) for r in op10.mix(rows).collect()) == [(-1, 0), (3, 0), (3, 0)]


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "substrings", "decontamination", "mixing"]
    before = {r["doc_id"]: r for r in docs.collect()}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    from .test_op1_op2_op7 import brute_simhash, brute_substrings, union_find

    stage = dict(corpus_pipeline.STAGES)
    kept = stage["language"](spark, docs, sf_dir).collect()
    assert len(kept) > 0.95 * len(before) and all(before[r["doc_id"]] == r for r in kept)
    one = stage["near_duplicates"](spark, docs, sf_dir).collect()
    prints = {i: brute_simhash(r["text"]) for i, r in before.items()}
    ids = sorted(prints)
    groups = union_find(prints, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3])
    assert {r["doc_id"] for r in one} == set(groups.values()) and len(one) == len(set(groups.values()))
    cut = stage["substrings"](spark, docs, sf_dir).collect()
    want = brute_substrings([(i, r["text"]) for i, r in before.items()])
    for r in cut:
        n, removed, digest = want[r["doc_id"]]
        assert len(r["text"]) == r["n_chars"] and (r == before[r["doc_id"]] if not removed else len(r["text"].split()) == n - removed)
    assert len(cut) == len(before)
    clean = {r["doc_id"] for r in stage["decontamination"](spark, docs, sf_dir).collect()}
    assert clean == set(before) - {d for d, _ in brute_leaks([(i, r["text"]) for i, r in before.items()], items)}
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(docs.columns) < set(out.columns) and 0 < out.select("doc_id").distinct().count() <= len(before)


def test_texts_in_many_languages_stay(spark, sf_dir):
    """Each of three or four languages explains less than half of its text, all together the whole; noise goes."""
    r = random.Random(12)
    letters = {"k": "aeiklmno", "l": "ostrundg", "m": "éçàûbvpy", "n": "zwxjqhfu"}
    vocabulary = {k: ["".join(r.choice(x) for _ in range(r.randrange(3, 8))) for _ in range(30)] for k, x in letters.items()}
    prose = lambda k, n: " ".join(r.choice(vocabulary[k]) for _ in range(n))
    rows = [(i, prose(k, 200), k) for i, k in enumerate("klmn" * 20)]
    held = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 4 == 2]
    mixed = {held[0]: "klm", held[1]: "klmn", held[2]: "nml", held[3]: "k"}
    rows += [(i, " ".join(prose(k, 60) for k in ks), ks[0]) for i, ks in mixed.items()]
    rows += [(held[4], "".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(400)), "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    left = {x["doc_id"] for x in corpus_pipeline.language(spark, docs, sf_dir).collect()}
    assert left == {x[0] for x in rows} - {held[4]}


def test_pipeline_of_odd_tables(spark, sf_dir):
    """Nulls in any column, empty and repeated rows, and no rows at all."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    prose = " ".join(f"word{i} and other{i * 7}" for i in range(60))
    rows = [(1, prose, "en", "a", len(prose)), (1, prose, "en", "a", len(prose)), (2, None, None, None, None), (3, "", "en", "b", 0), (None, prose + " more", "en", None, 9), (None, None, None, None, None), (5, "123 456", "de", "c", 7), (6, "x " * 5000, "en", "a", 10000)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        alone = {}
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert out.columns[: len(docs.columns)] == docs.columns
            alone[name] = out.collect()
        n = docs.count()
        assert len(alone["substrings"]) == len(alone["decontamination"]) == n
        if n:
            assert {r["text"] for r in alone["language"]} == {prose, prose + " more", "x " * 5000}
            assert sorted(r["doc_id"] for r in alone["near_duplicates"] if r["doc_id"] is not None) == [1, 2, 5, 6]
            assert {r["text"] for r in alone["near_duplicates"] if r["doc_id"] is None} <= {prose + " more"}
            assert all(r["epoch"] >= 0 and r["text"] for r in alone["mixing"] if r["n_tokens"])


ODD_NAMES = ["a.b", "__id", "__mark", "__own", "__tokens", "lang_pred", "score", "explained", "back`tick", "row", "id", "mark", "none", "runs", "size", "start", "a", "b", "block", "epochs", "tokens", "first", "print", "text_id", "two words"]


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_with_columns_of_any_name(spark, sf_dir, name, stage):
    """Columns that operators could take for their own come back as they were."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = [F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in ODD_NAMES]
    wide = docs.select("doc_id", *more[:12], "text", "lang", *more[12:], "source", "n_chars")
    out = stage(spark, wide, sf_dir)
    assert out.columns[: len(wide.columns)] == wide.columns
    rows = out.collect()
    assert rows and all(r[n] == f"{n} of {r['doc_id']}" for r in rows for n in ODD_NAMES)
    plain = stage(spark, docs, sf_dir).collect()
    assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in plain)
