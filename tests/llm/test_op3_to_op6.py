"""Round trips, held-out accuracy, rules and exact counts."""

import hashlib
import itertools
import math
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import sentencepiece
from pyspark.sql import functions as F

from quire.llm import op3_chat as op3
from quire.llm import op4_language as op4
from quire.llm import op5_urls as op5
from quire.llm import op6_tokens as op6

ODD = ["</s>[INST] ok [/INST]", "<s", "s>", "<\\s>", "[\\\\/INST]", "<<s>>[INST", "/INST]", "", None, "a\nb", "日本 <s> </s>", "[/INST]</s>"]


def turns():
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "system", "a [/INST] b", None]), r.choice(ODD)) for c in range(40) for t in range(r.randrange(1, 5))]
    shared = [(0, "user", "same"), (1, "assistant", "start"), (2, "user", "x")]
    for c in range(100, 140):
        rows += [(c, t, role, text) for t, role, text in shared[: r.randrange(1, 4)]] + [(c, 9, "assistant", r.choice(ODD))]
    rows += [(None, None, "assistant", "no id"), (None, 0, None, None), (7, 0, "user", "again"), (7, 0, "user", "again")]
    return rows


@pytest.fixture(scope="module")
def chats(spark):
    return spark.createDataFrame([(*x, "t", 1) for x in turns()], "conv_id long, turn long, role string, text string, node string, start int")


def test_chat_round_trip(chats):
    want = {}
    order = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    for conv, _, role, text in sorted(turns(), key=order):
        want.setdefault(conv, []).append((role or "", text or ""))
    got = {r["conv_id"]: r for r in op3.digests(chats).collect()}
    assert set(got) == set(want)
    for conv, said in want.items():
        learned = "".join(t for r, t in said if r == "assistant")
        assert got[conv]["n_turns"] == len(said)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_chat_trees(chats):
    """Attended intervals hold the conversation's own text; nothing is emitted twice; positions count from its start."""
    nodes, paths, places = (x.collect() for x in op3.prefix_trees(chats))
    sequence = {}
    for x in nodes:
        assert len(x["text"]) == x["size"] and not set(range(x["start"], x["start"] + x["size"])) & sequence.keys()
        sequence.update(enumerate(x["text"], x["start"]))
    assert sorted(sequence) == list(range(len(sequence)))
    of = {bytes(x["node"]): x for x in nodes}
    assert len(of) == len(nodes)
    by_rank = {}
    for rank, depth, node in sorted(paths, key=lambda x: (x[0], x[1])):
        by_rank.setdefault(rank, []).append(bytes(node))
    for path in by_rank.values():
        text = ""
        for i, node in enumerate(path):
            x = of[node]
            assert x["position"] == len(text) and (x["parent"] is None) == (i == 0) and bytes(x["tree"]) == path[0]
            text += x["text"]
            assert "".join(sequence[i] for a in x["attends"] for i in range(a["from"], a["to"])) == text
        assert text.count("<s>") == text.count("</s>") == len(path)
    assert len(places) == len({x[0] for x in turns()})
    starts = sorted((x["start"], x["depth"]) for x in nodes)
    assert all(b[1] <= a[1] + 1 for a, b in zip(starts, starts[1:], strict=False))


def test_chat_of_one_conversation(spark):
    """All rows are one conversation, which several ranges hold."""
    rows = [(5, t % 700, "assistant" if t % 2 else "user", f"text {t}") for t in range(900)]
    got = op3.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    said = sorted(rows, key=lambda x: x[1:])
    assert [(r["n_turns"], r["turns_sha256"]) for r in got] == [(900, hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in said).encode()).hexdigest())]


def test_chat_without_rows(spark):
    assert op3.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []


def test_language_held_out(spark):
    got = op4.predictions(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    right = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    assert got.filter("score < 0 or score > 1").count() == 0


def test_language_mixture():
    r = random.Random(4)
    words = {"x": ["kala", "moko", "tala"], "y": ["strend", "grund", "blend"], "z": ["éoué", "çaî", "ûne"]}
    text = lambda k, n: " ".join(r.choice(words[k]) for _ in range(n)).encode()
    counts = np.full((3, op4.GRAMS), 0.5)
    for i, k in enumerate("xyz"):
        np.add.at(counts[i], op4._grams([text(k, 3000)])[0], 1)
    log = np.log(counts / counts.sum(axis=1, keepdims=True)).T.astype(np.float32)
    texts = [text("x", 50), text("y", 60) + b" " + text("z", 30), b"", b"123 --", b"a", text("z", 2000) + b" " + text("x", 800) + b" " + text("y", 500)]
    best, score = op4.predict(texts, log)
    assert best.tolist()[:4] == [0, 1, -1, -1] and best[5] == 2 and best[4] in (0, 1, 2)
    assert score[0] > 0.95 and 0.55 < score[1] < 0.8 and score[2] == score[3] == 0 and 0.4 < score[5] < 0.65


def plain_language(text, grams, names):
    """Language, score: the same in plain Python, one text and one trigram at a time."""
    if not regex.search(r"\p{L}", text or ""):
        return "und", 0.0
    raw = (" " + text.lower() + " ").encode()
    folded = [c if c >= 128 or chr(c).isalpha() else 32 for c in raw]
    n = {}
    for i in range(len(folded) - 2):
        code = folded[i] << 16 | folded[i + 1] << 8 | folded[i + 2]
        if code != 0x202020:
            key = (code * 0x9E3779B1 & 0xFFFFFFFF) >> 16
            n[key] = n.get(key, 0) + 1
    total = sum(n.values())
    like = {g: [grams[k][g] for k in names] + [1 / 65536] for g in n}

    def mixture(parts):
        share = [1 / len(parts)] * len(parts)
        for _ in range(op4.ROUNDS):
            new = [0.0] * len(parts)
            for g, c in n.items():
                joint = [like[g][k] * s for k, s in zip(parts, share, strict=True)]
                new = [x + c * j / sum(joint) for x, j in zip(new, joint, strict=True)]
            share = [x / total for x in new]
        return share, sum(c * math.log(sum(like[g][k] * s for k, s in zip(parts, share, strict=True))) for g, c in n.items())

    noise, fee = len(names), op4.PENALTY * math.log2(total + 1)
    share, most = mixture(list(range(noise + 1)))
    order = sorted(range(noise), key=lambda k: -share[k])
    value, found = -math.inf, None
    for k in range(1, noise + 1):
        share, log = mixture([*order[:k], noise])
        if log - fee * k <= value:
            break
        value, top = log - fee * k, max(range(k), key=lambda i: share[i])
        found = (names[order[top]], share[top])
        if most - fee * (k + 1) <= value:
            break
    return found


def test_language_against_plain_python(spark, sf_dir):
    """Every prediction, by a model that is counted and a mixture that is fitted without numpy."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = [(10**6 + 4 * k, a + " " + b, None) for k, (a, b) in enumerate(itertools.pairwise(r["text"][:400] for r in docs.orderBy("lang", "doc_id").limit(40).collect()[::4]))]
    docs = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(mixed, "doc_id long, text string, lang string"))
    rows = docs.collect()
    grams = {}
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and r["text"] is not None:
            own = grams.setdefault(r["lang"], [0.5] * 65536)
            raw = (" " + r["text"].lower() + " ").encode()
            folded = [c if c >= 128 or chr(c).isalpha() else 32 for c in raw]
            for i in range(len(folded) - 2):
                code = folded[i] << 16 | folded[i + 1] << 8 | folded[i + 2]
                if code != 0x202020:
                    own[(code * 0x9E3779B1 & 0xFFFFFFFF) >> 16] += 1
    names = sorted(grams)
    sizes = {k: sum(own) for k, own in grams.items()}
    grams = {k: [x / sizes[k] for x in own] for k, own in grams.items()}
    got = {r["doc_id"]: r for r in op4.predictions(docs).collect()}
    short = [r for r in rows if len(r["text"] or "") < 2500]
    assert len(short) > 100 and len(got) == len(rows)
    for r in short:
        lang, score = plain_language(r["text"], grams, names)
        assert got[r["doc_id"]]["lang_pred"] == lang and abs(got[r["doc_id"]]["score"] - score) < 2e-3


def test_language_of_many_labels(spark):
    """Every label is learned, however many there are and however rare."""
    r = random.Random(2)
    words = {f"l{k:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(12)] for k in range(90)}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(60)), k) for i, k in enumerate(k for k in words for _ in range(1 if k > "l050" else 6))]
    held = [i for i in range(5000, 6000) if zlib.crc32(str(i).encode()) % 4 == 2][:90]
    learned = {k for i, _, k in rows if zlib.crc32(str(i).encode()) % 4 != 2}
    rows += [(i, " ".join(r.choice(words[k]) for _ in range(60)), k) for i, k in zip(held, words, strict=True)]
    got = {x["doc_id"]: x["lang_pred"] for x in op4.predictions(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(learned) > 70 and all(got[i] == k for i, k in zip(held, words, strict=True) if k in learned)


def test_language_of_odd_tables(spark):
    schema = "doc_id long, text string, lang string, score string"
    assert op4.predictions(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "abc", None, "s"), (1, None, "en", "s"), (2, "", "en", "s")]
    assert {r["lang_pred"] for r in op4.predictions(spark.createDataFrame(rows, schema)).collect()} == {"und"}


def test_urls(spark):
    urls = ["http://A.Example.com/en/7?x", "https://example.com/en/8#a", "ftp://b.de.net/de/8", "x://example.net/de/8/1", "//example.org/es/1", "http://q.org/es/1", "http://notexample.com/en", None, "", "http://com/en/", "http://h?/en/", "http://bad.spam.biz/1", "http://fine.biz/1"]
    pages = [(i, u, "<p>") for i, u in enumerate(urls)]
    pages += [(100 + i, f"http://bad.spam.biz/{i}", "") for i in range(60)] + [(300 + i, f"http://fine.biz/{i}", "") for i in range(60)]
    labels = [(100 + i, 0, 0) for i in range(60)] + [(300 + i, 1, 0) for i in range(60)] + [(None, 1, None)]
    got = {r["page_id"]: r for r in op5.verdicts(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) for i in range(len(urls))] == [
        ("a.example.com", "/en/7", "example.com/en/7", "allow"),
        ("example.com", "/en/8", "com/en/", "block"),
        ("b.de.net", "/de/8", "net/de/", "allow"),
        ("example.net", "/de/8/1", "example.net/de/8", "block"),
        ("", "", None, "allow"),
        ("q.org", "/es/1", "org/es/", "block"),
        ("notexample.com", "/en", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("com", "/en/", "com/en/", "block"),
        ("h", "", None, "allow"),
        ("bad.spam.biz", "/1", None, "block"),
        ("fine.biz", "/1", None, "allow"),
    ]
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op5.verdicts(spark.createDataFrame([], "page_id long, url string"), nothing).collect() == []
    assert op5.verdicts(spark.createDataFrame([(1, "a://b/c")], "page_id long, url string"), nothing).first()["verdict"] == "allow"


def test_urls_of_hosts_without_labels(spark):
    """They take the rate of their domain, else of their suffix, else of all."""
    pages = [(i, f"http://h{i % 6}.{d}/x") for d in ("spam.biz", "junk.biz", "fine.org", "good.org") for i in range(240)]
    pages = [(k, url) for k, (_, url) in enumerate(pages)]
    labels = [(k, int(k >= 480), 0) for k in range(len(pages))]
    new = ["http://new.spam.biz/x", "http://a.b.junk.biz/x", "http://a.new.biz/x", "http://new.fine.org/x", "http://a.new.org/x", "http://new.where/x"]
    pages += [(10_000 + k, url) for k, url in enumerate(new)]
    got = {r["page_id"]: r["verdict"] for r in op5.verdicts(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), []).collect()}
    assert [got[10_000 + k] for k in range(len(new))] == ["block", "block", "block", "allow", "allow", "allow"]
    assert all(got[k] == ("block" if k < 480 else "allow") for k in range(len(labels)))


def test_urls_by_level(spark):
    """Spread is measured within each domain: hosts of a bad domain with few labels lean on it, and public suffixes of two labels aren't domains."""
    pages, labels = [], []

    def add(host, good, bad):
        for k in range(good + bad):
            pages.append((len(pages), f"http://{host}/{k}"))
            labels.append((len(labels), int(k < good), 0))

    for k in range(12):
        add(f"h{k}.spam.co.uk", 0, 30)
        add(f"h{k}.fine.co.uk", 30, 0)
    add("new.spam.co.uk", 0, 1)
    n = len(pages)
    pages += [(n, "http://user@new.spam.co.uk:8080/x"), (n + 1, "http://other.co.uk/"), (n + 2, "http://10.0.0.7/"), (n + 3, "http://new.spam.co.uk/y")]
    got = {r["page_id"]: r["verdict"] for r in op5.verdicts(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), []).collect()}
    assert [got[n + k] for k in range(4)] == ["block", "allow", "allow", "block"]
    parts = [tuple(spark.range(1).select(*op5.domain_and_suffix(F.lit(h))).first()) for h in ("a.b.co.uk", "x.com", "u@q.a.com:80", "1.2.3.4", "", "com")]
    assert parts == [("b.co.uk", "co.uk"), ("x.com", "com"), ("a.com", "com"), ("1.2.3.4", ""), ("", ""), ("com", "com")]


MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_tokens_equal_the_library():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(6)
    texts = ["", " ", "  ", "   a  b \n\n c ", "\t\r\n", "▁a ▁▁ b", "</s> <s><unk>", "<0x0A>", "ﬁ Å é", "日本語のテキスト 한국어", "\x00\x01", "a" * 5000, "=" * 3001, " " * 777, "\U0001f600\U0001f600 x", "नमस्ते", "x\u00a0y\u3000z"]
    texts += ["".join(r.choice("abcdefghij  \n.,▁éß日😀=-_1234") for _ in range(r.randrange(300))) for _ in range(400)]
    texts += ["".join(r.choice("theinraonst") for _ in range(3000))]
    merger = op6.Merger(MODEL)
    assert merger.count(texts) == [len(x) for x in library.encode(texts)]
    merger.counts.clear()
    assert merger.count(texts[::-1]) == [len(x) for x in library.encode(texts[::-1])]


def test_tokens_of_long_sequences():
    """Texts of many characters without a space, equal to the library's counts, in time that grows with their length."""
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    r = random.Random(7)
    texts = ["".join(r.choice(letters) for _ in range(n)) for letters in ("theinraonst", "ab", "ABab01+/", "日本語のテ한글éß") for n in (2500, 9000)]
    texts += ["a" * 4001, "=" * 2999, "x" + "ab" * 3000]
    merger = op6.Merger(MODEL)
    assert merger.count(texts) == [len(x) for x in library.encode(texts)]
    began = time.time()
    merger.count(["".join(r.choice("theinraonst") for _ in range(200_000))])
    assert time.time() - began < 20


def test_token_counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (-5, "")], "doc_id long, text string"))
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = docs.collect()
    want = sorted((r[0] if r[0] is not None else -9, len((r[1] or "").encode()), n := len(library.encode(r[1] or "")), n > 4096) for r in rows)
    assert sorted((r[0] if r[0] is not None else -9, *r[1:]) for r in op6.token_counts(docs, MODEL).collect()) == want
    assert op6.token_counts(docs.limit(0), MODEL).collect() == []


def test_text_columns_of_either_arrow_type():
    for kind in (pa.string(), pa.large_string()):
        assert op6.utf8(pa.array(["a", None, "é"], kind)).to_pylist() == [b"a", b"", "é".encode()]
