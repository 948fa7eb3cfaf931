"""Duplicate groups of file names, as the reference's tests expect them."""

import pytest
from pyspark.sql import functions as F

from quire.operators import dedup
from quire.operators.graph import components


def files(spark, names, sizes=None, hashes=None):
    rows = [(f"/x/{n}", (sizes or {}).get(n, 10 + i), 100.0 + i, (hashes or {}).get(n)) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "path string, size long, mtime double, hash string")


def grouped(spark, names, per_extension=True, fuzzy=False, sizes=None, hashes=None):
    own = files(spark, names, sizes, hashes)
    found = dedup.buckets(dedup.candidates(own.drop("hash")), per_extension, fuzzy)
    return dedup.groups(found.join(own.select("path", "hash"), "path")).orderBy("group", "place").collect()


def test_parse(spark):
    row = dedup.candidates(files(spark, ["[작가] 작품 이름 1-210 완결.epub"])).first()
    assert (row["author"], row["title"], row["complete"], row["range_start"], row["range_end"]) == ("작가", "작품 이름", True, 1, 210)


def test_keeper_over_extensions(spark):
    names = ["[작가] 작품 1-175 미완.txt", "[작가] 작품 1-210 완결.txt", "[작가] 작품 1-210 완결.epub"]
    rows = grouped(spark, names, per_extension=False, sizes=dict(zip(names, (300, 100, 50), strict=True)))
    assert [(r["name"], r["keep"]) for r in rows] == [(names[2], True), (names[1], False), (names[0], False)]
    assert rows[0]["reason"] == "남김 / 완결 / 1-210 / EPUB / 50 bytes"
    rows = grouped(spark, names)
    assert [(r["name"], r["keep"]) for r in rows] == [(names[1], True), (names[0], False)]


@pytest.mark.parametrize("names", [[f"[녹오미] N번째 인생 {k}권.txt" for k in (1, 2, 3)] + ["[녹오미] N번째 인생 4권 완결.txt"], ["죽은_아내가_돌아왔다_시즌2_1_68화_완결_@황금백수.epub", "죽은_아내가_돌아왔다_시즌1_1_98화_완결_@황금백수.epub"]])
def test_apart(spark, names):
    assert grouped(spark, names) == []


def test_at_author(spark):
    row = dedup.candidates(files(spark, ["죽은_아내가_돌아왔다_시즌2_1_68화_완결_@황금백수.epub"])).first()
    assert (row["author"], row["range_start"], row["range_end"]) == ("황금백수", 1, 68)


def test_overlap(spark):
    rows = grouped(spark, ["작품 1-90 미완.txt", "작품 1-100 완결.txt", "작품 200-300.txt"])
    assert [(r["name"], r["keep"]) for r in rows] == [("작품 1-100 완결.txt", True), ("작품 1-90 미완.txt", False)]


def test_fuzzy(spark):
    names = ["크툴루 세계관에 광기를 숨김 1-186.txt", "크툴루 세계관 광기를 숨김 1-200 완결.txt"]
    assert grouped(spark, names) == []
    rows = grouped(spark, names, fuzzy=True)
    assert len(rows) == 2 and rows[0]["confidence"] == "낮음" and rows[0]["warnings"] == ["유사 제목 확인 필요"]


@pytest.mark.parametrize("known, confidence, warning", [(("a", "a"), "중간", "해시 일치"), (("a", dedup.MISSING), "낮음", "해시 일부 미확인"), (("a", "b"), "낮음", "해시 다름 확인 필요")])
def test_hashes(spark, known, confidence, warning):
    names = ["작품 1-90.txt", "작품_1-90.txt"]
    rows = grouped(spark, names, hashes=dict(zip(names, known, strict=True)))
    assert {(r["confidence"], *r["warnings"]) for r in rows} == {(confidence, warning)}


def test_which_need_hashes(spark):
    rows = [("g", "a", 1, 90), ("g", "b", 1, 100), ("h", "c", 1, 5), ("h", "d", 1, 5), ("k", "e", None, None), ("k", "f", None, None), ("m", "x", None, None), ("m", "y", 1, 2)]
    got = dedup.needing_hash(spark.createDataFrame(rows, "group string, path string, range_start int, range_end int"))
    assert sorted(r["path"] for r in got.collect()) == ["c", "d", "e", "f"]


def test_islands_with_nulls(spark):
    rows = [(1, 1, 10), (1, 10, 20), (1, 21, 30), (2, 1, 2), (2, None, None), (2, 50, 60)]
    got = dedup.islands(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "k int, s int, e int, i int"), ["k"], "s", "e")
    assert [r["island"] for r in got.orderBy("i").collect()] == [0, 0, 1, 0, 0, 0]


def test_similar_pairs_are_all_pairs(spark):
    import itertools
    import random

    r = random.Random(1)
    keys = sorted({"".join(r.choice("abc") for _ in range(r.randrange(3, 12))) for _ in range(120)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i, *row[1:]], row
            for j, y in enumerate(b, 1):
                row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
        return row[-1]

    def alike(a, b):
        long = max(len(a), len(b))
        return min(len(a), len(b)) / long >= 0.65 and (long - distance(a, b)) / long >= 0.72

    want = {frozenset(p) for p in itertools.combinations(keys, 2) if alike(*p)}
    titles = spark.createDataFrame([(k, 1) for k in keys], "key string, block int")
    assert {frozenset((x["a"], x["b"])) for x in dedup.similar_pairs(titles, ["block"]).collect()} == want


def all_pairs(spark, keys):
    """By comparing each two."""
    a, b = (spark.createDataFrame([(k,) for k in keys], f"{c} string") for c in "ab")
    near = "(length(a) < length(b) or length(a) = length(b) and a < b) and length(a) / length(b) >= 0.72 and levenshtein(a, b) <= floor(0.28D * length(b) + 1e-9)"
    return sorted(map(tuple, a.crossJoin(b).filter(near).collect()))


def shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_similar_pairs_send_few_rows(spark):
    """Long titles of common syllables: few rows are sent, not each piece at each place."""
    import random

    r = random.Random(5)
    syllables = "the and tion in on ed at en st or th er es ou re ha".split()
    keys = ["".join(r.choice(syllables) for _ in range(r.randrange(16, 22))) for _ in range(300)]
    keys = sorted({v for k in keys for v in (k, k[:4] + k[5:], k + "x")})
    titles = spark.createDataFrame([(k, 1) for k in keys], "key string, block int")
    before = shuffled(spark)
    got = sorted((x["a"], x["b"]) for x in dedup.similar_pairs(titles, ["block"]).collect())
    assert shuffled(spark) - before < 10 * len(keys)
    assert got == all_pairs(spark, keys)


def test_classes_of_similar_titles(spark):
    """Variants meet through centres; classes are those of all pairs, and few rows are sent."""
    import random

    r = random.Random(6)
    syllables = "der die und ein sch ich en er au ung ge be".split()
    keys = ["".join(r.choice(syllables) for _ in range(r.randrange(14, 20))) for _ in range(150)]
    keys = sorted({v for k in keys for v in (k, k[:4] + k[5:], k + "x", k[:-1])})
    titles = spark.createDataFrame([(k, 1) for k in keys], "key string, block int")
    centred = dedup._centred(titles, ["block"])
    assert centred.filter("levenshtein(key, centre) > 2").count() == 0 and centred.select("centre").distinct().count() < 0.7 * len(keys)
    before = shuffled(spark)
    links = dedup.similar_pairs(titles, ["block"]).select(F.col("a").alias("u"), F.col("b").alias("v"))
    got = {x["node"]: x["component"] for x in components(links).collect()}
    assert shuffled(spark) - before < 100 * len(keys)
    pairs = all_pairs(spark, keys)
    want = {k: k for pair in pairs for k in pair}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            least = min(want[a], want[b])
            changed |= want[a] != least or want[b] != least
            want[a] = want[b] = least
    assert got == want


@pytest.mark.parametrize("longest", [6, 40, 90])
def test_similar_pairs_of_large_blocks(spark, monkeypatch, longest):
    """In pieces, with titles of all lengths and characters."""
    import random

    monkeypatch.setattr(dedup, "PIECE", 100)
    r = random.Random(longest)

    def changed(k):
        k = list(k)
        for _ in range(r.randrange(max(2, len(k) // 3))):
            at = r.randrange(len(k) + 1)
            k[at : at + r.randrange(2)] = r.choice(["", "a", "가", "x"])
        return "".join(k)

    keys = ["".join(r.choice("abcd가나😀") for _ in range(r.randrange(1, longest))) for _ in range(300)]
    keys = sorted({v for k in keys for v in (k, changed(k), changed(k)) if v})
    assert len(keys) > dedup.SMALL_BLOCK
    titles = spark.createDataFrame([(k, i) for k in keys for i in (1, None)], "key string, block int")
    assert sorted((x["a"], x["b"]) for x in dedup.similar_pairs(titles, ["block"]).collect()) == all_pairs(spark, keys)


def test_components(spark):
    links = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("x", "y"), ("z", "z")]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "u string, v string")).collect()}
    assert {got[f"n{i:03d}"] for i in range(61)} == {"n000"} and got["y"] == "x" and "z" not in got
    assert components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_exact_texts(spark):
    rows = [(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None)]
    got = dedup.exact_texts(spark.createDataFrame(rows, "id int, text string"), "text", ["id"]).filter(F.col("hash").isNotNull())
    assert sorted((r["id"], r["members"], r["keep"]) for r in got.collect()) == [(1, 2, False), (2, 2, True)]
