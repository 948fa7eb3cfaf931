from quire.operators import renames


def preview(spark, names):
    rows = spark.createDataFrame([(f"/{i}", i, n, n) for i, n in enumerate(names)], "path string, pos int, name string, new string")
    return [r["new"] for r in renames.preview(rows).orderBy("path").collect()]


def test_units(spark):
    assert preview(spark, ["더 콜로니 1권.epub", "더 콜로니 2권.epub", "더 콜로니 3권.epub", "더 콜로니 5화.epub"]) == ["더 콜로니 1권.epub", "더 콜로니 2권.epub", "더 콜로니 3권.epub", "더 콜로니 5권.epub"]


def test_authors(spark):
    got = preview(spark, ["[조병래] 어떤 책 1권.epub", "[너와같은꿈] 어떤 책 2권.epub", "[조경래] 어떤 책 3권.epub"])
    assert got == [f"[조경래] 어떤 책 {k}권.epub" for k in (1, 2, 3)]


def test_spelling(spark):
    assert preview(spark, ["버림받은 황비 1권.epub", "버림받은 황비 2권.epub", "버림 받은 황비 3권.epub"])[2] == "버림받은 황비 3권.epub"


def test_plans(spark):
    members = spark.createDataFrame([("/a/x.txt", False, 1, 2.0), ("/b/x.txt", False, 1, 2.0), ("/c/x.epub", True, 1, 2.0)], "path string, keep boolean, size long, mtime double")
    moved = renames.removals(members, "/t")
    assert sorted((r["path"], r["to"]) for r in moved.collect()) == [("/a/x.txt", "/t/x.txt"), ("/b/x.txt", "/t/x (1).txt")]
    existing = spark.createDataFrame([("/t/x.txt",), ("/a/x.txt",)], "path string")
    assert {r["path"]: r["status"] for r in renames.restore(moved, existing).collect()} == {"/a/x.txt": "conflict", "/b/x.txt": "missing"}
