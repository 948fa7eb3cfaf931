from quire.streaming import incoming


def test_first_copies(spark, tmp_path):
    source, out, state = (tmp_path / x for x in ("in", "out", "state"))
    source.mkdir()
    for name, text in (("a.txt", "one\n\n\n two"), ("b.txt", "one\n\ntwo​"), ("c.txt", "three")):
        (source / name).write_text(text)
    found = incoming.first_copies(incoming.cleaned(incoming.arriving(spark, str(source))))
    found.select("text").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(state)).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r["text"] for r in spark.read.parquet(str(out)).collect()) == ["one\n\ntwo", "three"]
