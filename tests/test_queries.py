"""Every query against its SQL on the smallest tables; what is missing without the llm folders is left out."""

import html
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quire.functions import text as T
from quire.plans import queries as core

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, (list, np.ndarray)):
        return [plain(x) for x in v]
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    return float(v) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else v


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, sf_dir, tables, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    if name not in entry.oracle_sql():
        assert len(got)
        return
    want = tables.execute(entry.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda df: sorted(repr([plain(v) for v in r]) for r in df[columns].itertuples(index=False))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_plain_text_of_cut_entities(spark, tmp_path):
    """Titles that were cut within an entity: the query gives what its SQL gives."""
    pages = ["<title>a &amp;&amp;&amp</title><p>x&amp;lt;y</p>", "<title>b &quot</title>&quot;c&quot; &copy &copy;", "<title>d &am</title>&middot;&middot &amp;amp &amp;copy;", "<title>e &quo</title>", "<p>&amp"]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = c.execute(entry.oracle_sql()["html_plain_text"]).fetchall()
    assert sorted(map(tuple, entry.queries()["html_plain_text"](spark, str(tmp_path)).collect())) == sorted(want)


def test_closed_entities(spark):
    """All that end in a semicolon, once; the others only by default, as HTML has it."""
    texts = ["&lt;&amp;lt; &eacute; &eacute &#233; &#xE9; &notit; &amp &nosuch;", "&amp &copy", "&hellip;&amp;hellip;"]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert [r[0] for r in df.select(T.unescape_html(F.col("x"), closed=True)).collect()] == ["<&lt; é &eacute é é &notit; &amp &nosuch;", "&amp &copy", "…&hellip;"]
    assert [r[0] for r in df.select(T.unescape_html(F.col("x"))).collect()] == [html.unescape(x) for x in texts]
