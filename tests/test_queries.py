"""Every query against DuckDB, functions against hand-made rows, a stream against its batch."""

import duckdb
import pytest

from postloom import registry
from postloom.functions import text
from postloom.operators import search
from postloom.sources.tables import routed
from postloom.streaming import windows

TABLES = "customer orders events documents labels embeddings supplier".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple("-" if x is None or x != x else round(float(x), 5) if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "iuf" else str(x) for x in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_duckdb(spark, sf_dir, con, name):
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), con.sql(registry.SQL[name]).df()
    assert set(got.columns) == set(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize(
    ("fn", "cases"),
    [
        (text.view_count, {None: None, "": None, "  ": None, "-5": 5.0, "1,234": 1234.0, "1.2K": 1200.0, "3 m": 3e6, "2B": 2e9, "1.2.3": 1.2, ".": None, ",": None, "n/a": None, "about 42 views": 42.0}),
        (text.collapse, {"　a \t\n b﻿": "a b", "": ""}),
        (text.number_tokens, {"up 3.5% to 1,200 in 24h": 3}),
        (text.embedding_text, {"RT @a: hi #比特币 https://x.y": "hi 比特币", "https://x.y": "https://x.y"}),
        (text.has_ticker, {"中$btc币": True, "$b": False}),
        (text.utf16_length, {"a😀b": 4}),
        (text.screen_name, {"@ Some": "some"}),
        (text.known_tag, {" Market": "macro", "zzz": "other", "yield": "yield"}),
        (text.truncate, {"x" * 160: "x" * 160, "x" * 161: "x" * 159 + "…", None: None}),
    ],
)
def test_functions(spark, fn, cases):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(enumerate(cases)), "i int, x string").select("i", fn(F.col("x")).alias("y"))
    assert [r["y"] for r in sorted(df.collect(), key=lambda r: r["i"])] == list(cases.values())


def test_search_terms():
    assert search.terms("a,b;c") == [["a", "b"], ["c"]] and search.terms(" ; , ") == []
    with pytest.raises(ValueError):
        search.page(None, [], 0, 10)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    batch = routed(spark, sf_dir).selectExpr("post_id", "cast(posted_at as timestamp) posted_at", "status")
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = windows.window_counts(windows.first_of_each(stream, "post_id"), late=None).writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    done = {(r["start"], r["status"]): r["posts"] for r in spark.table("counts").collect()}
    whole = {(r["start"], r["status"]): r["posts"] for r in windows.window_counts(batch).collect()}
    assert done and all(whole[k] == n for k, n in done.items())
