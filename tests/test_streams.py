"""Streams against batch results, with late and repeated rows, batches run twice and restarts."""

import collections
import random

import pytest

from postloom.operators import merge, routing
from postloom.streaming import dispatch, windows

POST = "post_id long, tag string, posted_at timestamp_ntz, routed_at timestamp_ntz, status string"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(idle, "false")  # else timers of processing time keep a query going that ends with its input
    yield spark
    spark.conf.unset(key)
    spark.conf.unset(idle)


def land(spark, rows, folder, schema):
    """A file a call, as a source lands them."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))


def posts_of(rng, ids):
    tags = ["macro", "macro", "macro", "tech", "rare", None]
    return [(i, rng.choice(tags), f"2024-01-{rng.randrange(1, 28):02} 00:00:00", rng.choice(["2099-01-01 00:00:00", "2099-01-02 00:00:00"]), "ROUTED") for i in ids]


def run(stream, out, checkpoint):
    query = stream.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert query.awaitTermination(60)


def test_jobs_by_count_or_age(rocks, tmp_path):
    spark, rng = rocks, random.Random(4)
    text = POST.replace("timestamp_ntz", "string")
    batches = [posts_of(rng, range(0, 30)), posts_of(rng, range(30, 75)), posts_of(rng, range(75, 200))]
    batches[1] += batches[0][:9]  # repeated
    batches[1].append((990, "old", "2023-01-01 00:00:00", "2023-01-01 00:00:00", "ROUTED"))  # late, and waiting for long
    batches[2] += [(None, "tech", None, "2024-01-01 00:00:00", "ROUTED"), (991, "tech", None, None, "ROUTED"), (992, "lone", None, "2099-01-01 00:00:00", "ROUTED")]
    waiting: dict = {}
    want = collections.Counter()
    for n, rows in enumerate(batches):
        land(spark, rows, tmp_path / "in", text)
        # a new query each time: a restart from the checkpoint
        stream = spark.readStream.schema(text).json(str(tmp_path / "in")).selectExpr("post_id", "tag", "to_timestamp(posted_at) AS posted_at", "to_timestamp(routed_at) AS routed_at")
        run(dispatch.dispatched(stream, 12, 60, size=5), tmp_path / "out", tmp_path / "state")
        done = {p for _, p, _ in want}
        for r in rows:
            if r[0] is not None and r[3] is not None and r[0] not in waiting:
                waiting[r[0]] = r
        due = {r["tag"] for r in routing.dispatch_due(spark.createDataFrame(list(waiting.values()), POST.replace("timestamp_ntz", "string")).selectExpr("post_id", "tag", "CAST(routed_at AS timestamp_ntz) AS posted_at", "status"), "2024-02-01 00:00:00", 12, 60).collect()}
        for i in [i for i, r in waiting.items() if r[1] in due]:
            want[waiting[i][1], i, n] += 1
            del waiting[i]
        got = spark.read.parquet(str(tmp_path / "out")).collect()
        assert collections.Counter((r["tag"], p) for r in got for p in r["post_ids"]) == collections.Counter((t, p) for t, p, _ in want)
        assert all(len(r["post_ids"]) <= 5 for r in got) and {r["why"] for r in got if r["tag"] == "old"} <= {"age"}
    assert waiting and ("old", 990, 1) in want and len(done) > 12


def test_ingest_equals_upsert(spark, tmp_path):
    schema = "post_id long, text string, lang string, views long"
    batches = [[(1, "a", "en", 5), (2, "b", None, None)], [(2, "b2", "de", 7), (3, "c", "en", 1), (3, "c2", "en", 2)], [(1, "a2", "fr", 9), (4, None, None, None)]]
    ledger = dispatch.Ledger(str(tmp_path / "table"))

    def merged(old, new):
        return merge.upsert_columns(old, new, "post_id", ["text", "lang"])

    want = spark.createDataFrame([], schema)
    each = dispatch.ingest(ledger, schema, merged)
    for n, rows in enumerate(batches):
        land(spark, rows, tmp_path / "in", schema)
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        query = stream.writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        want = spark.createDataFrame(merged(want, spark.createDataFrame(rows, schema)).collect(), want.schema)
        before = sorted(map(tuple, ledger.read(spark, schema).collect()))
        assert before == sorted(map(tuple, want.select("post_id", "text", "lang", "views").collect()))
        # the same batch again, and an older one, change nothing
        each(spark.createDataFrame([(9, "x", "x", 0)], schema), n)
        each(spark.createDataFrame([(9, "x", "x", 0)], schema), 0)
        assert sorted(map(tuple, ledger.read(spark, schema).collect())) == before
    # a version that was cut off doesn't count
    spark.createDataFrame([(9, "x", "x", 0)], schema).write.parquet(ledger.path(7))
    (tmp_path / "table" / "v=000000000007" / "_SUCCESS").unlink()
    assert ledger.versions(spark)[-1] == 2
    each(spark.createDataFrame([(5, "e", "en", 1)], schema), 7)
    assert {r["post_id"] for r in ledger.read(spark, schema).collect()} == {1, 2, 3, 4, 5}
    assert len(ledger.versions(spark)) == 2


def test_repeated_posts_of_a_stream(rocks, tmp_path):
    schema = "post_id long, posted_at timestamp, text string"
    spark = rocks
    land(spark, [(1, "2024-01-01T00:00:00", "a"), (1, "2024-01-01T00:00:01", "b"), (2, "2024-01-01T00:00:02", "c")], tmp_path / "in", "post_id long, posted_at string, text string")
    stream = windows.first_of_each(spark.readStream.schema(schema).json(str(tmp_path / "in")), "post_id")
    run(stream, tmp_path / "out", tmp_path / "state")
    assert sorted(r["post_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]
