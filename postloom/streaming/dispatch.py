"""Routed posts as a stream: jobs by count or age for each tag, and posts merged into a table batch by batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

#: Posts of a job.
JOB = 50
_JOBS = "tag string, why string, post_ids array<long>"
_WAITING = "post_id long, posted long, routed long"


class CountOrAge(StatefulProcessor):
    """Holds a tag's waiting posts until there are `least`, or the oldest has waited `wait_ms` (0: never); then all go, newest first, in jobs.

    Waiting posts are a list state of less than `least` rows, whatever the tag's share of the stream; a repeated post waits once.
    A timer, at the time when the oldest will have waited, sends tags of which nothing more comes.
    """

    def __init__(self, least: int, wait_ms: int, size: int = JOB) -> None:
        self.least, self.wait_ms, self.size = max(1, least), wait_ms, size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _WAITING)

    def _jobs(self, key: tuple, why: str, rows: dict[int, tuple[int, int]]) -> Iterator[pd.DataFrame]:
        newest = sorted(rows, key=lambda p: (-rows[p][0], -p))
        parts = [newest[i : i + self.size] for i in range(0, len(newest), self.size)]
        yield pd.DataFrame({"tag": pd.Series([key[0]] * len(parts), dtype=object), "why": [why] * len(parts), "post_ids": parts})

    def _timers(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        held = {int(p): (int(a), int(b)) for p, a, b in self.waiting.get()}
        sent = 0
        for frame in rows:
            for p, a, b in zip(frame["post_id"].tolist(), frame["posted"].tolist(), frame["routed"].tolist(), strict=True):
                held.setdefault(int(p), (int(a), int(b)))
            # what is above the count needn't be held until the batch ends
            while len(held) >= self.least + 20 * self.size:
                first = dict(list(held.items())[: 20 * self.size])
                held = {p: x for p, x in held.items() if p not in first}
                sent += len(first)
                yield from self._jobs(key, "count", first)
        due = self.wait_ms and held and min(b for _, b in held.values()) + self.wait_ms <= now
        if len(held) + sent >= self.least or due:
            yield from self._jobs(key, "count" if len(held) + sent >= self.least else "age", held)
            held = {}
        if held:
            self.waiting.put([(p, a, b) for p, (a, b) in held.items()])
        else:
            self.waiting.clear()
        self._timers(min(b for _, b in held.values()) + self.wait_ms if held and self.wait_ms else None)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = {int(p): (int(a), int(b)) for p, a, b in self.waiting.get()}
        self.waiting.clear()
        if held:
            yield from self._jobs(key, "age", held)

    def close(self) -> None:
        pass


def dispatched(posts: DataFrame, least: int, wait_minutes: int, size: int = JOB) -> DataFrame:
    """tag, why (count or age) and post_ids, a row a job, of a stream of routed posts (post_id, tag, posted_at, routed_at): what routing.dispatch_due() finds at the end of each batch.

    A post that comes again while it waits counts once, one that comes again after its job is another post: see windows.first_of_each().  Late rows count;
    rows without an id or a time of routing don't.  A null tag is a tag.  Needs the RocksDB state store.
    """
    rows = posts.where("post_id IS NOT NULL AND routed_at IS NOT NULL").select("tag", F.col("post_id").cast("long").alias("post_id"), F.coalesce(F.unix_millis(F.col("posted_at").cast("timestamp")), F.lit(-(1 << 62))).alias("posted"), F.unix_millis(F.col("routed_at").cast("timestamp")).alias("routed"))
    return rows.groupBy("tag").transformWithStateInPandas(CountOrAge(least, wait_minutes * 60_000, size), _JOBS, "Append", "ProcessingTime")


class Ledger:
    """Which batches of a stream a versioned table holds: a folder of versions, each written whole and named by the batch after which it stands.

    A version counts once its success file is there; so a batch that was cut off is written again, and one that ends twice is left alone.
    """

    def __init__(self, folder: str) -> None:
        self.folder = folder.rstrip("/")

    def _files(self, spark):
        root = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return root.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path

    def versions(self, spark) -> list[int]:
        files, path = self._files(spark)
        if not files.exists(path(self.folder)):
            return []
        names = [s.getPath().getName() for s in files.listStatus(path(self.folder))]
        return sorted(int(n[2:]) for n in names if n.startswith("v=") and files.exists(path(f"{self.folder}/{n}/_SUCCESS")))

    def path(self, version: int) -> str:
        return f"{self.folder}/v={version:012}"

    def read(self, spark, schema) -> DataFrame:
        found = self.versions(spark)
        return spark.read.schema(schema).parquet(self.path(found[-1])) if found else spark.createDataFrame([], schema)

    def write(self, rows: DataFrame, version: int, keep: int = 2) -> None:
        rows.write.mode("overwrite").parquet(self.path(version))
        files, path = self._files(rows.sparkSession)
        for old in self.versions(rows.sparkSession)[:-keep]:
            files.delete(path(self.path(old)), True)


def ingest(ledger: Ledger, schema, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the table with the batch merged in, once for each batch id, however often the batch is run."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = ledger.versions(spark)
        if found and found[-1] >= batch_id:
            return
        ledger.write(merge(ledger.read(spark, schema), batch), batch_id)

    return run


def fetched(accounts: DataFrame, pages: DataFrame, at: str) -> DataFrame:
    """accounts with last_fetched_at = at for those that pages (account_id) are from."""
    seen = pages.select("account_id").distinct().withColumn("_seen", F.lit(True))
    return accounts.join(seen, "account_id", "left").withColumn("last_fetched_at", F.when(F.col("_seen"), F.lit(at).cast("timestamp_ntz")).otherwise(F.col("last_fetched_at"))).drop("_seen")
