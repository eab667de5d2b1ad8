"""Upserts, insert-if-absent and dedupe as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key is not in new."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new whose key is not in old."""
    return new.join(old.select(key), key, "left_anti")


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the first by order.  Aggregated before the shuffle, so frequent keys cost nothing."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key: the last by order."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def stale(rows: DataFrame, cache: DataFrame, key: str, fresh: list[str]) -> DataFrame:
    """Keys of rows that the cache lacks, or holds with other values in the columns `fresh`; nulls equal nulls."""
    old = cache.select(key, F.struct(*fresh).alias("old"))
    same = F.coalesce(F.struct(*fresh).eqNullSafe(F.col("old")), F.lit(False))
    return rows.join(old, key, "left").where(~same).select(key)


def numbered(rows: DataFrame, key: str, order: list[Column], bucket: Column, name: str) -> DataFrame:
    """rows with their numbers, from 0, within the key's rows in that order.

    bucket never falls along the order.  Rows are numbered within key and bucket, and what the buckets before
    hold is added, so that a key of most rows is not one task's work.  Null keys are a key.
    """
    parted = rows.withColumn("_bucket", bucket)
    counts = parted.groupBy(F.col(key).alias("_key"), F.col("_bucket").alias("_of")).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("_key").orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_key", "_of", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)) - 1
    found = parted.withColumn("_within", within).join(counts, F.col(key).eqNullSafe(F.col("_key")) & F.col("_bucket").eqNullSafe(F.col("_of")))
    return found.withColumn(name, F.col("_within") + F.col("_before")).select(*rows.columns, name)


#: Rows with ids from one multiple of it to the next are numbered together.
SPAN = 100_000


def chunks(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Numbers each key's rows, by an integer column `order`, in chunks of `size`."""
    found = numbered(rows, key, [F.asc(order)], F.floor(F.col(order) / SPAN), "_pos")
    return found.withColumn("chunk", F.floor(F.col("_pos") / size).cast("int")).drop("_pos")


def leading(rows: DataFrame, key: str, order: list[Column], most: int, parts: int = 64) -> DataFrame:
    """The first `most` rows of each key in that order, numbered in r from 1.

    They are cut to `most` within parts by hash first, so that a key of most rows is never sorted in one task: parts * most rows of it meet at the end.
    """
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(parts)))
    within = Window.partitionBy(key, "_part").orderBy(*order)
    few = dealt.withColumn("r", F.row_number().over(within)).where(F.col("r") <= most).drop("_part", "r")
    return few.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("r") <= most)


def include(rows: DataFrame, related: DataFrame, key: str, related_key: str, name: str) -> DataFrame:
    """rows with the related row as a struct, null where there is none; fields that are never read aren't scanned.  Null keys have none, and related keys are unique."""
    inner = related.select(F.col(related_key).alias("_key"), F.struct(*[F.col(c) for c in related.columns]).alias(name))
    return rows.join(inner, F.col(key) == F.col("_key"), "left").drop("_key")


def chunk_cap(rows: DataFrame, key: str, order: str, size: int, most: int) -> DataFrame:
    """The first `most` rows of each chunk."""
    found = numbered(rows, key, [F.asc(order)], F.floor(F.col(order) / SPAN), "_pos")
    return found.where(F.col("_pos") % size < most).drop("_pos")


def upsert_columns(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of old with `columns` from new where the key is in both, and the rows of new whose key is not in old; of new's rows of one key the last by `columns` counts."""
    latest = new.groupBy(key).agg(F.max(F.struct(*columns, *[c for c in new.columns if c != key and c not in columns])).alias("n"))
    both = old.withColumn("_old", F.lit(True)).join(latest, key, "full")
    here = F.col("n").isNotNull()
    return both.select(key, *[F.when(here if c in columns else F.col("_old").isNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in old.columns if c != key])


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """Rows whose key is not in gone."""
    return rows.join(gone.select(key), key, "left_anti")


def write_summary(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """given, skipped (null keys), created and existing of rows to insert: each key counts once."""
    keys = new.groupBy(key).agg(F.count("*").alias("n")).join(old.select(key).distinct().withColumn("_old", F.lit(True)), key, "left")
    known = F.col(key).isNotNull()
    return keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("given"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("skipped"), F.count_if(known & F.col("_old").isNull()).alias("created"), F.count_if(known & F.col("_old").isNotNull()).alias("existing"))


def keyset(rows: DataFrame, at: Column, id_: Column, after: tuple | None, limit: int) -> DataFrame:
    """The next rows of a scan in the order of (at, id): those after the pair given."""
    if after is not None:
        rows = rows.where((at > F.lit(after[0])) | ((at == F.lit(after[0])) & (id_ > F.lit(after[1]))))
    return rows.orderBy(at, id_).limit(limit)


def sampled(rows: DataFrame, key: str, limit: int, seed: int = 17) -> DataFrame:
    """`limit` rows in the order of a hash of the key: the same for the same seed."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(limit)
