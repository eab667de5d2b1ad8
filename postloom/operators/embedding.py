"""Vectors of texts by a provider, in batches, and the cache of those that are fresh."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import embedding_input

BATCH = 10  #: texts of one call


class Provider(Protocol):
    model: str
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Hashing:
    """A provider without a network: words add up by hashed place and sign."""

    def __init__(self, dimensions: int = 512, model: str = "hashing") -> None:
        self.dimensions, self.model = dimensions, model

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dimensions))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                row[h % self.dimensions] += 1.0 if h >> 63 else -1.0
        return out.tolist()


def _vectors(provider: Provider, inputs: list[str]) -> list[list[float]]:
    """The provider's answers, batch by batch; another number of vectors than of texts fails."""
    vectors: list[list[float]] = []
    for lo in range(0, len(inputs), BATCH):
        part = inputs[lo : lo + BATCH]
        got = provider.embed(part)
        if len(got) != len(part):
            raise ValueError(f"{len(got)} vectors for {len(part)} texts")
        vectors += got
    return vectors


def embed(rows: DataFrame, provider: Provider) -> DataFrame:
    """post_id, v, model, dimensions, hash of rows (post_id, input, hash); a provider that answers with another number of vectors fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["post_id", "hash"]].assign(v=_vectors(provider, batch["input"].tolist()))[["post_id", "v", "hash"]]

    kind = dict(rows.dtypes)["post_id"]
    made = rows.select("post_id", "input", "hash").mapInPandas(run, f"post_id {kind}, v array<double>, hash string")
    return made.select("post_id", "v", F.lit(provider.model).alias("model"), F.lit(provider.dimensions).alias("dimensions"), "hash")


def refreshed(posts: DataFrame, cache: DataFrame, provider: Provider) -> DataFrame:
    """The cache (post_id, v, model, dimensions, hash) after the posts (post_id, text, lang) whose vector it lacks, or holds for another text, model or size, were embedded.

    Inputs are made and met with the cache once: a post's row asks for a vector, or has the cached one, which passes through.  Posts without an id have no vector.
    """
    given = embedding_input(F.coalesce("text", F.lit("")), F.col("lang"))
    rows = posts.where("post_id is not null").select("post_id", given.alias("input")).withColumn("hash", F.sha2("input", 256))
    asked = rows.groupBy("post_id").agg(F.collect_list(F.struct("input", "hash")).alias("asked"))
    known = cache.withColumn("usable", (F.size("v") == F.col("dimensions")) & (F.col("model") == provider.model) & (F.col("dimensions") == provider.dimensions))
    both = asked.join(known, "post_id", "full")
    fresh = F.coalesce(F.col("usable") & F.forall("asked", lambda a: a["hash"].eqNullSafe(F.col("hash"))), F.lit(False))
    old = F.array(F.struct(F.lit(None).cast("string").alias("input"), F.col("hash")))
    each = both.select("post_id", "v", "model", "dimensions", F.explode(F.when(F.col("asked").isNull() | fresh, old).otherwise(F.col("asked"))).alias("a")).select("post_id", "a.input", "v", "model", "dimensions", "a.hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs = batch.column("input")
            new = pc.is_valid(inputs)
            made = pa.array(_vectors(provider, inputs.drop_null().to_pylist()), batch.schema.field("v").type)
            place = np.where(new, len(inputs) + np.cumsum(new) - 1, np.arange(len(inputs)))
            v = pa.concat_arrays([batch.column("v"), made]).take(pa.array(place))
            model = pc.if_else(new, provider.model, batch.column("model"))
            size = pc.if_else(new, pa.scalar(provider.dimensions, batch.schema.field("dimensions").type), batch.column("dimensions"))
            yield pa.RecordBatch.from_arrays([batch.column("post_id"), v, model, size, batch.column("hash")], ["post_id", "v", "model", "dimensions", "hash"])

    kinds = dict(each.dtypes)
    return each.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in ("post_id", "v", "model", "dimensions", "hash"))).select(cache.columns)
