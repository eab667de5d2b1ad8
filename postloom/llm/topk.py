"""Exact top-k by inner product, block at a time.

Rows are dealt by sampled ranges of vec_id into shards of about SHARD_ROWS, however ids
are spread or repeated; a shard's rows form blocks with a forward index (the integer
matrix) and each term's (dimension's) largest and smallest value.  For each query the
blocks are ordered by the sum over terms of the largest possible product; blocks are
scored in that order until the bound falls below the query's kth score so far.

Queries go to the shards in packs of at most PACK_BYTES, so no vector is ever moved or
copied for them.  A pack first meets a few shards; the kth scores found there go along
to all others, which report only what comes up to them.  A window takes the best k.

Scores are exact integers: where products can pass 2^53, blocks are scored in floating point with
a bound of its error, and what may be among the best k in Python's integers.  Between shards scores
go as decimals of 38 digits; larger ones count as the largest of these, and the score returned is the nearest long.

Defined cases: vectors that are null, or hold null or non-finite components (or finite ones whose 256-fold isn't), take no
part; shorter vectors count as padded with 0 (an empty one scores 0 everywhere); ties
go to the smaller vec_id; rows with a null vec_id take no part; repeated vec_ids are
each a candidate and a query, but never of their own id; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom.llm.common import bounded_batches, spared, stored

SCALE, K, EVERY = 256, 5, 50
SHARD_ROWS, BLOCK_ROWS = 8192, 512
#: Bytes of the queries of a pack, and shards that it meets first.
PACK_BYTES, FIRST = 32 << 20, 4


_SCORE = pa.decimal128(38, 0)


def best_k(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, block: int = BLOCK_ROWS, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of each query's k best rows among `rows`, ties to smaller ids; only of those that reach the query's floor."""
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    n, m = len(queries), len(ids)
    starts = np.arange(0, m, block)
    most = np.maximum.reduceat(rows, starts, axis=0)
    least = np.minimum.reduceat(rows, starts, axis=0)
    bound = np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T
    visit = np.argsort(-bound, axis=1, kind="stable")
    kth = np.full(n, -np.inf) if floor is None else floor.copy()
    top_score = np.full((n, k), -np.inf)
    top_id = np.zeros((n, k), np.int64)
    for step in range(len(starts)):
        block_of = visit[:, step]
        alive = bound[np.arange(n), block_of] >= kth
        if not alive.any():
            break
        for b in np.unique(block_of[alive]):
            q = np.flatnonzero(alive & (block_of == b))
            part = slice(starts[b], min(starts[b] + block, m))
            scores = queries[q] @ rows[part].T
            scores[query_ids[q][:, None] == ids[part][None, :]] = -np.inf
            least_ = kth[q]
            if scores.shape[1] > k:
                least_ = np.maximum(least_, np.partition(scores, scores.shape[1] - k, axis=1)[:, -k])
            at, col = np.nonzero((scores >= least_[:, None]) & np.isfinite(scores))
            if not len(at):
                continue
            # the new candidates and those so far, best first within each query
            touched = np.unique(at)
            qs = np.concatenate([at, np.repeat(touched, k)])
            sc = np.concatenate([scores[at, col], top_score[q[touched]].ravel()])
            vi = np.concatenate([ids[part][col], top_id[q[touched]].ravel()])
            by = np.lexsort((vi, -sc, qs))
            qs, sc, vi = qs[by], sc[by], vi[by]
            first = np.searchsorted(qs, touched)
            take = first[:, None] + np.arange(k)
            top_score[q[touched]] = sc[take]
            top_id[q[touched]] = vi[take]
            kth[q[touched]] = np.maximum(kth[q[touched]], sc[take[:, -1]])
    at, col = np.nonzero(np.isfinite(top_score))
    return at, top_id[at, col], top_score[at, col].astype(np.int64)


#: Integers that floating point holds exactly, and the largest score between shards.
EXACT, LARGEST = 2**53, 10**38 - 1


def exact_k(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, block: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """As best_k(), for components of any size (integers as floats): scores are Python's integers."""
    n, dims = queries.shape
    # by powers of two, so that no product is beyond floating point; what is lost to 0 is less than `lost`
    a, b = (2.0 ** -np.frexp(np.abs(x).max(initial=1.0))[1] for x in (queries, rows))
    small_q, small_r = queries * a, rows * b
    best: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    whole = [None] * n
    for lo in range(0, len(ids), block):
        part = slice(lo, lo + block)
        near = small_q @ small_r[part].T
        slack = (np.abs(small_q) @ np.abs(small_r[part]).T) * dims * 2.0**-50 + 2.0**-900
        own = query_ids[:, None] == ids[part][None, :]
        low, high = np.where(own, -np.inf, near - slack), np.where(own, -np.inf, near + slack)
        least = np.partition(low, low.shape[1] - k, axis=1)[:, -k] if low.shape[1] > k else np.full(n, -np.inf)
        exact: dict[int, list[int]] = {}
        for q, r in zip(*(x.tolist() for x in np.nonzero((high >= least[:, None]) & ~own)), strict=True):
            if whole[q] is None:
                whole[q] = [int(x) for x in queries[q].tolist()]
            if r not in exact:
                exact[r] = [int(x) for x in rows[lo + r].tolist()]
            best[q].append((-sum(x * y for x, y in zip(whole[q], exact[r], strict=True)), int(ids[lo + r])))
        best = [sorted(x)[:k] for x in best]
    found = [(q, i, -s) for q, x in enumerate(best) for s, i in x]
    at, vec, sc = zip(*found, strict=True) if found else ((), (), ())
    return np.array(at, np.int64), np.array(vec, np.int64), [max(-LARGEST, min(LARGEST, s)) for s in sc]


def vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and the integer components of the rows that take part."""
    # from 2^53 on a double is an integer, and may be beyond what floor() returns
    v = F.transform("embedding", lambda x: F.when(F.abs(x.cast("double") * SCALE) < EXACT, F.floor(x.cast("double") * SCALE).cast("double")).otherwise(x.cast("double") * SCALE))
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * SCALE) < float("inf")))
    return embeddings.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def search(embeddings: DataFrame, k: int = K, every: int = EVERY, shard_rows: int = SHARD_ROWS, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the k best other rows."""
    spark = embeddings.sparkSession
    bounded_batches(spark)
    rows = vectors(embeddings)
    facts = rows.agg(F.count("*").alias("n"), F.count_if(F.pmod("vec_id", F.lit(every)) == 0).alias("q"), F.max(F.size("v")).alias("d")).first()
    shards, dims = max(1, -(-facts["n"] // shard_rows)), max(1, facts["d"] or 1)
    packs = max(1, -(-facts["q"] * dims * 8 // pack_bytes))
    ranged = rows.repartitionByRange(shards, "vec_id", F.xxhash64("v")).withColumn("shard", F.spark_partition_id())
    table = stored(ranged, "vectors")
    asks = table.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v").withColumn("pack", F.pmod(F.xxhash64("vec_id", "v"), F.lit(packs)).cast("int"))

    def matrix(v: pa.Array) -> np.ndarray:
        flat, ends = v.values.to_numpy(zero_copy_only=False), v.offsets.to_numpy()
        out = np.zeros((len(v), dims))
        sizes = np.diff(ends)
        at = np.repeat(np.arange(len(v)), sizes)
        out[at, np.arange(len(at)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat[ends[0] : ends[-1]]
        return out

    def meet(shared, part: DataFrame) -> DataFrame:
        """query (its row in the pack), vec_id, score of what the shards have for the pack; a task carries the kth from shard to shard."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            query_ids, queries, floor = shared.value
            floor = floor.copy()

            def shard(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
                ids, grid = (np.concatenate(x) for x in zip(*parts, strict=True))
                if np.abs(queries).max(initial=0) * np.abs(grid).max(initial=0) * dims >= EXACT:
                    at, vec, sc = exact_k(query_ids, queries, ids, grid, k)
                    scores = pa.array([Decimal(s) for s in sc], _SCORE)
                else:
                    at, vec, sc = best_k(query_ids, queries, ids, grid, k, floor=floor)
                    full = np.flatnonzero(np.bincount(at, minlength=len(queries)) >= k)
                    ends = np.searchsorted(at, full, side="right") - 1
                    floor[full] = np.maximum(floor[full], sc[ends])
                    scores = pa.array(sc).cast(pa.decimal128(19, 0)).cast(_SCORE)
                return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(vec), scores], ["query", "vec_id", "score"])

            held: list[tuple[np.ndarray, np.ndarray]] = []
            now = None
            for batch in batches:
                of = batch.column(2).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
                for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                    if hi == lo:
                        continue
                    if now is not None and (of[lo] != now or sum(len(i) for i, _ in held) >= 4 * shard_rows):
                        yield shard(held)
                        held = []
                    now = of[lo]
                    held.append((batch.column(0).slice(lo, hi - lo).to_numpy(), matrix(batch.column(1).slice(lo, hi - lo))))
            if held:
                yield shard(held)

        return part.select("vec_id", "v", "shard").mapInArrow(spared(run), "query int, vec_id long, score decimal(38,0)")

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    found = []
    for pack in range(packs):  # each of bounded size
        held = asks.where(F.col("pack") == pack).select("vec_id", "v").toArrow() if facts["q"] else None
        if held is None or not held.num_rows:
            continue
        ids, grid = held.column(0).to_numpy(), matrix(held.column(1).combine_chunks())
        order = np.argsort(ids, kind="stable")
        ids, grid = ids[order], grid[order]
        floor = np.full(len(ids), -np.inf)
        if shards > 2 * FIRST:
            first = meet(spark.sparkContext.broadcast((ids, grid, floor)), table.where(F.col("shard") % -(-shards // FIRST) == 0))
            best = first.withColumn("rank", rank).where(F.col("rank") == k).select("query", "score").toArrow()
            # a shard of small numbers can't reach a kth that isn't exact here, but by a hair
            kth = np.array([float(x) for x in best.column(1).to_pylist()])
            floor[best.column(0).to_numpy()] = np.where(np.abs(kth) < EXACT, kth, kth - np.abs(kth) * 2.0**-50)
        pairs = meet(spark.sparkContext.broadcast((ids, grid, floor)), table).withColumn("rank", rank).where(F.col("rank") <= k)
        names = spark.createDataFrame(pa.table({"query": pa.array(np.arange(len(ids), dtype=np.int32)), "query_id": pa.array(ids)}))
        found.append(pairs.join(F.broadcast(names), "query").select("query_id", "rank", "vec_id", F.least(F.greatest("score", F.lit(-(2**63)).cast("decimal(38,0)")), F.lit(2**63 - 1).cast("decimal(38,0)")).cast("long").alias("score")))
        if packs > 1:
            found[-1] = stored(found[-1], "found")
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return reduce(DataFrame.unionByName, found)
