"""Tag samples as vectors: centroids, thresholds, scores of posts, semantic search."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom.functions.vectors import dot, normalized
from postloom.operators.quantiles import floor_quantile_columns

#: The sample cache holds at most so many of the newest samples of a tag.
PER_TAG = 200


def recent(samples: DataFrame, order: str, per_tag: int = PER_TAG) -> DataFrame:
    """The newest samples of each tag: the cache that posts are scored against."""
    newest = Window.partitionBy("tag").orderBy(F.desc(order))
    return samples.withColumn("r", F.row_number().over(newest)).where(F.col("r") <= per_tag).drop("r")


#: Sample vectors that go to every executor at most at a time.
CACHE = 20_000
ROWS = 1000  #: posts that a task compares with the cache at a time


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Unit vectors of `width` components: missing and null ones are 0, further ones have nothing to meet; vectors of length 0, or not finite, are 0."""
    flat, ends = vectors.values, vectors.offsets.to_numpy()
    if width and not flat.null_count and len(vectors) and (np.diff(ends) == width).all():
        out = flat.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]].reshape(-1, width)
    else:
        out = np.zeros((len(vectors), width))
        for i, v in enumerate(vectors.to_pylist()):
            part = [x or 0.0 for x in (v or [])[:width]]
            out[i, : len(part)] = part
    with np.errstate(over="ignore", invalid="ignore"):
        size = np.sqrt((out * out).sum(1, keepdims=True))
    fine = np.isfinite(size) & (size > 0)
    return np.divide(out, size, out=np.zeros_like(out), where=np.broadcast_to(fine, out.shape))


def _parts(samples: DataFrame, order: list[str] | None) -> tuple[list[str], list[list[str]], list[tuple[str, int]]]:
    """The tags in their order, those of at most CACHE samples in parts of at most CACHE, and the others with the number of their slices."""
    counts = {r["tag"]: r["n"] for r in samples.groupBy("tag").agg(F.count("*").alias("n")).collect()}  # one row a tag
    tags = [t for t in dict.fromkeys(order or []) if t in counts]
    tags += sorted(set(counts) - set(tags))
    parts: list[list[str]] = []
    room = 0
    for tag in tags:
        if counts[tag] <= CACHE:
            if counts[tag] > room:
                parts.append([])
                room = CACHE
            parts[-1].append(tag)
            room -= counts[tag]
    return tags, parts, [(t, -(-2 * counts[t] // CACHE)) for t in tags if counts[t] > CACHE]


def _best_mean(scores: np.ndarray, k: int) -> np.ndarray:
    """Of each row the mean of its k highest scores, or of all that there are."""
    if k == 1:
        return scores.max(1)
    best = -np.sort(-scores, axis=1)[:, :k]
    there = np.isfinite(best)
    return np.where(there.any(1), np.where(there, best, 0).sum(1) / np.maximum(there.sum(1), 1), -np.inf)


class _Cache:
    """Sample vectors of some tags, by tag, with each tag's centre and the radius about it."""

    def __init__(self, rows: list, ranks: dict[str, int], width: int) -> None:
        rows = sorted(rows, key=lambda r: ranks[r["tag"]])
        self.width, self.tags = width, list(dict.fromkeys(r["tag"] for r in rows))
        self.ranks = [ranks[t] for t in self.tags]
        self.grid = _matrix(pa.array([list(r["v"]) for r in rows], pa.list_(pa.float64())), width)
        of = np.array([ranks[r["tag"]] for r in rows])
        self.starts = np.searchsorted(of, self.ranks).tolist()
        self.ends = [*self.starts[1:], len(rows)][: len(self.starts)]
        parts = [self.grid[a:b] for a, b in zip(self.starts, self.ends, strict=True)]
        self.centre = np.array([x.mean(0) for x in parts]).reshape(len(parts), width)
        self.radius = np.array([np.sqrt(((x - c) ** 2).sum(1)).max() for x, c in zip(parts, self.centre, strict=True)])
        self.own: dict[object, list[int]] = {}
        for i, r in enumerate(rows):
            if "sample_id" in r:
                self.own.setdefault(r["sample_id"], []).append(i)

    def scores(self, posts: np.ndarray, ids: list, rows: np.ndarray, t: int) -> np.ndarray:
        """Of some rows of posts with the samples of tag t; a sample that is the post itself doesn't count."""
        a, b = self.starts[t], self.ends[t]
        out = posts[rows] @ self.grid[a:b].T
        for i, r in enumerate(rows.tolist() if self.own else []):
            for at in self.own.get(ids[r], ()):
                if a <= at < b:
                    out[i, at - a] = -np.inf
        return out

    def best(self, posts: np.ndarray, ids: list, known: np.ndarray, ks: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Tag (its place, -1 without one), best and second score by k and post; and how many pairs of post and tag were scored.

        A unit vector's product with a sample is at most its product with the tag's centre and the radius: where that is below the second score of every k, the tag is left out.
        """
        n = len(posts)
        tag, top, second = np.full((len(ks), n), -1), np.full((len(ks), n), -np.inf), np.full((len(ks), n), -np.inf)
        bound = posts @ self.centre.T + self.radius + 1e-9
        done = 0
        for t in np.argsort(-bound.max(0, initial=-np.inf), kind="stable").tolist() if n else []:
            rows = np.flatnonzero(known & (bound[:, t] >= second.min(0)))
            done += len(rows)
            if not len(rows):
                continue
            some = self.scores(posts, ids, rows, t)
            for j, k in enumerate(ks):
                value, was = _best_mean(some, k), top[j, rows]
                value[value <= -1] = -np.inf  # as good as none
                better = (value > was) | ((value == was) & (t < tag[j, rows]) & np.isfinite(value))
                second[j, rows] = np.where(better, was, np.maximum(second[j, rows], value))
                top[j, rows] = np.where(better, value, was)
                tag[j, rows] = np.where(better, t, tag[j, rows])
        return tag, top, second, done


def tag_scores(posts: DataFrame, samples: DataFrame, ks: tuple[int, ...] = (1,), order: list[str] | None = None) -> DataFrame:
    """post_id, known, k, tag, score, second for each post (post_id, v) and k: the tag whose k best samples (tag, v) have the highest mean, that mean, and the next tag's.

    Vectors count as unit vectors.  known: the post has a vector, of the samples' size.  Ties go to the tag that stands first in `order`, of others
    (all, without it) to the smaller; a mean of -1 or less is none.  A sample with the post's own id, where samples have a sample_id, doesn't count.
    The samples are a cache, see recent(), that goes to the executors in parts of at most CACHE vectors; a batch of posts meets the tags of a part as products of
    matrices, those alone whose bound reaches the second best.  Of a tag of more samples each slice gives its k best scores, which are merged by post.
    No post is moved or repeated where one part holds all.
    """
    spark = posts.sparkSession
    samples = samples.where("tag is not null and v is not null")
    kind = posts.schema["post_id"].dataType.simpleString()
    names = ["post_id", "known", "k", "tag", "rank", "score", "second"]
    rows = posts.select("post_id", F.col("v").cast("array<double>").alias("v"))
    tags, parts, sliced = _parts(samples, order)
    ranks = {t: i for i, t in enumerate(tags)}
    width = (samples.agg(F.max(F.size("v"))).first()[0] or 0) if tags else 0
    cols = ["tag", "v", *(["sample_id"] if "sample_id" in samples.columns else [])]

    def shared(chosen: DataFrame):
        return spark.sparkContext.broadcast(_Cache([r.asDict() for r in chosen.select(*cols).collect()], ranks, width))

    def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                ids, vectors = (batch.column(i).slice(lo, ROWS) for i in (0, 1))
                known = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False).to_numpy(zero_copy_only=False).astype(bool) & (width > 0)
                yield ids, known, _matrix(pc.if_else(vectors.is_valid(), vectors, pa.scalar([], vectors.type)), width)

    def whole(cache) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = cache.value
            for ids, known, grid in batches_of(batches):
                tag, top, second, _ = held.best(grid, ids.to_pylist(), known, ks)
                for j, k in enumerate(ks):
                    none = tag[j] < 0
                    named = [None if t < 0 else held.tags[t] for t in tag[j].tolist()]
                    rank = [None if t < 0 else held.ranks[t] for t in tag[j].tolist()]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(known), pa.array(np.full(len(ids), k, np.int32)), pa.array(named, pa.string()), pa.array(rank, pa.int32()), pa.array(top[j], mask=none), pa.array(second[j], mask=none | ~np.isfinite(second[j]))], names)

        return rows.mapInArrow(run, f"post_id {kind}, known boolean, k int, tag string, rank int, score double, second double")

    def slice_of(cache) -> DataFrame:
        most = max(ks)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = cache.value
            for ids, known, grid in batches_of(batches):
                best = -np.sort(-held.scores(grid, ids.to_pylist(), np.arange(len(grid)), 0), axis=1)[:, :most] if held.tags else np.zeros((len(grid), 0))
                lists = [[x for x in b if x > -np.inf] if f else [] for b, f in zip(best.tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([ids, pa.array(known), pa.array(lists, pa.list_(pa.float64()))], ["post_id", "known", "best"])

        return rows.mapInArrow(run, f"post_id {kind}, known boolean, best array<double>")

    found = [whole(shared(samples.where(F.col("tag").isin(part)))) for part in parts or [[]]] if parts or not sliced else []
    for tag, n in sliced:
        of = F.pmod(F.xxhash64("v", *cols[2:]), F.lit(n))
        each = reduce(DataFrame.unionByName, [slice_of(shared(samples.where((F.col("tag") == tag) & (of == i)))) for i in range(n)])
        best = each.groupBy("post_id").agg(F.bool_or("known").alias("known"), F.slice(F.sort_array(F.flatten(F.collect_list("best")), False), 1, max(ks)).alias("best"))
        by_k = best.select("post_id", "known", F.explode(F.lit(list(ks))).alias("k"), "best").withColumn("best", F.slice("best", F.lit(1), F.col("k")))
        mean = F.aggregate("best", F.lit(0.0), lambda x, y: x + y) / F.size("best")
        by_k = by_k.withColumn("score", F.when((F.size("best") > 0) & (mean > -1), mean))
        found.append(by_k.select("post_id", "known", "k", F.when(F.col("score").isNotNull(), tag).alias("tag"), F.when(F.col("score").isNotNull(), ranks[tag]).alias("rank"), "score", F.lit(None).cast("double").alias("second")))
    if len(found) == 1:
        return found[0].drop("rank")
    # the best two of each part's best two
    two = F.array(F.struct((-F.col("score")).alias("s"), "rank", "tag"), F.struct((-F.col("second")).alias("s"), F.lit(len(tags)).alias("rank"), F.lit(None).cast("string").alias("tag")))
    merged = reduce(DataFrame.unionByName, found).groupBy("post_id", "k").agg(F.bool_or("known").alias("known"), F.array_sort(F.filter(F.flatten(F.collect_list(two)), lambda x: x["s"].isNotNull())).alias("all"))
    at = [F.get("all", F.lit(i)) for i in (0, 1)]
    # a second that ties with the best of another part stands behind it
    return merged.select("post_id", "known", "k", at[0]["tag"].alias("tag"), (-at[0]["s"]).alias("score"), (-at[1]["s"]).alias("second"))


def nearest_tags(posts: DataFrame, samples: DataFrame, order: list[str] | None = None) -> DataFrame:
    """post_id, known, tag, score, second: best and second tag of each post by its best sample, see tag_scores()."""
    return tag_scores(posts, samples, order=order).select("post_id", "known", "tag", "score", "second")


def centroids(samples: DataFrame) -> DataFrame:
    """tag and the normalised sum of its normalised vectors."""
    units = samples.where("v is not null").select("tag", array_to_vector(normalized(F.col("v"))).alias("u"))
    sums = units.groupBy("tag").agg(Summarizer.sum(F.col("u")).alias("s"))  # one vector a tag and task is shuffled
    return sums.select("tag", normalized(vector_to_array("s")).alias("c"))


def tag_stats(samples: DataFrame) -> DataFrame:
    """Per tag: samples, and mean and quantiles of their likeness to the tag's centroid."""
    sims = samples.join(F.broadcast(centroids(samples)), "tag").select("tag", dot(normalized(F.col("v")), F.col("c")).alias("sim"))
    counts = sims.groupBy("tag").agg(F.count("*").alias("samples"), F.avg("sim").alias("mean"))
    return counts.join(floor_quantile_columns(sims, "tag", "sim", {"p25": 0.25, "p50": 0.5, "p75": 0.75}), "tag")


def _clamp(x: Column, lo: Column | float, hi: Column | float) -> Column:
    lo, hi = (F.lit(b) if isinstance(b, float) else b for b in (lo, hi))
    return F.least(hi, F.greatest(lo, x))


def thresholds(stats: DataFrame, low: float = 0.68, high: float = 0.86, margin: float = 0.04, strict: float = 0.9, least: int = 10) -> DataFrame:
    """tag, low, high, margin, strict, drawn halfway to the tag's own quantiles and by 0.05 at most; tags of few samples keep the defaults."""
    known = F.col("samples") >= least
    top = F.when(known, _clamp((high + F.col("p75")) / 2, high - 0.05, high + 0.05)).otherwise(high)
    bottom = F.when(known, _clamp((low + F.col("p25")) / 2, low - 0.05, low + 0.05)).otherwise(low)
    out = stats.select("tag", bottom.alias("low"), top.alias("high"), F.when(known & (F.col("p75") - F.col("p50") < 0.02), min(0.08, margin + 0.01)).otherwise(margin).alias("margin"))
    out = out.withColumn("strict", F.greatest(F.lit(strict), F.when(F.col("high") == high, strict).otherwise(F.col("high") + 0.02)))
    return out.withColumn("low", F.when(F.col("low") >= F.col("high") - 0.02, _clamp(F.col("high") - 0.02, F.lit(0.5), F.col("high") - 0.01)).otherwise(F.col("low")))


def semantic_page(posts: DataFrame, query: DataFrame, order: list[Column], number: int = 1, size: int = 20, candidates: int = 2000) -> DataFrame:
    """A page of the `candidates` first posts in that order, by likeness to the one vector q of query."""
    first = posts.orderBy(*order).limit(max(candidates, number * size))
    scored = first.join(F.broadcast(query.select("q").limit(1))).withColumn("score", dot(normalized(F.col("v")), normalized(F.col("q"))))
    return scored.orderBy(F.desc("score"), *order).offset((number - 1) * size).limit(size).drop("q")


def diagnostics(posts: DataFrame, samples: DataFrame, ks: list[int]) -> DataFrame:
    """For each k: posts, mean and quantiles of the best tag's mean of k samples; all k in one pass over the posts."""
    best = tag_scores(posts, samples, tuple(ks)).select("k", "score")
    return best.groupBy("k").agg(F.count("score").alias("posts"), F.avg("score").alias("mean"), F.max("score").alias("hi")).join(floor_quantile_columns(best, "k", "score", {"q50": 0.5, "q90": 0.9}), "k")


def buckets(posts: DataFrame, samples: DataFrame, ks: list[int], width: float = 0.02) -> DataFrame:
    """k, bucket, posts: the best tags' scores of every k in parts of the width."""
    best = tag_scores(posts, samples, tuple(ks)).where("score is not null")
    return best.groupBy("k", F.floor(F.col("score") / F.lit(width)).cast("int").alias("bucket")).agg(F.count("*").alias("posts"))


def negative_stats(posts: DataFrame, samples: DataFrame, negatives: DataFrame) -> DataFrame:
    """One row: posts, mean distance (1 - likeness) to the centroid of the negatives (v), and mean and lowest gap from the best tag's score to that likeness."""
    centre = centroids(negatives.select(F.lit("-").alias("tag"), "v")).select("c")  # one row
    near = posts.crossJoin(F.broadcast(centre)).select("post_id", dot(normalized(F.col("v")), F.col("c")).alias("near"))
    both = tag_scores(posts, samples).join(near, "post_id").where("score is not null")
    gap = F.col("score") - F.col("near")
    return both.agg(F.count("*").alias("posts"), F.avg(1 - F.col("near")).alias("distance"), F.max("near").alias("nearest"), F.avg(gap).alias("gap"), F.min(gap).alias("least_gap"))


def gap_quantiles(posts: DataFrame, samples: DataFrame, negatives: DataFrame, ks: list[int], qs: dict[str, float]) -> DataFrame:
    """k, measure, posts, mean and quantiles: for every k of the best tag's score, of the distance to the negatives' centroid and of the gap between score and likeness to it, all of one pass over the posts."""
    centre = centroids(negatives.select(F.lit("-").alias("tag"), "v")).select("c")  # one row
    near = posts.crossJoin(F.broadcast(centre)).select("post_id", dot(normalized(F.col("v")), F.col("c")).alias("near"))
    both = tag_scores(posts, samples, tuple(ks)).where("score is not null").join(near, "post_id")
    measures = {"score": F.col("score"), "distance": 1 - F.col("near"), "gap": F.col("score") - F.col("near")}
    rows = both.select(F.inline(F.array(*[F.struct(F.concat_ws(":", F.col("k"), F.lit(name)).alias("key"), x.alias("value")) for name, x in measures.items()])))
    found = rows.groupBy("key").agg(F.count("value").alias("posts"), F.avg("value").alias("mean")).join(floor_quantile_columns(rows, "key", "value", qs), "key")
    part = F.split("key", ":")
    return found.select(part[0].cast("int").alias("k"), part[1].alias("measure"), "posts", "mean", *qs)
