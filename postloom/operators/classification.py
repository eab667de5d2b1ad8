"""Classification of pending posts: rules, then neighbours, and what is written back to posts, insights and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom.functions.text import ALIASES, TAGS, filter_tags, truncate
from postloom.operators import routing
from postloom.operators.merge import SPAN, leading, numbered

#: Posts of a run (the newest), posts of a batch, batches of a run, posts of a job.
NEWEST, BATCH, BATCHES, JOB = 1000, 10, 100, 50
DECISION = ["post_id", "status", "tag", "score", "margin", "reason", "importance"]


def decide(posts: DataFrame, vectors: DataFrame, samples: DataFrame, newest: int | None = NEWEST, **limits) -> DataFrame:
    """post_id, status, tag, score, margin, reason, importance for the newest pending posts (post_id, lang, text, posted_at; None: for all).

    What the rules drop is ignored for their reason; the others go to the neighbours of their vectors (post_id, v), see routing.knn().
    """
    rows = posts if newest is None else posts.orderBy(F.desc("posted_at"), F.desc("post_id")).limit(newest)
    outcome = routing.rules(rows)
    kept = outcome.where("outcome = 'rule-keep'").select("post_id").join(vectors, "post_id", "left")
    dropped = outcome.where("outcome <> 'rule-keep'").select("post_id", F.lit("IGNORED").alias("status"), F.lit(None).cast("string").alias("tag"), *[F.lit(None).cast("double").alias(c) for c in ("score", "margin")], F.col("outcome").alias("reason"), F.lit(None).cast("int").alias("importance"))
    return dropped.select(DECISION).unionByName(routing.knn(kept, samples, **limits).select(DECISION))


def reason_counts(decisions: DataFrame) -> DataFrame:
    """reason, posts of both stages: what the rules kept counts as rule-keep as well, and high ones by their importance."""
    late = F.startswith("reason", F.lit("embed-"))
    named = F.when(F.col("reason") == "embed-high", F.concat(F.lit("embed-high-"), F.col("importance").cast("string"))).otherwise(F.col("reason"))
    both = decisions.select(F.explode(F.when(late, F.array(F.lit("rule-keep"), named)).otherwise(F.array(named))).alias("reason"))
    return both.groupBy("reason").agg(F.count("*").alias("posts"))


def auto_insights(posts: DataFrame, decisions: DataFrame) -> DataFrame:
    """post_id, verdict, importance, tags, summary, suggestions of the posts that need no model: ignored ones, and high ones to watch."""
    high = F.col("d.status") == "AUTO_HIGH"
    both = decisions.where("status IN ('IGNORED', 'AUTO_HIGH')").alias("d").join(posts.select("post_id", "text"), "post_id")
    return both.select("post_id", F.when(high, "watch").otherwise("ignore").alias("verdict"), F.when(high, F.col("d.importance")).otherwise(1).alias("importance"), F.array(F.when(high, F.col("d.tag")).otherwise("other")).alias("tags"), truncate(F.col("text"), 120).alias("summary"), F.lit(None).cast("string").alias("suggestions"))


def routed(posts: DataFrame, decisions: DataFrame, at: str) -> DataFrame:
    """The posts' states (post_id, status, tag, score, margin, reason, routed_at, processed_at, queued_at) after the decisions: others stay as they were."""
    now, new = F.expr(f"timestamp_ntz '{at}'"), F.col("n.status").isNotNull()
    both = posts.alias("o").join(decisions.select(DECISION).alias("n"), "post_id", "left")
    changed = [F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in DECISION[1:6]]
    done = F.col("n.status").isin("IGNORED", "AUTO_HIGH")
    times = [F.when(new, now).otherwise(F.col("o.routed_at")).alias("routed_at"), F.when(done, now).otherwise(F.col("o.processed_at")).alias("processed_at"), F.when(~new, F.col("o.queued_at")).alias("queued_at")]
    return both.select("post_id", *changed, *times)


def changed_if(posts: DataFrame, ids: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    """All posts; of those in ids that still meet the condition, the columns have the new values."""
    marked = posts.join(ids.select("post_id").distinct().withColumn("_named", F.lit(True)), "post_id", "left")
    here = F.coalesce(F.col("_named") & condition, F.lit(False))
    return marked.select(*[F.when(here, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in posts.columns])


def queued(posts: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Posts queued for the model, where they are still routed and not queued."""
    return changed_if(posts, ids, (F.col("status") == "ROUTED") & F.col("queued_at").isNull(), {"status": F.lit("LLM_QUEUED"), "queued_at": F.expr(f"timestamp_ntz '{at}'")})


def put_back(posts: DataFrame, ids: DataFrame) -> DataFrame:
    """Posts whose job could not be queued are routed again, where no insight came meanwhile."""
    return changed_if(posts, ids, F.col("status") == "LLM_QUEUED", {"status": F.lit("ROUTED"), "queued_at": F.lit(None)})


def completed(posts: DataFrame, insights: DataFrame, at: str) -> DataFrame:
    """Posts that got an insight are completed."""
    return changed_if(posts, insights, F.lit(True), {"status": F.lit("COMPLETED"), "processed_at": F.expr(f"timestamp_ntz '{at}'"), "queued_at": F.lit(None)})


def abandoned(posts: DataFrame, ids: DataFrame, at: str, reason: str) -> DataFrame:
    return changed_if(posts, ids, F.lit(True), {"abandoned_at": F.expr(f"timestamp_ntz '{at}'"), "abandon_reason": F.lit(reason)})


def batches(rows: DataFrame, size: int = BATCH, most: int = BATCHES) -> DataFrame:
    """post_id, tag, batch (from 0): the rows of each tag in batches by post_id, the tags in order, unknown and missing ones (null) first; the first `most` batches."""
    known = F.when(F.col("tag").isin(TAGS), F.col("tag"))
    placed = numbered(rows.select("post_id", known.alias("tag")), "tag", [F.asc("post_id")], F.floor(F.col("post_id") / SPAN), "pos")
    counts = placed.groupBy("tag").agg(F.ceil(F.count("*") / size).alias("n"))
    before = Window.orderBy(F.asc_nulls_first("tag")).rowsBetween(Window.unboundedPreceding, -1)  # one row a known tag
    offsets = counts.select(F.col("tag").alias("t"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    found = placed.join(F.broadcast(offsets), F.col("tag").eqNullSafe(F.col("t")))
    return found.select("post_id", "tag", (F.col("before") + F.floor(F.col("pos") / size)).cast("int").alias("batch")).where(F.col("batch") < most)


def jobs(rows: DataFrame, eligible: DataFrame, newest: int = NEWEST, size: int = JOB) -> DataFrame:
    """tag, job, post_ids: the newest routed posts of each eligible tag, `size` a job."""
    place = Window.partitionBy("tag").orderBy(F.desc("posted_at"), F.desc("post_id"))
    ranked = rows.where("status = 'ROUTED'").join(F.broadcast(eligible.select("tag")), "tag").withColumn("r", F.row_number().over(place)).where(F.col("r") <= newest)
    parts = ranked.withColumn("job", F.floor((F.col("r") - 1) / size).cast("int"))
    return parts.groupBy("tag", "job").agg(F.array_sort(F.collect_list(F.struct("r", "post_id"))).alias("p")).select("tag", "job", F.transform("p", lambda x: x["post_id"]).alias("post_ids"))


# samples of tags

#: Days that samples come from, samples of a tag, times that many in its pool, the pool's bound, and how few need no supplement or no cache.
DAYS, PER_TAG, TIMES, POOL, ENOUGH, LEAST = 120, 200, 4, 5000, 100, 40
NEGATIVE = "__low_quality__"


def _pool(rows: DataFrame, each: Column) -> DataFrame:
    """The newest rows of each tag, TIMES each (of the column) and POOL at most."""
    return leading(rows, "tag", [F.desc("created_at"), F.desc("post_id")], POOL).where(F.col("r") <= TIMES * each).drop("r")


def _picked(pool: DataFrame, limits: dict[str, int], seed: int) -> DataFrame:
    """Rows of each tag, by stratum as quotas() says, chosen by hash."""
    from postloom.operators.reports import quotas

    sizes: dict[str, dict[str, int]] = {}
    for r in sorted(pool.groupBy("tag", "stratum").count().collect()):  # a few strata of each known tag
        sizes.setdefault(r["tag"], {})[r["stratum"]] = r["count"]
    want = [(tag, s, n) for tag, strata in sizes.items() for s, n in quotas(strata, min(limits.get(tag, 0), sum(strata.values()))).items() if n]
    quota = pool.sparkSession.createDataFrame(want, "tag string, stratum string, quota int")
    place = Window.partitionBy("tag", "stratum").orderBy(F.xxhash64("post_id", F.lit(seed)), "post_id")
    return pool.withColumn("r", F.row_number().over(place)).join(F.broadcast(quota), ["tag", "stratum"]).where("r <= quota").drop("r", "quota")


def tag_samples(insights: DataFrame, now: str, per_tag: int = PER_TAG, days: int = DAYS, seed: int = 17) -> DataFrame:
    """tag, post_id, late: posts to stand for each routing tag, of insights (post_id, created_at, importance, verdict, tags, stratum).

    From the newest of high importance that aren't to be ignored, per_tag are picked, spread over strata; where fewer than ENOUGH
    were found, those of importance 3 that aren't in that pool fill up (late).
    """
    since = F.expr(f"timestamp_ntz '{now}' - interval {days} days")
    alias = F.lit(None)
    for other, tag in ALIASES.items():
        alias = F.when(F.col("t") == other, tag).otherwise(alias)
    rows = insights.where((F.col("created_at") >= since) & (F.col("verdict") != "ignore") & (F.col("importance") >= 3))
    each = rows.select("post_id", "created_at", "importance", "stratum", F.explode("tags").alias("t")).withColumn("tag", F.coalesce(alias, F.col("t"))).where(F.col("tag").isin([t for t in TAGS if t != "other"])).drop("t").distinct()
    pool = _pool(each.where("importance >= 4"), F.lit(per_tag))
    first = _picked(pool, dict.fromkeys(TAGS, per_tag), seed)
    got = {r["tag"]: r["count"] for r in first.groupBy("tag").count().collect()}
    room = {t: per_tag - got.get(t, 0) for t in TAGS if got.get(t, 0) < min(ENOUGH, per_tag)}
    out = first.select("tag", "post_id", F.lit(False).alias("late"))
    if not room:
        return out
    left = each.where("importance = 3").join(F.broadcast(each.sparkSession.createDataFrame(list(room.items()), "tag string, room int")), "tag").join(pool.select("tag", "post_id"), ["tag", "post_id"], "left_anti")
    late = _picked(_pool(left, F.col("room")).drop("room"), room, seed)
    return out.unionByName(late.select("tag", "post_id", F.lit(True).alias("late")))


def negative_samples(insights: DataFrame, now: str, days: int = DAYS, limit: int = 300) -> DataFrame:
    """The newest posts to be ignored or of importance 1."""
    since = F.expr(f"timestamp_ntz '{now}' - interval {days} days")
    return insights.where((F.col("created_at") >= since) & ((F.col("verdict") == "ignore") | (F.col("importance") <= 1))).orderBy(F.desc("created_at"), F.desc("post_id")).limit(limit).select("post_id")


def sample_cache(chosen: DataFrame, vectors: DataFrame, size: int, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The cache (tag, sample_id, v) of tags that have `least` vectors of the size, and all tags' counts (tag, samples); negative samples count as none."""
    both = chosen.select("tag", F.col("post_id").alias("sample_id")).join(vectors.where(F.size("v") == size).select(F.col("post_id").alias("sample_id"), "v"), "sample_id")
    counts = both.groupBy("tag").agg(F.count("*").alias("samples"))
    spark = chosen.sparkSession
    names = spark.createDataFrame([(t,) for t in [*(t for t in TAGS if t != "other"), NEGATIVE]], "tag string")
    kept = both.join(F.broadcast(counts.where(F.col("samples") >= least).select("tag")), "tag")
    return kept.select("tag", "sample_id", "v"), names.join(counts, "tag", "left").select("tag", F.coalesce("samples", F.lit(0)).alias("samples"))


def total_samples(counts: DataFrame) -> DataFrame:
    """All samples but negative ones."""
    return counts.agg(F.coalesce(F.sum(F.when(F.col("tag") != NEGATIVE, F.col("samples"))), F.lit(0)).alias("samples"))


def refresh(cache: dict | None, model: str, dimensions: int, tag: str | None = None) -> str:
    """What a refresh of the cache does: full where there is none, or one of another model or size, or no tag is named; tag for a routing tag; unknown-tag for another."""
    if tag is not None:
        name = ALIASES.get(tag.strip().lower(), tag.strip().lower())
        if name not in TAGS or name == "other":
            return "unknown-tag"
    same = cache is not None and (cache["model"], cache["dimensions"]) == (model, dimensions)
    return "tag" if same and tag is not None else "full"


def preferred_tag(tags: Column, wanted: list[str] = (), known: list[str] = ()) -> Column:
    """The first tag that is wanted, else the first; other where that is no known tag."""
    names = filter_tags(F.coalesce(tags, F.array().cast("array<string>")))
    first = F.coalesce(F.get(F.filter(names, lambda t: t.isin(list(wanted))), F.lit(0)), F.get(names, F.lit(0))) if wanted else F.get(names, F.lit(0))
    return F.when(first.isin(list(known or TAGS)), first).otherwise("other")
