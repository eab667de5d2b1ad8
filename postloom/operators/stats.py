"""Statistics of posts (post_id, account_id, lang, text, importance, verdict, tags, views)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom.functions.text import length_bucket, view_bucket
from postloom.operators.quantiles import interpolated

HIGH = 4


def _long(x: Column) -> Column:
    return F.coalesce(x, F.lit(0)).cast("long")


def _num(x: Column) -> Column:
    return F.round(x, 6)


def pearson(x: Column, y: Column) -> Column:
    """Correlation of the pairs without nulls; null for fewer than two or without variance."""
    x, y = (F.when(x.isNotNull() & y.isNotNull(), z.cast("double")) for z in (x, y))
    return F.when(F.count(x) >= 2, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def totals(posts: DataFrame, length: Column, high: int = HIGH) -> DataFrame:
    """Counts, averages, interpolated percentiles and the correlation of length and importance.

    Lengths are whole numbers below that of the longest text, so their percentiles' buffer is small; views may all
    differ, so theirs are taken by counts.
    """
    rows = posts.withColumn("len", length)
    views = interpolated(rows, "views", {"p90_views": 0.9}).select(_num(F.col("p90_views")).alias("p90_views"))
    found = rows.agg(
        F.count("*").alias("total"),
        F.count("importance").alias("scored"),
        F.count("views").alias("with_views"),
        F.count_if(F.col("importance") >= high).alias("high_score"),
        _num(F.avg("len")).alias("avg_length"),
        _num(F.percentile("len", F.lit(0.5))).alias("median_length"),
        _num(F.percentile("len", F.lit(0.9))).alias("p90_length"),
        _num(F.avg("views")).alias("avg_views"),
        _num(F.avg("importance")).alias("avg_importance"),
        _num(pearson(F.col("len"), F.col("importance"))).alias("length_importance_corr"),
    )
    return found.crossJoin(views)  # one row each


def by_bucket(posts: DataFrame, value: Column, bucket: Column, labels: list[str]) -> DataFrame:
    """Count and averages of every bucket, empty ones included."""
    names = posts.sparkSession.createDataFrame([(x,) for x in labels], "bucket string")
    found = posts.withColumn("len", F.length("text")).where(value.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg("len").alias("l"), F.avg("importance").alias("i"), F.avg("views").alias("v"))
    return names.join(found, "bucket", "left").select("bucket", _long(F.col("n")).alias("posts"), _num(F.col("l")).alias("avg_length"), _num(F.col("i")).alias("avg_importance"), _num(F.col("v")).alias("avg_views"))


def length_buckets(posts: DataFrame) -> DataFrame:
    return by_bucket(posts, F.length("text"), length_bucket(F.length("text")), ["0-40", "41-80", "81-140", "141-200", "201-260", "261+"])


def view_buckets(posts: DataFrame) -> DataFrame:
    return by_bucket(posts, F.col("views"), view_bucket(F.col("views")), ["0-1k", "1k-5k", "5k-10k", "10k+"])


def length_by_importance(posts: DataFrame) -> DataFrame:
    levels = posts.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("importance"))
    found = posts.withColumn("len", F.length("text")).groupBy("importance").agg(F.count("*").alias("n"), F.avg("len").alias("a"), F.min("len").alias("lo"), F.max("len").alias("hi"), F.percentile("len", F.lit(0.5)).alias("m"), F.percentile("len", F.lit(0.9)).alias("p"), F.avg("views").alias("v"))
    return levels.join(found, "importance", "left").select("importance", _long(F.col("n")).alias("posts"), _num(F.col("a")).alias("avg_length"), F.col("lo").cast("long").alias("min_length"), F.col("hi").cast("long").alias("max_length"), _num(F.col("m")).alias("median_length"), _num(F.col("p")).alias("p90_length"), _num(F.col("v")).alias("avg_views"))


def score_matrix(posts: DataFrame, bucket: Column) -> DataFrame:
    """Posts by importance and bucket."""
    return posts.where(F.col("importance").between(1, 5)).groupBy("importance", bucket.alias("bucket")).agg(F.count("*").alias("posts"))


def score_rows(posts: DataFrame, length: Column) -> DataFrame:
    """The matrix's rows: posts, averages of length and views for every importance, and each count's share of the largest."""
    levels = posts.sparkSession.range(1, 6).select(F.col("id").cast("int").alias("importance"))
    found = posts.where(F.col("importance").between(1, 5)).groupBy("importance").agg(F.count("*").alias("n"), F.avg(length).alias("l"), F.avg("views").alias("v"))
    rows = levels.join(found, "importance", "left").withColumn("posts", _long(F.col("n")))
    most = F.greatest(F.lit(1), F.max("posts").over(Window.partitionBy(F.lit(0))))  # five rows
    return rows.select("importance", "posts", _num(F.col("l")).alias("avg_length"), _num(F.col("v")).alias("avg_views"), _num(F.col("posts") / most).alias("scale"))


def verdicts(posts: DataFrame) -> DataFrame:
    return posts.where("verdict is not null").groupBy("verdict").agg(F.count("*").alias("posts"), _num(F.avg(F.length("text"))).alias("avg_length"), _num(F.avg("importance")).alias("avg_importance"), _num(F.avg("views")).alias("avg_views"))


def tags(posts: DataFrame, high: int = HIGH, limit: int = 12) -> DataFrame:
    """The `limit` tags of most posts; ties go to the tag that came first."""
    each = posts.select("post_id", "importance", F.explode("tags").alias("tag"))
    found = each.groupBy("tag").agg(F.count("*").alias("posts"), _num(F.avg("importance")).alias("avg_importance"), _num(F.try_divide(F.count_if(F.col("importance") >= high), F.count("importance"))).alias("high_ratio"), F.min("post_id").alias("first"))
    return found.orderBy(F.desc("posts"), "first", "tag").limit(limit).drop("first")


def high_shares(posts: DataFrame, key: Column, high: int = HIGH, limit: int | None = None) -> DataFrame:
    """Shares of the key's values among posts of high importance; null keys are unknown.  With a limit those of most posts, of equals the one seen first, by post_id."""
    top = posts.where(F.col("importance") >= high).groupBy(F.coalesce(key, F.lit("unknown")).alias("key")).agg(F.count("*").alias("posts"), F.min("post_id").alias("first"))
    total = top.agg(F.sum("posts").alias("total"))
    listed = top if limit is None else top.orderBy(F.desc("posts"), "first", "key").limit(limit)
    return listed.join(F.broadcast(total)).select("key", "posts", _num(F.col("posts") / F.col("total")).alias("share"))


def accounts(posts: DataFrame, known: DataFrame, high: int = HIGH) -> DataFrame:
    """Per account, without posts too: posts, scored, averages, ratio of high ones, posts a day."""
    days = F.datediff(F.max("posted_at"), F.min("posted_at")) + 1
    found = posts.groupBy("account_id").agg(F.count("*").alias("n"), F.count("importance").alias("s"), F.avg("importance").alias("a"), F.count_if(F.col("importance") >= high).alias("h"), (F.count("*") / F.greatest(F.lit(1), days)).alias("d"), F.min("posted_at").alias("first_at"), F.max("posted_at").alias("last_at"))
    return known.join(found, "account_id", "left").select("account_id", "first_at", "last_at", _long(F.col("n")).alias("posts"), _long(F.col("s")).alias("scored"), _num(F.col("a")).alias("avg_importance"), _long(F.col("h")).alias("high"), _num(F.try_divide("h", "s")).alias("high_ratio"), _num(F.col("d")).alias("per_day"))


def policy(stats: DataFrame, now: str, least_avg: float = 3.0, least_high: int = 6, ratio: float = 0.25, frozen_days: int = 14) -> DataFrame:
    """account_id, decision, desired, action of accounts (with status and created_at): those stay that have the average, number or share of high posts.

    Accounts without scored posts go; accounts younger than frozen_days keep their status.
    """
    keep = F.coalesce((F.col("scored") > 0) & ((F.col("avg_importance") >= least_avg) | (F.col("high") >= least_high) | (F.col("high_ratio") > ratio)), F.lit(False))
    young = F.col("created_at") >= F.expr(f"timestamp_ntz '{now}' - interval {frozen_days} days")
    want = F.when(F.coalesce(young, F.lit(False)), F.col("status")).otherwise(F.when(keep, "SUBSCRIBED").otherwise("UNSUBSCRIBED"))
    action = F.when(F.col("status").eqNullSafe(want), "none").when(want == "SUBSCRIBED", "resubscribe").otherwise("unsubscribe")
    return stats.select("account_id", F.when(keep, "keep").otherwise("drop").alias("decision"), want.alias("desired"), action.alias("action"))


def account_totals(accounts_: DataFrame) -> DataFrame:
    """Accounts in all and by status."""
    return accounts_.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "SUBSCRIBED").alias("subscribed"), F.count_if(F.col("status") == "UNSUBSCRIBED").alias("unsubscribed"))


def _bucketed(x: Column, none: str | None, edges: list[tuple[float, str]], last: str) -> Column:
    out = F.when(x.isNull(), none)
    for top, name in edges:
        out = out.when(x < top, name)
    return out.otherwise(last)


def account_buckets(found: DataFrame) -> DataFrame:
    """kind, bucket, accounts: accounts by average importance, number and share of high posts."""
    avg = _bucketed(F.col("avg_importance"), "none", [(2, "1.0-1.9"), (3, "2.0-2.9"), (4, "3.0-3.9"), (5, "4.0-4.9")], "5.0")
    high = _bucketed(F.col("high"), None, [(1, "0"), (3, "1-2"), (6, "3-5"), (11, "6-10")], "11+")
    ratio = _bucketed(F.col("high_ratio"), "none", [(0.1, "<10%"), (0.25, "<25%"), (0.5, "<50%"), (0.75, "<75%")], ">=75%")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), b.alias("bucket")) for k, b in (("avg", avg), ("high", high), ("ratio", ratio))])
    return found.select(F.inline(kinds)).groupBy("kind", "bucket").agg(F.count("*").alias("accounts"))


def account_kpis(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("accounts"), F.count_if(F.col("scored") > 0).alias("scored"), F.count_if(F.col("high") > 0).alias("with_high"), F.count_if(F.col("high_ratio") >= 0.5).alias("mostly_high"))


def leaders(found: DataFrame, by: str, top: int = 10) -> DataFrame:
    """The accounts that lead by a statistic; nulls take no part."""
    return found.where(F.col(by).isNotNull()).orderBy(F.desc(by), F.desc("scored"), "account_id").limit(top).select("account_id", "scored", by)


def high_totals(posts: DataFrame, high: int = HIGH) -> DataFrame:
    """Posts of high importance: number, share of the scored, lengths, views and their number, tags a post, shares with a summary and with suggestions."""
    is_high = F.col("importance") >= high
    size, tags_ = (F.when(is_high, x) for x in (F.length("text"), F.coalesce(F.size("tags"), F.lit(0))))
    said = {name: F.when(is_high, (F.coalesce(F.trim(name), F.lit("")) != "").cast("int")) for name in ("summary", "suggestions")}
    views = interpolated(posts.where(is_high), "views", {f"views_p{q}": q / 100 for q in (50, 90)})
    found = posts.agg(
        F.count_if(is_high).alias("posts"),
        _num(F.try_divide(F.count_if(is_high), F.count("importance"))).alias("ratio"),
        *[_num(F.percentile(size, F.lit(q / 100))).alias(f"length_p{q}") for q in (50, 90)],
        _num(F.avg(size)).alias("avg_length"),
        F.count_if(is_high & F.col("views").isNotNull()).alias("with_views"),
        _num(F.avg(F.when(is_high, F.col("views")))).alias("avg_views"),
        _num(F.avg(tags_)).alias("avg_tags"),
        *[_num(F.avg(x)).alias(f"{name}_rate") for name, x in said.items()],
    )
    return found.crossJoin(views.select(*[_num(F.col(c)).alias(c) for c in views.columns]))  # one row each


def high_tags(posts: DataFrame, high: int = HIGH, limit: int | None = None) -> DataFrame:
    """Tags of posts of high importance, with the share of those posts.  With a limit those of most posts, of equals the one seen first."""
    top = posts.where(F.col("importance") >= high)
    total = top.agg(F.count("*").alias("total"))
    found = top.select("post_id", F.posexplode("tags").alias("pos", "tag")).groupBy("tag").agg(F.count("*").alias("posts"), F.min(F.struct("post_id", "pos")).alias("first"))
    listed = found if limit is None else found.orderBy(F.desc("posts"), "first").limit(limit)
    return listed.join(F.broadcast(total)).select("tag", "posts", _num(F.col("posts") / F.col("total")).alias("share"))
