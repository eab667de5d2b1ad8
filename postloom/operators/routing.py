"""Routing: distributions of decisions, rules, nearest neighbours, dispatch."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom.functions.text import AMOUNT_UNIT, TIME_UNIT, collapse, has_ticker, number_tokens, strip, utf16_length
from postloom.operators.quantiles import floor_quantile_columns, interpolated
from postloom.operators.similarity import nearest_tags

#: Languages that carry no words.
LOW_LANGS = ["zxx", "und", "qme", "qst", "qam", "qct", "qht"]
#: What the rule router keeps a post for; a parameter, these are its defaults.
KEYWORDS = [
    "sec", "cftc", "fomc", "cpi", "pce", "etf", "blackrock", "grayscale", "announce", "announced", "launch", "launched", "release", "released", "partnership", "partner",
    "merge", "merger", "acquire", "acquires", "acquisition", "proposal", "vote", "approval", "rejection", "listing", "delist", "upgrade", "update", "patch",
    "监管", "合规", "加息", "降息", "利率", "稳定币", "hack", "exploit", "漏洞", "攻击", "被盗", "暂停", "修复", "融资", "funding", "round", "series", "估值", "并购", "回购", "buyback",
    "解锁", "unlock", "销毁", "burn", "主网", "mainnet", "升级", "hard fork", "testnet", "宣布", "发布", "上线", "下线", "合作", "伙伴", "合并", "提案", "投票", "通过", "否决", "下架", "更新", "修补",
]
#: Lengths in UTF-16 units below which a post is short, and from which it is kept.
SHORT, KEPT = 80, 120


def totals(posts: DataFrame) -> DataFrame:
    """All counts of states in one pass."""
    status = {"pending": "PENDING", "ignored": "IGNORED", "auto_high": "AUTO_HIGH", "routed": "ROUTED", "queued": "LLM_QUEUED", "completed": "COMPLETED"}
    low = (F.col("status") == "IGNORED") & F.col("reason").isin("embed-low", "embed-negative")
    llm = F.count_if(F.col("status").isin("ROUTED", "LLM_QUEUED", "COMPLETED")).alias("llm_total")
    return posts.agg(F.count("*").alias("total"), llm, *[F.count_if(F.col("status") == v).alias(k) for k, v in status.items()], F.count_if(low).alias("embed_low"), F.count_if((F.col("status") == "IGNORED") & ~F.coalesce(low, F.lit(False))).alias("ignored_other"))


def ratios(posts: DataFrame) -> DataFrame:
    """Shares of the totals, 0 where there are no posts."""
    found = totals(posts)
    return found.select("total", *[F.round(F.coalesce(F.try_divide(c, "total"), F.lit(0.0)), 6).alias(f"{c}_ratio") for c in found.columns if c != "total"])


def top_reasons(posts: DataFrame, status: str | None = None, limit: int = 5) -> DataFrame:
    """The reasons of most posts, of one status or all."""
    rows = posts if status is None else posts.where(F.col("status") == status)
    return rows.groupBy(F.coalesce("reason", F.lit("(null)")).alias("reason")).agg(F.count("*").alias("posts")).orderBy(F.desc("posts"), "reason").limit(limit)


def distribution(posts: DataFrame, key: str) -> DataFrame:
    """Counts and shares; nulls are (null)."""
    found = posts.groupBy(F.coalesce(F.col(key), F.lit("(null)")).alias(key)).agg(F.count("*").alias("posts"))
    return found.join(F.broadcast(found.agg(F.sum("posts").alias("total")))).select(key, "posts", F.round(F.col("posts") / F.col("total"), 6).alias("share"))


def score_summary(posts: DataFrame) -> DataFrame:
    found = posts.agg(F.count("score").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi"), F.avg("score").alias("avg"))
    both = found.crossJoin(interpolated(posts, "score", {f"p{p}": p / 100 for p in (50, 75, 90, 95, 99)}))  # one row each
    return both.select("n", *[F.round(c, 6).alias(c) for c in both.columns if c != "n"])


def histogram(posts: DataFrame, width: float = 0.02) -> DataFrame:
    """bucket, its bounds, posts and their share of the scored."""
    found = posts.where("score is not null").groupBy(F.floor(F.col("score") / F.lit(width)).cast("int").alias("bucket")).agg(F.count("*").alias("posts"))
    total = F.sum("posts").over(Window.partitionBy(F.lit(0)))  # as many rows as buckets
    return found.select("bucket", F.round(F.col("bucket") * width, 6).alias("lo"), F.round((F.col("bucket") + 1) * width, 6).alias("hi"), "posts", F.round(F.col("posts") / total, 6).alias("share"))


def tag_quantiles(posts: DataFrame) -> DataFrame:
    rows = posts.where("score is not null and tag is not null")
    found = rows.groupBy("tag").agg(F.count("*").alias("posts"), F.round(F.avg("score"), 6).alias("avg_score"))
    q = floor_quantile_columns(rows, "tag", "score", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return found.join(q, "tag").select("tag", "posts", "avg_score", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")])


def top_tags(posts: DataFrame, limit: int = 10) -> DataFrame:
    """Tags of most scored posts, with their average score."""
    found = posts.where("score is not null and tag is not null").groupBy("tag").agg(F.count("*").alias("posts"), F.round(F.avg("score"), 6).alias("avg_score"))
    return found.orderBy(F.desc("posts"), "tag").limit(limit)


def compared(posts: DataFrame, reason: str) -> DataFrame:
    """Posts and scores of those with the reason and of all others, null included."""
    group = F.when(F.col("reason").eqNullSafe(F.lit(reason)), "with").otherwise("without").alias("side")
    return posts.groupBy(group).agg(F.count("*").alias("posts"), F.count("score").alias("scored"), F.round(F.avg("score"), 6).alias("avg_score"), F.round(F.max("score"), 6).alias("hi"))


def dispatch_due(posts: DataFrame, now: str, least: int, wait_minutes: int) -> DataFrame:
    """Tags with enough routed posts, or whose oldest has waited long enough (0: never)."""
    found = posts.where("status = 'ROUTED'").groupBy("tag").agg(F.count("*").alias("posts"), F.min("posted_at").alias("oldest"))
    waited = F.lit(wait_minutes > 0) & (F.col("oldest") <= F.expr(f"timestamp_ntz '{now}' - interval {wait_minutes} minutes"))
    return found.where((F.col("posts") >= least) | waited).select("tag", "posts")


def rules(posts: DataFrame, keywords: list[str] = KEYWORDS) -> DataFrame:
    """post_id and the rule's outcome; a null text is empty.  Lengths are UTF-16 units; what is long is kept before any pattern is tried."""
    rows = posts.select("post_id", F.lower(strip(F.col("lang"))).alias("lang"), F.coalesce(collapse(F.col("text")), F.lit("")).alias("t"))
    rows = rows.withColumn("size", utf16_length(F.col("t")))
    key = F.lower("t").rlike("|".join(re.escape(k.lower()) for k in keywords)) if keywords else F.lit(False)
    amount, when, nums = F.col("t").rlike(AMOUNT_UNIT), F.col("t").rlike(TIME_UNIT), number_tokens(F.col("t"))
    keep = (F.col("size") >= KEPT) | key | (amount & when) | (has_ticker(F.col("t")) & (nums >= 2))
    bare = (F.col("size") < SHORT) & (nums <= 1) & ~amount & ~when
    return rows.select("post_id", F.when(keep, "rule-keep").when(F.coalesce(F.col("lang").isin(LOW_LANGS), F.lit(False)), "low-lang").when(bare, "low-info-short").otherwise("rule-drop").alias("outcome"))


def knn(posts: DataFrame, samples: DataFrame, low: float = 0.68, high: float = 0.86, margin: float = 0.04, strict: float = 0.9, thresholds: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """post_id, status, tag, score, margin, reason and importance.

    thresholds (tag, low, high, margin, strict) hold for their tags, the defaults for others.  Without a vector the post is
    analyzed as embed-missing, without a tag as embed-unrouted; without a second tag the margin is 0, so never high.
    """
    found = nearest_tags(posts, samples, order).withColumns({"lead": F.when(F.col("second") >= 0, F.col("score") - F.col("second"))})
    limits = {"low": low, "high": high, "margin": margin, "strict": strict}
    if thresholds is not None:  # one row a tag
        own = thresholds.select("tag", *[F.col(c).alias(f"t_{c}") for c in limits])
        found = found.join(F.broadcast(own), "tag", "left")
    at = {c: F.coalesce(F.col(f"t_{c}"), F.lit(v)) if thresholds is not None else F.lit(v) for c, v in limits.items()}
    missing, unrouted, ignored = ~F.col("known"), F.col("tag").isNull(), F.col("score") <= at["low"]
    sure = (F.col("score") >= at["high"]) & (F.coalesce("lead", F.lit(0.0)) >= at["margin"])
    importance = F.when(missing | unrouted | ignored, None).when(sure, F.when(F.col("score") >= at["strict"], 5).otherwise(4))
    reason = F.when(missing, "embed-missing").when(unrouted, "embed-unrouted").when(ignored, "embed-low").when(sure, "embed-high").otherwise("embed-analyze")
    status = F.when(missing | unrouted, "ROUTED").when(ignored, "IGNORED").when(sure, "AUTO_HIGH").otherwise("ROUTED")
    return found.select("post_id", status.alias("status"), "tag", F.round("score", 6).alias("score"), F.round("lead", 6).alias("margin"), reason.alias("reason"), importance.alias("importance"))
