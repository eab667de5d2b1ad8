"""Queries of the classification flow: decisions, what is written back, batches, jobs, samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import text
from postloom.operators import classification, jobs, merge, routing, scoring, similarity
from postloom.sources.tables import POSTS_DOCS, ROUTED, UNITS, posts_docs, routed, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_AT = "2024-02-01 00:00:00"
_LIMITS = {"low": 0.32, "high": 0.38, "margin": 0.01, "strict": 0.42}


def _flow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Posts, some with words so few that the rules drop them, and the decisions over the newest 1,000."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.format_string("%02d", "label").alias("tag"), F.col("embedding").cast("array<double>").alias("v"))
    samples = similarity.recent(v, "vec_id").select("tag", "v", F.col("vec_id").alias("sample_id"))
    posts = posts_docs(spark, sf_dir).withColumn("text", F.when(F.col("post_id") % 6 == 1, F.concat(F.lit("up "), F.col("post_id").cast("string"))).when(F.col("post_id") % 6 == 2, "3 sol in 2 minutes").when(F.col("post_id") % 6 == 3, "mm 5%").otherwise(F.col("text"))).withColumn("lang", F.when(F.col("post_id") % 12 == 1, " ZXX ").otherwise(F.col("lang")))
    return posts, classification.decide(posts, v.select(F.col("vec_id").alias("post_id"), "v"), samples, **_LIMITS)


_FLOW = rf"""WITH {POSTS_DOCS}, {UNITS},
s AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY tag ORDER BY vec_id DESC) <= 200),
f AS (SELECT * REPLACE (CASE post_id % 6 WHEN 1 THEN 'up ' || post_id WHEN 2 THEN '3 sol in 2 minutes' WHEN 3 THEN 'mm 5%' ELSE text END AS text, CASE WHEN post_id % 12 = 1 THEN ' ZXX ' ELSE lang END AS lang) FROM posts),
n AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM f ORDER BY posted_at DESC, post_id DESC LIMIT 1000),
g AS (SELECT *, len(regexp_extract_all(t, '[0-9]+(?:[.,][0-9]+)?%?')) AS nums, regexp_matches(t, '(?i)%|\b(usd|usdt|usdc|btc|eth|bnb|sol|m|b|k)\b|美元|美金|亿|万') AS amount, regexp_matches(t, '(?i)\b(sec|second|minute|min|hour|day|week|month|year)s?\b|分钟|小时|天|周|月|年|UTC|GMT') AS timed FROM n),
o AS (SELECT post_id, t, CASE WHEN len(list_filter({routing.KEYWORDS}, lambda k: contains(lower(t), k))) > 0 OR length(t) >= 120 OR (amount AND timed) OR (regexp_matches(t, '(?i)\$[a-z]{{2,6}}\b') AND nums >= 2) THEN 'rule-keep'
  WHEN coalesce(lower(trim(lang)) = 'zxx', false) THEN 'low-lang' WHEN length(t) < 80 AND nums <= 1 AND NOT amount AND NOT timed THEN 'low-info-short' ELSE 'rule-drop' END AS outcome FROM g),
b AS (SELECT o.post_id, s.tag, max(list_inner_product(p.v, s.v)) AS score FROM o JOIN v p ON p.vec_id = o.post_id JOIN s ON p.vec_id <> s.vec_id WHERE outcome = 'rule-keep' GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM b WINDOW w AS (PARTITION BY post_id ORDER BY score DESC, tag)),
m AS (SELECT *, CASE WHEN second >= 0 THEN score - second END AS margin, score > 0.32 AND score >= 0.38 AND coalesce(margin, 0) >= 0.01 AS sure FROM r WHERE r = 1),
d AS (SELECT post_id, 'IGNORED' AS status, NULL AS tag, NULL::DOUBLE AS score, NULL::DOUBLE AS margin, outcome AS reason, NULL::INT AS importance FROM o WHERE outcome <> 'rule-keep'
  UNION ALL SELECT o.post_id, CASE WHEN score <= 0.32 THEN 'IGNORED' WHEN sure THEN 'AUTO_HIGH' ELSE 'ROUTED' END, m.tag, round(score, 6), round(margin, 6), CASE WHEN score IS NULL THEN 'embed-missing' WHEN score <= 0.32 THEN 'embed-low' WHEN sure THEN 'embed-high' ELSE 'embed-analyze' END,
    CASE WHEN sure THEN CASE WHEN score >= 0.42 THEN 5 ELSE 4 END END FROM o LEFT JOIN m USING (post_id) WHERE outcome = 'rule-keep')"""
QUERIES["classify_flow"] = lambda spark, sf_dir: _flow(spark, sf_dir)[1].withColumn("importance", F.col("importance").cast("double"))
SQL["classify_flow"] = f"{_FLOW} SELECT * REPLACE (importance::DOUBLE AS importance) FROM d"
QUERIES["reason_counts"] = lambda spark, sf_dir: classification.reason_counts(_flow(spark, sf_dir)[1])
SQL["reason_counts"] = f"{_FLOW} SELECT reason, count(*) AS posts FROM (SELECT CASE WHEN reason = 'embed-high' THEN 'embed-high-' || importance ELSE reason END AS reason FROM d UNION ALL SELECT 'rule-keep' FROM d WHERE reason LIKE 'embed-%') GROUP BY reason"
QUERIES["auto_insights"] = lambda spark, sf_dir: classification.auto_insights(*_flow(spark, sf_dir)).select("post_id", "verdict", "importance", F.get("tags", F.lit(0)).alias("tag"), F.sha2("summary", 256).alias("summary"))
SQL["auto_insights"] = f"{_FLOW} SELECT post_id, CASE WHEN status = 'AUTO_HIGH' THEN 'watch' ELSE 'ignore' END AS verdict, coalesce(importance, 1)::INT AS importance, CASE WHEN status = 'AUTO_HIGH' THEN tag ELSE 'other' END AS tag, sha256(CASE WHEN length(t) <= 120 THEN t ELSE t[:119] || '…' END) AS summary FROM d JOIN o USING (post_id) WHERE status <> 'ROUTED'"


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed posts with the times and reasons that the flow writes."""
    rows = routed(spark, sf_dir).withColumns({"margin": F.lit(0.5), "routed_at": F.col("posted_at"), "processed_at": F.when(F.col("status") == "COMPLETED", F.col("posted_at")), "queued_at": F.when(F.col("post_id") % 4 == 0, F.col("posted_at"))})
    return rows.withColumns({"abandoned_at": F.lit(None).cast("timestamp_ntz"), "abandon_reason": F.lit(None).cast("string")})


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routed(spark, sf_dir).where("status = 'PENDING'").selectExpr("post_id", "CASE post_id % 3 WHEN 0 THEN 'IGNORED' WHEN 1 THEN 'AUTO_HIGH' ELSE 'ROUTED' END AS status", "'macro' AS tag", "0.25D AS score", "CAST(NULL AS double) AS margin", "'x' AS reason", "4 AS importance")


_TIMES = "coalesce(strftime(routed_at, '%m-%d %H:%M:%S'), '-') AS routed_at, coalesce(strftime(processed_at, '%m-%d %H:%M:%S'), '-') AS processed_at, coalesce(strftime(queued_at, '%m-%d %H:%M:%S'), '-') AS queued_at"
_STATES = f"WITH {ROUTED}, o AS (SELECT *, 0.5 AS margin, posted_at AS routed_at, CASE WHEN status = 'COMPLETED' THEN posted_at END AS processed_at, CASE WHEN post_id % 4 = 0 THEN posted_at END AS queued_at FROM posts)"


def _shown(df: DataFrame) -> DataFrame:
    """Times as text, missing ones as a dash."""
    return df.withColumns({c: F.coalesce(F.date_format(c, "MM-dd HH:mm:ss"), F.lit("-")) for c in ("routed_at", "processed_at", "queued_at")})


QUERIES["persist_routing"] = lambda spark, sf_dir: _shown(classification.routed(_states(spark, sf_dir), _decided(spark, sf_dir), _AT)).select("post_id", "status", "reason", "routed_at", "processed_at", "queued_at")
SQL["persist_routing"] = f"""{_STATES}, n AS (SELECT * REPLACE (CASE WHEN status = 'PENDING' THEN TIMESTAMP '{_AT}' ELSE routed_at END AS routed_at, CASE WHEN status = 'PENDING' AND post_id % 3 < 2 THEN TIMESTAMP '{_AT}' ELSE processed_at END AS processed_at, CASE WHEN status <> 'PENDING' THEN queued_at END AS queued_at,
  CASE WHEN status = 'PENDING' THEN 'x' ELSE reason END AS reason, CASE WHEN status <> 'PENDING' THEN status WHEN post_id % 3 = 0 THEN 'IGNORED' WHEN post_id % 3 = 1 THEN 'AUTO_HIGH' ELSE 'ROUTED' END AS status) FROM o) SELECT post_id, status, reason, {_TIMES} FROM n"""
QUERIES["queue_posts"] = lambda spark, sf_dir: _shown(classification.queued(_states(spark, sf_dir), routed(spark, sf_dir).where("post_id % 2 = 0").select("post_id"), _AT)).select("post_id", "status", "queued_at")
SQL["queue_posts"] = f"""{_STATES}, n AS (SELECT post_id, routed_at, processed_at, status = 'ROUTED' AND queued_at IS NULL AND post_id % 2 = 0 AS go, CASE WHEN go THEN 'LLM_QUEUED' ELSE status END AS status, CASE WHEN go THEN TIMESTAMP '{_AT}' ELSE queued_at END AS queued_at FROM o)
SELECT post_id, status, coalesce(strftime(queued_at, '%m-%d %H:%M:%S'), '-') AS queued_at FROM n"""
QUERIES["put_back_posts"] = lambda spark, sf_dir: _shown(classification.put_back(_states(spark, sf_dir), routed(spark, sf_dir).where("post_id % 3 <> 0").select("post_id"))).select("post_id", "status", "queued_at")
SQL["put_back_posts"] = f"""{_STATES}, n AS (SELECT post_id, status = 'LLM_QUEUED' AND post_id % 3 <> 0 AS back, CASE WHEN back THEN 'ROUTED' ELSE status END AS status, CASE WHEN back THEN NULL ELSE queued_at END AS queued_at FROM o)
SELECT post_id, status, coalesce(strftime(queued_at, '%m-%d %H:%M:%S'), '-') AS queued_at FROM n"""
QUERIES["complete_posts"] = lambda spark, sf_dir: _shown(classification.completed(_states(spark, sf_dir), routed(spark, sf_dir).where("status = 'ROUTED' AND post_id % 4 = 0").select("post_id"), _AT)).select("post_id", "status", "processed_at", "queued_at")
SQL["complete_posts"] = f"""{_STATES}, n AS (SELECT post_id, status = 'ROUTED' AND post_id % 4 = 0 AS go, CASE WHEN go THEN 'COMPLETED' ELSE status END AS status, CASE WHEN go THEN TIMESTAMP '{_AT}' ELSE processed_at END AS processed_at, CASE WHEN NOT go THEN queued_at END AS queued_at FROM o)
SELECT post_id, status, coalesce(strftime(processed_at, '%m-%d %H:%M:%S'), '-') AS processed_at, coalesce(strftime(queued_at, '%m-%d %H:%M:%S'), '-') AS queued_at FROM n"""
QUERIES["abandon_posts"] = lambda spark, sf_dir: classification.abandoned(_states(spark, sf_dir), routed(spark, sf_dir).where("status = 'ROUTED' AND post_id % 10 = 0").select("post_id"), _AT, "content-risk").select("post_id", F.coalesce("abandon_reason", F.lit("-")).alias("abandon_reason"), F.col("abandoned_at").isNotNull().alias("gone"))
SQL["abandon_posts"] = f"WITH {ROUTED} SELECT post_id, CASE WHEN gone THEN 'content-risk' ELSE '-' END AS abandon_reason, gone FROM (SELECT post_id, status = 'ROUTED' AND post_id % 10 = 0 AS gone FROM posts)"
QUERIES["llm_batches"] = lambda spark, sf_dir: classification.batches(routed(spark, sf_dir).select("post_id", F.when(F.col("tag") == "macro", "zzz").otherwise(F.col("tag")).alias("tag"))).withColumn("tag", F.coalesce("tag", F.lit("-")))
SQL["llm_batches"] = f"""WITH {ROUTED}, p AS (SELECT post_id, CASE WHEN tag = 'macro' THEN NULL ELSE tag END AS tag FROM posts), c AS (SELECT post_id, tag, (row_number() OVER (PARTITION BY tag ORDER BY post_id) - 1) // 10 AS k FROM p),
b AS (SELECT tag, k, row_number() OVER (ORDER BY tag NULLS FIRST, k) - 1 AS batch FROM (SELECT DISTINCT tag, k FROM c)) SELECT post_id, coalesce(c.tag, '-') AS tag, batch::INT AS batch FROM c JOIN b ON b.k = c.k AND b.tag IS NOT DISTINCT FROM c.tag WHERE batch < 100"""
QUERIES["dispatch_jobs"] = lambda spark, sf_dir: classification.jobs(routed(spark, sf_dir), routing.dispatch_due(routed(spark, sf_dir), "2024-01-20 00:00:00", 10, 0)).select("tag", "job", F.size("post_ids").alias("posts"), F.get("post_ids", F.lit(0)).alias("first"))
SQL["dispatch_jobs"] = f"""WITH {ROUTED}, r AS (SELECT tag, post_id, row_number() OVER (PARTITION BY tag ORDER BY posted_at DESC, post_id DESC) AS r FROM posts WHERE status = 'ROUTED' AND tag IN (SELECT tag FROM posts WHERE status = 'ROUTED' GROUP BY tag HAVING count(*) >= 10))
SELECT tag, ((r - 1) // 50)::INT AS job, count(*)::INT AS posts, arg_min(post_id, r) AS first FROM r WHERE r <= 1000 GROUP BY ALL"""
QUERIES["verdict_distribution"] = lambda spark, sf_dir: posts_docs(spark, sf_dir).where("verdict is not null").join(routed(spark, sf_dir).where("status <> 'PENDING'").select("post_id"), "post_id").groupBy("verdict").agg(F.count("*").alias("posts"))
SQL["verdict_distribution"] = f"WITH {POSTS_DOCS}, r AS ({ROUTED.split('AS (', 1)[1][:-1]}) SELECT verdict, count(*) AS posts FROM posts JOIN r USING (post_id) WHERE verdict IS NOT NULL AND r.status <> 'PENDING' GROUP BY verdict"
QUERIES["routing_ratios"] = lambda spark, sf_dir: routing.ratios(routed(spark, sf_dir))
_COUNTS = {"llm_total": "status IN ('ROUTED', 'LLM_QUEUED', 'COMPLETED')", "pending": "status = 'PENDING'", "ignored": "status = 'IGNORED'", "auto_high": "status = 'AUTO_HIGH'", "routed": "status = 'ROUTED'", "queued": "status = 'LLM_QUEUED'", "completed": "status = 'COMPLETED'", "embed_low": "status = 'IGNORED' AND reason IN ('embed-low', 'embed-negative')", "ignored_other": "status = 'IGNORED' AND (reason IS NULL OR reason NOT IN ('embed-low', 'embed-negative'))"}
SQL["routing_ratios"] = f"WITH {ROUTED} SELECT count(*) AS total, " + ", ".join(f"round(count(*) FILTER (WHERE {w}) / count(*), 6) AS {k}_ratio" for k, w in _COUNTS.items()) + " FROM posts"
QUERIES["top_reasons"] = lambda spark, sf_dir: routing.top_reasons(routed(spark, sf_dir), "IGNORED", 3)
SQL["top_reasons"] = f"WITH {ROUTED} SELECT coalesce(reason, '(null)') AS reason, count(*) AS posts FROM posts WHERE status = 'IGNORED' GROUP BY 1 ORDER BY posts DESC, reason LIMIT 3"


def _insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts_docs(spark, sf_dir).where("importance is not null").select("post_id", F.col("posted_at").alias("created_at"), "importance", "verdict", F.transform("tags", lambda t: F.when(t == "macro", "market").otherwise(t)).alias("tags"), F.concat_ws(":", text.lang_group(F.col("lang")), text.size_group(F.col("text"))).alias("stratum"))


QUERIES["tag_samples"] = lambda spark, sf_dir: classification.tag_samples(_insights(spark, sf_dir), "2024-03-01 00:00:00", per_tag=30)
QUERIES["negative_samples"] = lambda spark, sf_dir: classification.negative_samples(_insights(spark, sf_dir), "2024-03-01 00:00:00")
SQL["negative_samples"] = f"WITH {POSTS_DOCS} SELECT post_id FROM posts WHERE importance IS NOT NULL AND posted_at >= TIMESTAMP '2024-03-01 00:00:00' - INTERVAL 120 DAY AND (verdict = 'ignore' OR importance <= 1) ORDER BY posted_at DESC, post_id DESC LIMIT 300"


def _cache(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chosen = table(spark, sf_dir, "embeddings").select(F.element_at(F.lit([t for t in text.TAGS if t != "other"]), F.col("label") % 12 + 1).alias("tag"), F.col("vec_id").alias("post_id"))
    v = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS post_id", "CASE WHEN vec_id % 5 = 0 THEN slice(embedding, 1, 10) ELSE embedding END AS v")
    return classification.sample_cache(chosen, v, 64)


_CACHE = "WITH t AS (SELECT unnest(['macro', 'policy', 'security', 'funding', 'yield', 'token', 'airdrop', 'trading', 'onchain', 'tech', 'exchange', 'narrative', '__low_quality__']) AS tag), c AS (SELECT (['macro', 'policy', 'security', 'funding', 'yield', 'token', 'airdrop', 'trading', 'onchain', 'tech', 'exchange', 'narrative'])[label % 12 + 1] AS tag, vec_id FROM embeddings WHERE vec_id % 5 <> 0)"
QUERIES["sample_counts"] = lambda spark, sf_dir: _cache(spark, sf_dir)[1]
SQL["sample_counts"] = f"{_CACHE} SELECT t.tag, count(c.vec_id) AS samples FROM t LEFT JOIN c USING (tag) GROUP BY t.tag"
QUERIES["sample_cache"] = lambda spark, sf_dir: _cache(spark, sf_dir)[0].select("tag", "sample_id")
SQL["sample_cache"] = f"{_CACHE} SELECT tag, vec_id AS sample_id FROM c WHERE tag IN (SELECT tag FROM c GROUP BY tag HAVING count(*) >= 40)"
QUERIES["sample_total"] = lambda spark, sf_dir: classification.total_samples(_cache(spark, sf_dir)[1])
SQL["sample_total"] = f"{_CACHE} SELECT count(*) AS samples FROM c"

# writes
QUERIES["upsert_columns"] = lambda spark, sf_dir: merge.upsert_columns(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").selectExpr("CASE WHEN o_orderkey % 10 = 0 THEN -1 - o_orderkey ELSE o_orderkey END AS o_orderkey", "-1L AS o_custkey", "o_totalprice + 1 AS o_totalprice"), "o_orderkey", ["o_totalprice"])
SQL["upsert_columns"] = "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 5 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT -1 - o_orderkey, -1, o_totalprice + 1 FROM orders WHERE o_orderkey % 10 = 0"
QUERIES["delete_keys"] = lambda spark, sf_dir: merge.without(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")))
SQL["delete_keys"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)"
QUERIES["write_summary"] = lambda spark, sf_dir: merge.write_summary(table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 9 > 0, F.col("o_custkey")).alias("k")), "k")
SQL["write_summary"] = "WITH n AS (SELECT CASE WHEN o_orderkey % 9 > 0 THEN o_custkey END AS k FROM orders), o AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal < 0) SELECT count(*)::BIGINT AS given, count(*) FILTER (WHERE k IS NULL)::BIGINT AS skipped, count(DISTINCT k) FILTER (WHERE k NOT IN (SELECT k FROM o)) AS created, count(DISTINCT k) FILTER (WHERE k IN (SELECT k FROM o)) AS existing FROM n"


# queues
_QUEUE = "SELECT event_id AS job_id, event_type AS kind, cast(user_id AS varchar(20)) AS payload, CASE event_id % 4 WHEN 0 THEN 'RUNNING' WHEN 1 THEN 'COMPLETED' ELSE 'PENDING' END AS status, cast(event_id % 3 AS int) AS attempts, 2 AS max_attempts, ts AS scheduled_at, CASE WHEN event_id % 4 = 0 THEN 'w' END AS locked_by FROM "


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_QUEUE + "{events}", events=table(spark, sf_dir, "events"))


_NOW = "2024-01-20 00:00:00"
QUERIES["queue_enqueue"] = lambda spark, sf_dir: jobs.enqueued(_queue(spark, sf_dir), _queue(spark, sf_dir).select("kind", F.concat("payload", F.when(F.col("job_id") % 5 == 0, "x").otherwise("")).alias("payload")))
SQL["queue_enqueue"] = f"WITH q AS ({_QUEUE}events) SELECT DISTINCT kind, payload || CASE WHEN job_id % 5 = 0 THEN 'x' ELSE '' END AS payload FROM q EXCEPT SELECT kind, payload FROM q WHERE status IN ('PENDING', 'RUNNING')"
QUERIES["queue_reserve"] = lambda spark, sf_dir: jobs.reserved(_queue(spark, sf_dir), _NOW, "me", 25).select("job_id", "status", "attempts", F.coalesce("locked_by", F.lit("-")).alias("locked_by"))
SQL["queue_reserve"] = f"WITH q AS ({_QUEUE}events), t AS (SELECT job_id FROM q WHERE status = 'PENDING' AND scheduled_at <= TIMESTAMP '{_NOW}' ORDER BY scheduled_at, job_id LIMIT 25) SELECT job_id, CASE WHEN g THEN 'RUNNING' ELSE status END AS status, (attempts + g::INT)::INT AS attempts, CASE WHEN g THEN 'me' ELSE coalesce(locked_by, '-') END AS locked_by FROM (SELECT *, job_id IN (SELECT job_id FROM t) AS g FROM q)"
_RESULT = "CASE job_id % 12 WHEN 0 THEN 'done' WHEN 4 THEN 'failed' WHEN 8 THEN 'put-back' END"
QUERIES["queue_settle"] = lambda spark, sf_dir: jobs.settled(_queue(spark, sf_dir), _queue(spark, sf_dir).selectExpr("job_id", f"{_RESULT} AS result").where("result is not null"), _NOW).select("job_id", "status", "attempts", F.date_format("scheduled_at", "MM-dd HH:mm:ss").alias("scheduled_at"))
SQL["queue_settle"] = f"""WITH q AS ({_QUEUE}events), r AS (SELECT *, CASE WHEN status = 'RUNNING' THEN {_RESULT} END AS result FROM q), s AS (SELECT *, result = 'put-back' OR (result = 'failed' AND attempts < 2) AS again FROM r)
SELECT job_id, CASE WHEN result IS NULL THEN status WHEN result = 'done' THEN 'COMPLETED' WHEN again THEN 'PENDING' ELSE 'FAILED' END AS status, CASE WHEN result = 'put-back' THEN greatest(0, attempts - 1) ELSE attempts END::INT AS attempts, strftime(CASE WHEN coalesce(again, false) THEN TIMESTAMP '{_NOW}' + INTERVAL 5 SECOND ELSE scheduled_at END, '%m-%d %H:%M:%S') AS scheduled_at FROM s"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.format_string("%02d", "label").alias("tag"), F.col("embedding").cast("array<double>").alias("v"))
    return v.select(F.col("vec_id").alias("post_id"), "v"), similarity.recent(v, "vec_id").select("tag", "v", F.col("vec_id").alias("sample_id")), v.where("tag = '00'").select("v")


_SIMS = f"WITH {UNITS}, s AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY tag ORDER BY vec_id DESC) <= 200), r AS (SELECT p.vec_id, s.tag, list_inner_product(p.v, s.v) AS x, row_number() OVER (PARTITION BY p.vec_id, s.tag ORDER BY x DESC) AS i FROM v p JOIN s ON p.vec_id <> s.vec_id)"
QUERIES["sim_buckets"] = lambda spark, sf_dir: similarity.buckets(*_vectors(spark, sf_dir)[:2], [1, 3])
SQL["sim_buckets"] = f"{_SIMS}, b AS (SELECT k, vec_id, max(x) AS score FROM (SELECT k, vec_id, tag, avg(x) AS x FROM r, (SELECT unnest([1, 3]) AS k) WHERE i <= k GROUP BY ALL) GROUP BY ALL) SELECT k, floor(score / 0.02::DOUBLE)::INT AS bucket, count(*) AS posts FROM b GROUP BY ALL"
QUERIES["negative_stats"] = lambda spark, sf_dir: (lambda df: df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes]))(similarity.negative_stats(*_vectors(spark, sf_dir)))
SQL["negative_stats"] = f"""{_SIMS}, n AS (SELECT i, sum(v[i] / sqrt(list_inner_product(v, v))) AS x FROM v, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) WHERE tag = '00' GROUP BY i), c AS (SELECT list(x ORDER BY i) AS c FROM n),
b AS (SELECT vec_id, max(x) AS score FROM r GROUP BY vec_id), d AS (SELECT score, list_inner_product(v, c) / sqrt(list_inner_product(v, v) * list_inner_product(c, c)) AS near FROM b JOIN v USING (vec_id), c)
SELECT count(*) AS posts, round(avg(1 - near), 6) AS distance, round(max(near), 6) AS nearest, round(avg(score - near), 6) AS gap, round(min(score - near), 6) AS least_gap FROM d"""
QUERIES["gap_quantiles"] = lambda spark, sf_dir: (lambda df: df.select(*[F.round(c, 6).alias(c) if t == "double" else c for c, t in df.dtypes]))(similarity.gap_quantiles(*_vectors(spark, sf_dir), [1, 3, 5], {"p10": 0.1, "p50": 0.5, "p90": 0.9}))
SQL["gap_quantiles"] = f"""{_SIMS}, n AS (SELECT i, sum(v[i]) AS x FROM v, LATERAL (SELECT unnest(range(1, len(v) + 1)) AS i) WHERE tag = '00' GROUP BY i), c AS (SELECT list(x ORDER BY i) AS c FROM n),
b AS (SELECT k, vec_id, max(x) AS score FROM (SELECT k, vec_id, tag, avg(x) AS x FROM r, (SELECT unnest([1, 3, 5]) AS k) WHERE i <= k GROUP BY ALL) GROUP BY ALL),
d AS (SELECT k, score, list_inner_product(v, c) / sqrt(list_inner_product(c, c)) AS near FROM b JOIN v USING (vec_id), c),
m AS (SELECT k, 'score' AS measure, score AS x FROM d UNION ALL SELECT k, 'distance', 1 - near FROM d UNION ALL SELECT k, 'gap', score - near FROM d)
SELECT k::INT AS k, measure, count(*) AS posts, round(avg(x), 6) AS mean, {", ".join(f"round(list_sort(list(x))[1 + floor((count(*) - 1) * {q / 100})::INT], 6) AS p{q}" for q in (10, 50, 90))} FROM m GROUP BY ALL"""
QUERIES["random_sample"] = lambda spark, sf_dir: merge.sampled(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", 100)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routed posts with their texts, scored in batches by a model without a network that leaves out and refuses some."""
    posts = routed(spark, sf_dir).where("status = 'ROUTED'").select("post_id", "tag")
    plan = classification.batches(posts, most=1 << 30)
    texts = posts_docs(spark, sf_dir).select("post_id", "text")
    return scoring.scored(plan.join(texts, "post_id"), scoring.LengthModel(11, 37), pause=0.0)


_SCORED = f"""WITH {POSTS_DOCS}, r AS ({ROUTED.split('AS (', 1)[1][:-1]}), s AS (SELECT p.post_id, text, CASE WHEN p.post_id % 37 = 0 THEN 'abandoned' WHEN p.post_id % 11 = 0 THEN 'filled' ELSE 'scored' END AS outcome FROM posts p JOIN r USING (post_id) WHERE r.status = 'ROUTED')"""
QUERIES["model_scores"] = lambda spark, sf_dir: _scored(spark, sf_dir).select("post_id", "outcome", F.coalesce("reason", F.lit("-")).alias("reason"), F.coalesce("importance", F.lit(0.0)).alias("importance"))
SQL["model_scores"] = f"{_SCORED} SELECT post_id, outcome, CASE outcome WHEN 'abandoned' THEN 'content-risk' ELSE '-' END AS reason, (CASE outcome WHEN 'scored' THEN 1 + length(coalesce(text, '')) % 5 ELSE 0 END)::DOUBLE AS importance FROM s"
QUERIES["model_insights"] = lambda spark, sf_dir: scoring.insights(_scored(spark, sf_dir)).select("post_id", "verdict", "importance", F.length("summary").alias("size"))
SQL["model_insights"] = rf"""{_SCORED} SELECT post_id, 'watch' AS verdict, (CASE outcome WHEN 'scored' THEN 1 + length(coalesce(text, '')) % 5 ELSE 2 END)::INT AS importance, least(120, length(trim(regexp_replace(text, '\s+', ' ', 'g'))))::INT AS size FROM s WHERE outcome <> 'abandoned'"""
