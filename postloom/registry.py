"""All queries of the analytics library, and their SQL for the tables as views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions import text
from postloom.functions.text import length_bucket, view_bucket
from postloom.operators import delivery, evaluation, jobs, merge, outlines, reports, routing, search, similarity, stats
from postloom.plans import classify, reporting, selection
from postloom.sources.tables import POSTS_DOCS, POSTS_ORDERS, ROUTED, UNITS, posts_docs, posts_orders, routed, table, texts
from postloom.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _over(source, name: str, fn: Callable[[DataFrame], DataFrame], sql: str) -> None:
    cte = {posts_docs: POSTS_DOCS, texts: POSTS_DOCS, posts_orders: POSTS_ORDERS, routed: ROUTED}[source]
    QUERIES[name] = lambda spark, sf_dir: fn(source(spark, sf_dir))
    SQL[name] = f"WITH {cte} {sql}"


_CORR = """round(CASE WHEN count(l) >= 2 AND stddev_pop(l) * stddev_pop(i) > 0 THEN corr(l, i) END, 6)"""


def _totals_sql(length: str) -> str:
    return f"""SELECT count(*) AS total, count(importance) AS scored, count(views) AS with_views, count(*) FILTER (WHERE importance >= 4) AS high_score,
  round(avg(len), 6) AS avg_length, round(quantile_cont(len::DOUBLE, 0.5), 6) AS median_length, round(quantile_cont(len::DOUBLE, 0.9), 6) AS p90_length,
  round(avg(views), 6) AS avg_views, round(quantile_cont(views, 0.9), 6) AS p90_views, round(avg(importance), 6) AS avg_importance, {_CORR} AS length_importance_corr
FROM (SELECT *, {length} AS len, CASE WHEN importance IS NOT NULL THEN ({length})::DOUBLE END AS l, importance::DOUBLE AS i FROM posts)"""


_LEN = "CASE WHEN length(text) <= 40 THEN '0-40' WHEN length(text) <= 80 THEN '41-80' WHEN length(text) <= 140 THEN '81-140' WHEN length(text) <= 200 THEN '141-200' WHEN length(text) <= 260 THEN '201-260' ELSE '261+' END"
_VIEW = "CASE WHEN views BETWEEN 0 AND 999 THEN '0-1k' WHEN views BETWEEN 1000 AND 4999 THEN '1k-5k' WHEN views BETWEEN 5000 AND 9999 THEN '5k-10k' ELSE '10k+' END"


def _bucket_sql(labels: str, bucket: str, where: str) -> str:
    return f"""SELECT b.bucket, count(p.post_id) AS posts, round(avg(length(p.text)), 6) AS avg_length, round(avg(p.importance), 6) AS avg_importance, round(avg(p.views), 6) AS avg_views
FROM (SELECT unnest([{labels}]) AS bucket) b LEFT JOIN (SELECT *, {bucket} AS bucket FROM posts WHERE {where}) p ON p.bucket = b.bucket GROUP BY b.bucket"""


_over(posts_docs, "post_totals", lambda p: stats.totals(p, F.length("text")), _totals_sql("length(text)"))
_over(posts_orders, "order_totals", lambda p: stats.totals(p, F.col("text_len")), _totals_sql("text_len"))
_over(posts_docs, "length_buckets", stats.length_buckets, _bucket_sql("'0-40', '41-80', '81-140', '141-200', '201-260', '261+'", _LEN, "text IS NOT NULL"))
_over(posts_docs, "view_buckets", stats.view_buckets, _bucket_sql("'0-1k', '1k-5k', '5k-10k', '10k+'", _VIEW, "views IS NOT NULL"))
_over(posts_docs, "length_by_importance", stats.length_by_importance, """SELECT l.importance::INT AS importance, count(p.post_id) AS posts, round(avg(length(text)), 6) AS avg_length, min(length(text)) AS min_length, max(length(text)) AS max_length,
  round(quantile_cont(length(text)::DOUBLE, 0.5), 6) AS median_length, round(quantile_cont(length(text)::DOUBLE, 0.9), 6) AS p90_length, round(avg(views), 6) AS avg_views FROM (SELECT unnest(range(1, 6)) AS importance) l LEFT JOIN posts p USING (importance) GROUP BY l.importance""")
_over(posts_docs, "score_length_matrix", lambda p: stats.score_matrix(p, length_bucket(F.length("text"))), f"SELECT importance, {_LEN} AS bucket, count(*) AS posts FROM posts WHERE importance BETWEEN 1 AND 5 GROUP BY ALL")
_over(posts_docs, "score_view_matrix", lambda p: stats.score_matrix(p.where("views is not null"), view_bucket(F.col("views"))), f"SELECT importance, {_VIEW} AS bucket, count(*) AS posts FROM posts WHERE importance BETWEEN 1 AND 5 AND views IS NOT NULL GROUP BY ALL")
_over(posts_docs, "score_length_rows", lambda p: stats.score_rows(p, F.length("text")), """SELECT l.importance::INT AS importance, count(p.post_id) AS posts, round(avg(length(text)), 6) AS avg_length, round(avg(views), 6) AS avg_views, round(count(p.post_id) / greatest(1, max(count(p.post_id)) OVER ()), 6) AS scale
  FROM (SELECT unnest(range(1, 6)) AS importance) l LEFT JOIN posts p USING (importance) GROUP BY l.importance""")
_over(posts_docs, "verdict_stats", stats.verdicts, "SELECT verdict, count(*) AS posts, round(avg(length(text)), 6) AS avg_length, round(avg(importance), 6) AS avg_importance, round(avg(views), 6) AS avg_views FROM posts WHERE verdict IS NOT NULL GROUP BY verdict")
_TAGS = "(SELECT post_id, importance, posted_at, tag1 AS tag FROM posts WHERE tag1 IS NOT NULL UNION ALL SELECT post_id, importance, posted_at, tag2 FROM posts WHERE tag2 IS NOT NULL)"
_over(posts_docs, "tag_stats", stats.tags, f"SELECT tag, count(*) AS posts, round(avg(importance), 6) AS avg_importance, round(count(*) FILTER (WHERE importance >= 4) / nullif(count(importance), 0), 6) AS high_ratio FROM {_TAGS} GROUP BY tag ORDER BY posts DESC, min(post_id), tag LIMIT 12")
for _name, _key, _sql in (("langs", lambda: F.col("lang"), "lang"), ("verdicts", lambda: F.col("verdict"), "verdict"), ("lengths", lambda: length_bucket(F.length("text")), _LEN)):
    _over(posts_docs, f"high_profile_{_name}", lambda p, k=_key: stats.high_shares(p, k()), f"SELECT coalesce({_sql}, 'unknown') AS key, count(*) AS posts, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM posts WHERE importance >= 4 GROUP BY ALL")
_over(posts_docs, "high_profile_authors", lambda p: stats.high_shares(p, text.author_title(F.concat(F.lit("Name "), F.col("account_id").cast("string")), F.concat(F.lit("h"), F.col("account_id").cast("string")))), """SELECT coalesce('Name ' || account_id || ' (@h' || account_id || ')', 'Unknown') AS key, count(*) AS posts, round(count(*) / (SELECT count(*) FROM posts WHERE importance >= 4), 6) AS share
  FROM posts WHERE importance >= 4 GROUP BY 1""")
_over(posts_docs, "tag_dictionary", lambda p: p.select(F.explode("tags").alias("t")).select(F.lower(F.trim("t")).alias("tag")).where("tag <> ''").groupBy("tag").agg(F.count("*").alias("posts")).orderBy(F.desc("posts"), "tag").limit(100), f"SELECT lower(trim(tag)) AS tag, count(*) AS posts FROM {_TAGS} GROUP BY 1 ORDER BY posts DESC, tag LIMIT 100")



def _search_sql(groups: list[list[str]]) -> str:
    fields = ("text", "summary", "suggestions", "verdict")
    terms = lambda t: "(" + " OR ".join([*(f"coalesce(contains(lower({f}), '{t.lower()}'), false)" for f in fields), f"coalesce('{t}' IN (tag1, tag2), false)"]) + ")"
    return " OR ".join("(" + " AND ".join(map(terms, g)) + ")" for g in groups)


_over(posts_docs, "search_dsl", lambda p: search.search(p, "the, macro; ignore; queso; ABOUT 12").select("post_id"), f"SELECT post_id FROM posts WHERE {_search_sql([['the', 'macro'], ['ignore'], ['queso'], ['ABOUT 12']])}")
_over(posts_docs, "search_page", lambda p: search.page(p, search.priority(), 3, 20).select("post_id", "importance"), "SELECT post_id, importance FROM posts ORDER BY importance DESC NULLS LAST, posted_at DESC, post_id LIMIT 20 OFFSET 40")
_over(posts_docs, "pending_anti", lambda p: p.where("importance is null").select("post_id", "account_id"), "SELECT post_id, account_id FROM posts WHERE importance IS NULL")
_over(texts, "number_tokens", lambda p: p.select("post_id", text.number_tokens(F.col("text")).cast("long").alias("numbers")), r"SELECT post_id, len(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)?%?')) AS numbers FROM posts")
_over(texts, "chunk_plan", lambda p: merge.chunks(p, "account_id", "post_id", 10).select("post_id", "chunk"), "SELECT post_id, ((row_number() OVER (PARTITION BY account_id ORDER BY post_id) - 1) // 10)::INT AS chunk FROM posts")
_over(posts_docs, "view_parse", lambda p: p.select("post_id", F.round("views", 3).alias("views")), "SELECT post_id, round(views, 3) AS views FROM posts")
_over(texts, "text_hashes", lambda p: p.select("post_id", F.sha2("text", 256).alias("hash")), "SELECT post_id, sha256(text) AS hash FROM posts")
_over(routed, "routing_totals", routing.totals, """SELECT count(*) AS total, count(*) FILTER (WHERE status IN ('ROUTED', 'LLM_QUEUED', 'COMPLETED')) AS llm_total, count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'IGNORED') AS ignored, count(*) FILTER (WHERE status = 'AUTO_HIGH') AS auto_high,
  count(*) FILTER (WHERE status = 'ROUTED') AS routed, count(*) FILTER (WHERE status = 'LLM_QUEUED') AS queued, count(*) FILTER (WHERE status = 'COMPLETED') AS completed,
  count(*) FILTER (WHERE status = 'IGNORED' AND reason IN ('embed-low', 'embed-negative')) AS embed_low, count(*) FILTER (WHERE status = 'IGNORED' AND (reason IS NULL OR reason NOT IN ('embed-low', 'embed-negative'))) AS ignored_other FROM posts""")
for _key in ("status", "reason"):
    _over(routed, f"{_key}_distribution", lambda p, k=_key: routing.distribution(p, k), f"SELECT coalesce({_key}, '(null)') AS {_key}, count(*) AS posts, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM posts GROUP BY ALL")
_over(routed, "score_summary", routing.score_summary, "SELECT count(score) AS n, round(min(score), 6) AS lo, round(max(score), 6) AS hi, round(avg(score), 6) AS avg, " + ", ".join(f"round(quantile_cont(score, {p / 100}), 6) AS p{p}" for p in (50, 75, 90, 95, 99)) + " FROM posts")
_over(routed, "score_histogram", routing.histogram, "SELECT bucket, round(bucket * 0.02::DOUBLE, 6) AS lo, round((bucket + 1) * 0.02::DOUBLE, 6) AS hi, count(*) AS posts, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT floor(score / 0.02::DOUBLE)::INT AS bucket FROM posts WHERE score IS NOT NULL) GROUP BY bucket")
_over(routed, "tag_quantiles", routing.tag_quantiles, "SELECT tag, count(*) AS posts, round(avg(score), 6) AS avg_score, " + ", ".join(f"round(list_sort(list(score))[1 + floor((count(*) - 1) * {q / 100})::INT], 6) AS q{q}" for q in (25, 50, 75)) + " FROM posts WHERE score IS NOT NULL AND tag IS NOT NULL GROUP BY tag")
_over(routed, "dispatch_due", lambda p: routing.dispatch_due(p, "2024-01-20 00:00:00", 170, 27300), "SELECT tag, count(*) AS posts FROM posts WHERE status = 'ROUTED' GROUP BY tag HAVING count(*) >= 170 OR min(posted_at) <= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 27300 MINUTE")
_over(routed, "window_counts", windows.window_counts, "SELECT time_bucket(INTERVAL 6 HOUR, posted_at, TIMESTAMP '1970-01-01') AS start, status, count(*) AS posts FROM posts GROUP BY ALL")


def _accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.accounts(posts_orders(spark, sf_dir), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id")))


#: The customers as accounts with a status and a day on which they were made.
_KNOWN = "SELECT c_custkey AS account_id, CASE WHEN c_custkey % 3 = 0 THEN 'UNSUBSCRIBED' ELSE 'SUBSCRIBED' END AS status, CASE WHEN c_custkey % 5 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' ELSE TIMESTAMP '2023-06-01 00:00:00' END AS created_at FROM customer"


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_KNOWN.replace("FROM customer", "FROM {customer}").replace("TIMESTAMP '", "TIMESTAMP_NTZ '"), customer=table(spark, sf_dir, "customer"))


_ACCOUNTS = f"""WITH {POSTS_ORDERS}, stats AS (SELECT c_custkey AS account_id, count(post_id) AS posts, count(importance) AS scored, round(avg(importance), 6) AS avg_importance, count(*) FILTER (WHERE importance >= 4) AS high,
  round(count(*) FILTER (WHERE importance >= 4) / nullif(count(importance), 0), 6) AS high_ratio,
  min(posted_at) AS first_at, max(posted_at) AS last_at,
  CASE WHEN count(post_id) > 0 THEN round(count(post_id) / greatest(1, date_diff('day', min(posted_at)::DATE, max(posted_at)::DATE) + 1), 6) END AS per_day
  FROM customer LEFT JOIN posts ON account_id = c_custkey GROUP BY c_custkey)"""
QUERIES["account_stats"] = _accounts
SQL["account_stats"] = f"{_ACCOUNTS} SELECT * FROM stats"
QUERIES["account_policy"] = lambda spark, sf_dir: stats.policy(_accounts(spark, sf_dir).join(_known(spark, sf_dir), "account_id"), "2024-01-20 00:00:00")
SQL["account_policy"] = f"""{_ACCOUNTS}, d AS (SELECT account_id, coalesce(scored > 0 AND (avg_importance >= 3.0 OR high >= 6 OR high_ratio > 0.25), false) AS keep FROM stats),
w AS (SELECT account_id, keep, status, CASE WHEN created_at >= TIMESTAMP '2024-01-06 00:00:00' THEN status WHEN keep THEN 'SUBSCRIBED' ELSE 'UNSUBSCRIBED' END AS desired FROM d JOIN ({_KNOWN}) USING (account_id))
SELECT account_id, CASE WHEN keep THEN 'keep' ELSE 'drop' END AS decision, desired, CASE WHEN status = desired THEN 'none' WHEN desired = 'SUBSCRIBED' THEN 'resubscribe' ELSE 'unsubscribe' END AS action FROM w"""
QUERIES["account_totals"] = lambda spark, sf_dir: stats.account_totals(_known(spark, sf_dir))
SQL["account_totals"] = f"SELECT count(*) AS total, count(*) FILTER (WHERE status = 'SUBSCRIBED') AS subscribed, count(*) FILTER (WHERE status = 'UNSUBSCRIBED') AS unsubscribed FROM ({_KNOWN})"


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors as posts, and the cache of the newest 200 of each tag, of which a post leaves out its own."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.format_string("%02d", "label").alias("tag"), F.col("embedding").cast("array<double>").alias("v"))
    return v.select(F.col("vec_id").alias("post_id"), "v"), similarity.recent(v, "vec_id").select("tag", "v", F.col("vec_id").alias("sample_id"))


QUERIES["knn_routing"] = lambda spark, sf_dir: routing.knn(*_vectors(spark, sf_dir), low=0.32, high=0.38, margin=0.01, strict=0.42).withColumn("importance", F.col("importance").cast("double"))
SQL["knn_routing"] = f"""WITH {UNITS},
s AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY tag ORDER BY vec_id DESC) <= 200),
b AS (SELECT p.vec_id AS post_id, s.tag, max(list_inner_product(p.v, s.v)) AS score FROM v p JOIN s ON p.vec_id <> s.vec_id GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM b WINDOW w AS (PARTITION BY post_id ORDER BY score DESC, tag)),
m AS (SELECT *, CASE WHEN second >= 0 THEN score - second END AS margin, score > 0.32 AND score >= 0.38 AND coalesce(margin, 0) >= 0.01 AS sure FROM r WHERE r = 1)
SELECT post_id, tag, round(score, 6) AS score, round(margin, 6) AS margin, CASE WHEN score <= 0.32 THEN 'IGNORED' WHEN sure THEN 'AUTO_HIGH' ELSE 'ROUTED' END AS status,
  CASE WHEN score <= 0.32 THEN 'embed-low' WHEN sure THEN 'embed-high' ELSE 'embed-analyze' END AS reason, (CASE WHEN sure THEN CASE WHEN score >= 0.42 THEN 5 ELSE 4 END END)::DOUBLE AS importance FROM m"""

QUERIES["never_ordered"] = lambda spark, sf_dir: merge.insert_absent(table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")), table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")
SQL["never_ordered"] = "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"
QUERIES["upsert_merge"] = lambda spark, sf_dir: merge.upsert(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice")), "o_orderkey")
SQL["upsert_merge"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders"
QUERIES["keep_first"] = lambda spark, sf_dir: merge.keep_first(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")
SQL["keep_first"] = "SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey"
_over(texts, "rule_routing", routing.rules, rf"""SELECT post_id, CASE
  WHEN len(list_filter({routing.KEYWORDS}, lambda k: contains(lower(t), k))) > 0 OR size >= 120 OR (amount AND timed) OR (regexp_matches(t, '(?i)\$[a-z]{{2,6}}\b') AND nums >= 2) THEN 'rule-keep'
  WHEN coalesce(lower(trim(lang)) IN ('zxx', 'und', 'qme', 'qst', 'qam', 'qct', 'qht'), false) THEN 'low-lang' WHEN size < 80 AND nums <= 1 AND NOT amount AND NOT timed THEN 'low-info-short' ELSE 'rule-drop' END AS outcome
FROM (SELECT *, len(regexp_extract_all(t, '[0-9]+(?:[.,][0-9]+)?%?')) AS nums, length(t) + len(regexp_extract_all(t, '[\x{{10000}}-\x{{10FFFF}}]')) AS size,
  regexp_matches(t, '(?i)%|\b(usd|usdt|usdc|btc|eth|bnb|sol|m|b|k)\b|美元|美金|亿|万') AS amount, regexp_matches(t, '(?i)\b(sec|second|minute|min|hour|day|week|month|year)s?\b|分钟|小时|天|周|月|年|UTC|GMT') AS timed
  FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM posts))""")

# account reports
for _name, _fn, _sql in (
    ("account_distribution", stats.account_buckets, """SELECT kind, bucket, count(*) AS accounts FROM (
  SELECT 'avg' AS kind, CASE WHEN avg_importance IS NULL THEN 'none' WHEN avg_importance < 2 THEN '1.0-1.9' WHEN avg_importance < 3 THEN '2.0-2.9' WHEN avg_importance < 4 THEN '3.0-3.9' WHEN avg_importance < 5 THEN '4.0-4.9' ELSE '5.0' END AS bucket FROM stats
  UNION ALL SELECT 'high', CASE WHEN high = 0 THEN '0' WHEN high <= 2 THEN '1-2' WHEN high <= 5 THEN '3-5' WHEN high <= 10 THEN '6-10' ELSE '11+' END FROM stats
  UNION ALL SELECT 'ratio', CASE WHEN high_ratio IS NULL THEN 'none' WHEN high_ratio < 0.1 THEN '<10%' WHEN high_ratio < 0.25 THEN '<25%' WHEN high_ratio < 0.5 THEN '<50%' WHEN high_ratio < 0.75 THEN '<75%' ELSE '>=75%' END FROM stats) GROUP BY ALL"""),
    ("account_kpis", stats.account_kpis, "SELECT count(*) AS accounts, count(*) FILTER (WHERE scored > 0) AS scored, count(*) FILTER (WHERE high > 0) AS with_high, count(*) FILTER (WHERE high_ratio >= 0.5) AS mostly_high FROM stats"),
    ("account_leaders", lambda a: stats.leaders(a, "avg_importance"), "SELECT account_id, scored, avg_importance FROM stats WHERE avg_importance IS NOT NULL ORDER BY avg_importance DESC, scored DESC, account_id LIMIT 10"),
    ("account_high_leaders", lambda a: stats.leaders(a, "high"), "SELECT account_id, scored, high FROM stats ORDER BY high DESC, scored DESC, account_id LIMIT 10"),
):
    QUERIES[_name] = lambda spark, sf_dir, f=_fn: f(_accounts(spark, sf_dir))
    SQL[_name] = f"{_ACCOUNTS} {_sql}"

# posts of high importance
_over(posts_docs, "high_profile_totals", stats.high_totals, """SELECT count(*) FILTER (WHERE h) AS posts, round(count(*) FILTER (WHERE h) / nullif(count(importance), 0), 6) AS ratio,
  round(quantile_cont(length(text)::DOUBLE, 0.5) FILTER (WHERE h), 6) AS length_p50, round(quantile_cont(length(text)::DOUBLE, 0.9) FILTER (WHERE h), 6) AS length_p90,
  round(quantile_cont(views, 0.5) FILTER (WHERE h), 6) AS views_p50, round(quantile_cont(views, 0.9) FILTER (WHERE h), 6) AS views_p90,
  round(avg(length(text)) FILTER (WHERE h), 6) AS avg_length, count(views) FILTER (WHERE h) AS with_views, round(avg(views) FILTER (WHERE h), 6) AS avg_views,
  round(avg((tag1 IS NOT NULL)::INT + (tag2 IS NOT NULL)::INT) FILTER (WHERE h), 6) AS avg_tags, round(avg((coalesce(trim(summary), '') <> '')::INT) FILTER (WHERE h), 6) AS summary_rate, round(avg((coalesce(trim(suggestions), '') <> '')::INT) FILTER (WHERE h), 6) AS suggestions_rate FROM (SELECT *, coalesce(importance >= 4, false) AS h FROM posts)""")
_over(posts_docs, "high_profile_tags", stats.high_tags, f"SELECT tag, count(*) AS posts, round(count(*) / (SELECT count(*) FROM posts WHERE importance >= 4), 6) AS share FROM {_TAGS} WHERE importance >= 4 GROUP BY tag")
_over(routed, "score_by_tag", routing.top_tags, "SELECT tag, count(*) AS posts, round(avg(score), 6) AS avg_score FROM posts WHERE score IS NOT NULL AND tag IS NOT NULL GROUP BY tag ORDER BY posts DESC, tag LIMIT 10")
_over(routed, "compare_reason", lambda p: routing.compared(p, "embed-low"), "SELECT CASE WHEN reason IS NOT DISTINCT FROM 'embed-low' THEN 'with' ELSE 'without' END AS side, count(*) AS posts, count(score) AS scored, round(avg(score), 6) AS avg_score, round(max(score), 6) AS hi FROM posts GROUP BY ALL")

# features of the text
_PREPARED = r"""e AS (SELECT *, length(t) AS len, len(regexp_extract_all(t, '[0-9]+(?:[.,][0-9]+)?%?')) AS nums, coalesce(len(regexp_extract_all(t, '[0-9]')) / nullif(length(t), 0), 0) AS ratio
  FROM (SELECT *, coalesce(importance >= 4, false) AS high, coalesce(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS t FROM posts)), a AS (SELECT greatest(1, count(*) FILTER (WHERE high)) AS highs FROM e)"""
_FEATURES = {f"len>={k}": f"len >= {k}" for k in (40, 80, 120)} | {f"numberTokens>={k}": f"nums >= {k}" for k in (1, 2)} | {f"digitRatio>={k}%": f"ratio >= {k / 100}::DOUBLE" for k in (1, 3, 6)} | {
    "hasAmountUnit": r"regexp_matches(t, '(?i)%|\b(usd|usdt|usdc|btc|eth|bnb|sol|m|b|k)\b|美元|美金|亿|万')",
    "hasTimeUnit": r"regexp_matches(t, '(?i)\b(sec|second|minute|min|hour|day|week|month|year)s?\b|分钟|小时|天|周|月|年|UTC|GMT')",
    "hasAddress": "regexp_matches(t, '0x[a-fA-F0-9]{40,64}')",
    "hasUrl": r"regexp_matches(t, '(?i)https?://|www\.')",
    "hasTicker": r"regexp_matches(t, '(?i)\$[a-z]{2,6}\b')",
    "hasHighSignalKeyword": f"len(list_filter({evaluation.HIGH_WORDS}, lambda k: contains(lower(t), k))) > 0",
    "hasLowSignalKeyword": f"len(list_filter({evaluation.LOW_WORDS}, lambda k: contains(lower(t), k))) > 0",
}
_BUCKETS = {"<40": "len < 40", "40-79": "len BETWEEN 40 AND 79", "80-119": "len BETWEEN 80 AND 119", "120-159": "len BETWEEN 120 AND 159", ">=160": "len >= 160"}
_BUCKETS |= {"<1%": "ratio < 0.01::DOUBLE", "1-3%": "ratio >= 0.01::DOUBLE AND ratio < 0.03::DOUBLE", "3-6%": "ratio >= 0.03::DOUBLE AND ratio < 0.06::DOUBLE", ">=6%": "ratio >= 0.06::DOUBLE"} | {str(k): f"nums = {k}" for k in range(3)} | {">=3": "nums >= 3"}
_WORDS = [*evaluation.HIGH_WORDS, *(w for w in evaluation.LOW_WORDS if w not in evaluation.HIGH_WORDS), "the", "und", "que", "les"]


def _rates_sql(name: str, flags: dict[str, str]) -> str:
    counts = " UNION ALL ".join(f"SELECT '{k}' AS {name}, count(*) FILTER (WHERE {c}) AS total, count(*) FILTER (WHERE ({c}) AND high) AS high FROM e" for k, c in flags.items())
    return f", f AS ({counts}) SELECT {name}, total, high, round(high / greatest(1, total), 6) AS precision, round(high / highs, 6) AS recall FROM f, a"


for _name, _fn, _sql in (
    ("feature_eval", evaluation.feature_eval, _rates_sql("feature", _FEATURES) + " WHERE total > 0"),
    ("feature_buckets", evaluation.feature_buckets, _rates_sql("bucket", _BUCKETS)),
    ("keyword_eval", lambda p: evaluation.keyword_eval(p, _WORDS), _rates_sql("keyword", {k: f"contains(lower(t), '{k}')" for k in _WORDS}) + " WHERE total >= 10 ORDER BY precision DESC, recall DESC, keyword LIMIT 25"),
    ("lang_eval", evaluation.lang_eval, " SELECT coalesce(nullif(lang, ''), 'unknown') AS lang, count(*) AS total, count(*) FILTER (WHERE high) AS high, round(count(*) FILTER (WHERE high) / count(*), 6) AS precision FROM e GROUP BY 1"),
):
    _over(posts_docs, _name, _fn, "")
    SQL[_name] = f"WITH {POSTS_DOCS}, {_PREPARED}{_sql}"
_over(texts, "text_normalize", lambda p: p.select("post_id", text.embedding_text(F.col("text"), text.PLAIN_WHITE).alias("bare"), text.cut(text.collapse(F.col("text"), text.PLAIN_WHITE), 40).alias("short")), r"""SELECT post_id, CASE WHEN bare = '' THEN t ELSE bare END AS bare, CASE WHEN length(t) <= 40 THEN t ELSE t[:39] || '…' END AS short FROM (SELECT post_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t,
  trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)^rt\s+@[A-Za-z0-9_]+:\s*', ''), '(?i)^rt\s+', ''), '(?i)https?://\S+|\bt\.co/\S+|\bpic\.twitter\.com/\S+', ' ', 'g'), '@[A-Za-z0-9_]+', ' ', 'g'), '#([\p{L}\p{N}_]+)', '\1', 'g'), '\s+', ' ', 'g')) AS bare FROM posts)""")

# vectors
_SAMPLES = f"""{UNITS},
s AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY tag ORDER BY vec_id DESC) <= 200)"""
_TAG_STATS = f"""WITH {_SAMPLES}, n AS (SELECT tag, vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM s),
e AS (SELECT tag, i, sum(u[i]) AS x FROM n, LATERAL (SELECT unnest(range(1, len(u) + 1)) AS i) GROUP BY ALL), c AS (SELECT tag, list(x ORDER BY i) AS c FROM e GROUP BY tag),
d AS (SELECT tag, list_inner_product(u, c) / sqrt(list_inner_product(c, c)) AS sim FROM n JOIN c USING (tag)),
t AS (SELECT tag, count(*) AS samples, avg(sim) AS mean, {", ".join(f"list_sort(list(sim))[1 + floor((count(*) - 1) * {q / 100})::INT] AS p{q}" for q in (25, 50, 75))} FROM d GROUP BY tag)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if kind == "double" else c for c, kind in df.dtypes])


QUERIES["tag_centroid_stats"] = lambda spark, sf_dir: _rounded(similarity.tag_stats(_vectors(spark, sf_dir)[1]))
SQL["tag_centroid_stats"] = f"{_TAG_STATS} SELECT tag, samples, {', '.join(f'round({c}, 6) AS {c}' for c in ('mean', 'p25', 'p50', 'p75'))} FROM t"
QUERIES["tag_thresholds"] = lambda spark, sf_dir: _rounded(similarity.thresholds(similarity.tag_stats(_vectors(spark, sf_dir)[1])))
SQL["tag_thresholds"] = f"""{_TAG_STATS}, b AS (SELECT tag, CASE WHEN samples >= 10 THEN least(0.91, greatest(0.81, (0.86 + p75) / 2)) ELSE 0.86 END::DOUBLE AS high, CASE WHEN samples >= 10 THEN least(0.73, greatest(0.63, (0.68 + p25) / 2)) ELSE 0.68 END::DOUBLE AS low,
  CASE WHEN samples >= 10 AND p75 - p50 < 0.02 THEN 0.05 ELSE 0.04 END::DOUBLE AS margin FROM t)
SELECT tag, round(CASE WHEN low >= high - 0.02 THEN least(high - 0.01, greatest(0.5, high - 0.02)) ELSE low END, 6) AS low, round(high, 6) AS high, round(margin, 6) AS margin, round(greatest(0.9::DOUBLE, high + 0.02), 6) AS strict FROM b"""
QUERIES["best_runner_up"] = lambda spark, sf_dir: _rounded(similarity.nearest_tags(*_vectors(spark, sf_dir)).drop("known"))
SQL["best_runner_up"] = f"""WITH {_SAMPLES}, b AS (SELECT p.vec_id AS post_id, s.tag, max(list_inner_product(p.v, s.v)) AS score FROM v p JOIN s ON p.vec_id <> s.vec_id GROUP BY ALL)
SELECT post_id, tag, round(score, 6) AS score, round(second, 6) AS second FROM (SELECT *, row_number() OVER w AS r, lead(score) OVER w AS second FROM b WINDOW w AS (PARTITION BY post_id ORDER BY score DESC, tag)) WHERE r = 1"""
QUERIES["sim_diagnostics"] = lambda spark, sf_dir: _rounded(similarity.diagnostics(*_vectors(spark, sf_dir), [1, 3, 5]))
SQL["sim_diagnostics"] = f"""WITH {_SAMPLES}, r AS (SELECT p.vec_id, s.tag, list_inner_product(p.v, s.v) AS x, row_number() OVER (PARTITION BY p.vec_id, s.tag ORDER BY x DESC) AS i FROM v p JOIN s ON p.vec_id <> s.vec_id),
b AS (SELECT k, vec_id, max(x) AS score FROM (SELECT k, vec_id, tag, avg(x) AS x FROM r, (SELECT unnest([1, 3, 5]) AS k) WHERE i <= k GROUP BY ALL) GROUP BY ALL)
SELECT k, count(*) AS posts, round(avg(score), 6) AS mean, round(max(score), 6) AS hi, {", ".join(f"round(list_sort(list(score))[1 + floor((count(*) - 1) * {q / 100})::INT], 6) AS q{q}" for q in (50, 90))} FROM b GROUP BY k"""


def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("post_id"), F.col("embedding").cast("array<double>").alias("v"))
    return _rounded(similarity.semantic_page(v, v.where("post_id = 2").select(F.col("v").alias("q")), [F.desc("post_id")], number=2, size=20).select("post_id", "score"))


QUERIES["semantic_topk"] = _semantic
SQL["semantic_topk"] = """WITH v AS (SELECT vec_id AS post_id, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT * FROM v ORDER BY post_id DESC LIMIT 2000)
SELECT c.post_id, round(list_inner_product(c.v, q.v) / sqrt(list_inner_product(c.v, c.v) * list_inner_product(q.v, q.v)), 6) AS score FROM c, v q WHERE q.post_id = 2 ORDER BY list_inner_product(c.v, q.v) / sqrt(list_inner_product(c.v, c.v)) DESC, c.post_id DESC LIMIT 20 OFFSET 20"""


def _reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A post a minute, a report every six hours."""
    v = table(spark, sf_dir, "embeddings")
    return reports.clusters(v.selectExpr("vec_id div 360 AS report", "vec_id AS post_id", "cast(vec_id % 5 AS int) AS importance", "vec_id AS posted_at", "array(concat('t', vec_id % 3), concat('t', vec_id % 7)) AS tags", "cast(embedding AS array<double>) AS v"), threshold=0.3)


QUERIES["cluster_report"] = _reported

# merges
QUERIES["keep_last"] = lambda spark, sf_dir: merge.keep_last(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_orderkey")
SQL["keep_last"] = "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey"
_over(posts_docs, "stale_embeddings", lambda p: merge.stale(p.select("post_id", F.sha2("text", 256).alias("hash"), F.lit(512).alias("dims")), p.where("post_id % 3 <> 0").select("post_id", F.when(F.col("post_id") % 5 == 0, "old").otherwise(F.sha2("text", 256)).alias("hash"), F.lit(512).alias("dims")), "post_id", ["hash", "dims"]), "SELECT post_id FROM posts WHERE post_id % 3 = 0 OR post_id % 5 = 0")
_over(posts_docs, "chunk_cap", lambda p: merge.chunk_cap(p, "account_id", "post_id", 10, 4).select("post_id"), "SELECT post_id FROM posts QUALIFY (row_number() OVER (PARTITION BY account_id ORDER BY post_id) - 1) % 10 < 4")

# scheduling
_NOW = "2024-01-20 00:00:00"
_JOBS = "SELECT event_id AS job_id, CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'RUNNING' WHEN 'error' THEN 'FAILED' ELSE 'COMPLETED' END AS status, ts AS locked_at FROM "
_LOCKS = "SELECT event_id AS key, CASE event_id % 3 WHEN 0 THEN concat('job:', cast(event_id % 997 AS varchar(20))) WHEN 1 THEN 'worker' END AS locked_by, ts AS locked_at, ts + interval '1' day AS expires_at FROM "


def _events(query: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.sql(query + "{events}", events=table(spark, sf_dir, "events"))


QUERIES["stale_jobs"] = lambda spark, sf_dir: jobs.expire(_events(_JOBS)(spark, sf_dir), _NOW)
SQL["stale_jobs"] = f"SELECT job_id, CASE WHEN status = 'RUNNING' AND locked_at < TIMESTAMP '{_NOW}' - INTERVAL 3 HOUR THEN 'COMPLETED' ELSE status END AS status FROM ({_JOBS}events)"
QUERIES["lock_recovery"] = lambda spark, sf_dir: jobs.locks(_events(_LOCKS)(spark, sf_dir), _events(_JOBS)(spark, sf_dir), _NOW)
SQL["lock_recovery"] = f"SELECT key, locked_by IS NULL OR expires_at <= TIMESTAMP '{_NOW}' OR (locked_by LIKE 'job:%' AND coalesce(status, '') <> 'RUNNING') AS recoverable FROM ({_LOCKS}events) LEFT JOIN ({_JOBS}events) j ON locked_by = 'job:' || job_id"
_over(routed, "trigger_decision", lambda p: jobs.trigger(p.where("status = 'PENDING'"), 50), "SELECT count(*) AS pending, CASE WHEN count(*) = 0 THEN 'none-pending' WHEN count(*) < 50 THEN 'below-threshold' ELSE 'run' END AS decision FROM posts WHERE status = 'PENDING'")


def _fetched(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("account_id")).agg(F.max("ts").alias("last"))
    return last.select("account_id", F.when(F.col("account_id") % 7 != 0, F.col("last")).alias("last_fetched"))


QUERIES["due_accounts"] = lambda spark, sf_dir: jobs.due(_fetched(spark, sf_dir), "2024-01-30 06:00:00")
SQL["due_accounts"] = """WITH a AS (SELECT user_id AS account_id, CASE WHEN user_id % 7 <> 0 THEN max(ts) END AS last_fetched FROM events GROUP BY user_id), c AS (SELECT *, coalesce(last_fetched + INTERVAL 12 HOUR > TIMESTAMP '2024-01-30 06:00:00', false) AS cooling FROM a)
SELECT account_id, CASE WHEN cooling THEN 'cooling' WHEN row_number() OVER (PARTITION BY cooling ORDER BY last_fetched NULLS LAST, account_id) <= 10 THEN 'fetched' ELSE 'waiting' END AS state FROM c"""

# reports
_over(posts_docs, "tag_sections", lambda p: reports.sections(p, reports.primary_tag()), "SELECT coalesce(tag1, 'other') AS section, post_id, row_number() OVER (PARTITION BY coalesce(tag1, 'other') ORDER BY coalesce(importance, 0) DESC, posted_at DESC, post_id) - 1 AS pos FROM posts")
_over(posts_docs, "author_sections", lambda p: reports.sections(p, F.coalesce("account_id", F.lit("Unknown"))), "SELECT coalesce(account_id, 'Unknown') AS section, post_id, row_number() OVER (PARTITION BY coalesce(account_id, 'Unknown') ORDER BY coalesce(importance, 0) DESC, posted_at DESC, post_id) - 1 AS pos FROM posts")
_over(posts_docs, "section_overview", lambda p: reports.overview(p, reports.primary_tag()), "SELECT coalesce(tag1, 'other') AS section, count(*) AS posts, coalesce(max(importance), 0) AS peak FROM posts GROUP BY 1 ORDER BY peak DESC, posts DESC, section LIMIT 3")


def _scored(p: DataFrame) -> DataFrame:
    items = p.where("verdict is not null").selectExpr("post_id", "concat(upper(verdict), ' ') AS verdict", "importance + 0.5D AS importance", "transform(tags, (t, i) -> CASE i WHEN 0 THEN concat(' ', upper(t)) ELSE concat(t, '?') END) AS tags", "summary", "suggestions", "text")
    found = reports.filled(p, reports.normalized_insights(items))
    return found.select("post_id", "verdict", "importance", F.array_join("tags", ",").alias("tags"), "summary", "suggestions")


_SHORT = r"(CASE WHEN length(t) <= 120 THEN t ELSE t[:119] || '…' END)"
_over(posts_docs, "llm_fill", _scored, rf"""SELECT post_id, CASE WHEN verdict IS NULL OR (verdict = 'actionable' AND suggestions IS NULL) THEN 'watch' ELSE verdict END AS verdict,
  CASE WHEN verdict IS NULL THEN 2 WHEN verdict = 'actionable' AND suggestions IS NULL THEN least(3, importance + 1) ELSE least(5, importance + 1) END AS importance,
  CASE WHEN verdict IS NULL THEN 'other' WHEN tag2 IS NULL OR tag1 = 'other' THEN tag1 ELSE tag1 || ',other' END AS tags,
  CASE WHEN verdict IS NOT NULL THEN coalesce(summary, {_SHORT}) ELSE {_SHORT} END AS summary, suggestions FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM posts)""")
_over(posts_docs, "stratified_sample", lambda p: reports.stratified(p.where("importance >= 3"), F.concat_ws(":", text.lang_group(F.col("lang")), text.size_group(F.col("text"))), 40), "")
del SQL["stratified_sample"]

# written reports and outlines
_MARKDOWN = """concat('# Report ', post_id, '\n> 时间范围：', lang, '\n- no section\n## ', CASE WHEN post_id % 3 = 0 THEN '其它' ELSE '重点洞察' END, '\n* ', text, ' [', coalesce(verdict, 'none'), ']\n### ', coalesce(verdict, 'none'), '\n2. see [a](b) ', text)"""
_over(posts_docs, "report_entries", lambda p: delivery.entries(p.select(F.col("post_id").alias("report"), F.expr(_MARKDOWN).alias("markdown")), ["分类", "重点洞察", "额外洞察"]).select("report", (F.col("pos") + 1).cast("long").alias("pos"), "headline", "time_range", "category", "text"), rf"""
, l AS (SELECT post_id AS report, i AS pos, ls[i] AS raw, regexp_replace(ls[i], '^\s+|\s+$', '', 'g') AS line FROM (SELECT post_id, regexp_split_to_array({_MARKDOWN.replace(chr(10), "' || chr(10) || '")}, '\r?\n') AS ls FROM posts), LATERAL (SELECT unnest(range(1, len(ls) + 1)) AS i)),
h AS (SELECT *, coalesce(max_by(CASE WHEN line LIKE '# %' THEN regexp_replace(line, '^#\s+', '') END, CASE WHEN line LIKE '# %' THEN pos END) OVER (PARTITION BY report), '') AS headline,
  coalesce(max_by(CASE WHEN line LIKE '> 时间范围：%' THEN line[3:] END, CASE WHEN line LIKE '> 时间范围：%' THEN pos END) OVER (PARTITION BY report), '') AS time_range,
  last_value(CASE WHEN regexp_matches(line, '^##\s') THEN regexp_replace(line, '^##\s+', '') END IGNORE NULLS) OVER w AS section, last_value(CASE WHEN regexp_matches(line, '^###?\s') THEN regexp_replace(line, '^###?\s+', '') END IGNORE NULLS) OVER w AS category
  FROM l WINDOW w AS (PARTITION BY report ORDER BY pos)),
t AS (SELECT *, regexp_replace(regexp_replace(raw, '^\s*(?:[-*]|[0-9]+\.)\s+', ''), '^\s+|\s+$', '', 'g') AS item FROM h WHERE line <> '' AND regexp_matches(raw, '^\s*(?:[-*]|[0-9]+\.)\s+') AND section IN ('分类', '重点洞察', '额外洞察'))
SELECT report, pos, headline, time_range, category, regexp_replace(regexp_replace(regexp_replace(item, '\[([^\]]+)\]\(([^)]+)\)', '\1: \2', 'g'), '\s*\[([^\]]+)\]\s*$', ' Tags: \1'), '^\s+|\s+$', '', 'g') AS text FROM t WHERE item <> ''""")
_OUTLINE = """concat('{"mode":"clustered","sections":[{"title":"", "tag":"', tags[0], '","clusters":[{"size":', post_id % 5, ',"peakImportance":', importance, ',"tags":["', array_join(tags, '","'), '"],"representative":{"tweetId":" ', post_id, ' ","summary":"s"},"memberTweetIds":["', post_id, '","', post_id + 1, '"]}]}]}')"""


def _outlines(p: DataFrame) -> DataFrame:
    return p.where("importance is not null").select(F.col("post_id").alias("report"), F.expr(_OUTLINE).alias("outline"))


_over(posts_docs, "outline_ids", lambda p: _outlines(p).select("report", F.explode(outlines.post_ids(F.col("outline"), members=True)).alias("id")), "SELECT post_id AS report, (post_id + k)::VARCHAR AS id FROM posts, (SELECT unnest([0, 1]) AS k) WHERE importance IS NOT NULL")
_over(posts_docs, "outline_tag_counts", lambda p: outlines.tag_counts(_outlines(p)), "SELECT post_id AS report, tag, post_id % 5 AS posts FROM (SELECT post_id, tag1 AS tag FROM posts UNION SELECT post_id, tag2 FROM posts) WHERE tag IS NOT NULL AND post_id % 5 > 0")
_over(posts_docs, "outline_high", lambda p: outlines.high_entries(_outlines(p)).select("report", "category", "text"), "SELECT post_id AS report, '其他' AS category, 's' AS text FROM posts WHERE importance >= 4")

for _part in (selection, classify, reporting):
    QUERIES |= _part.QUERIES
    SQL |= _part.SQL
