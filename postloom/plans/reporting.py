"""Queries of reports: triage, whole reports, digests, outlines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions.text import TAGS, ascii_text
from postloom.operators import delivery, embedding, outlines, reports
from postloom.sources.tables import POSTS_DOCS, posts_docs, table, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts with what reports show; those of a day are a report."""
    rows = posts_docs(spark, sf_dir).withColumns({"report": F.expr("datediff(posted_at, date '2024-01-01')"), "handle": F.col("account_id"), "name": F.concat(F.lit("Name "), F.col("account_id")), "url": F.lit(None).cast("string"), "author_tags": F.array("lang")})
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("post_id"), F.col("embedding").cast("array<double>").alias("v"))
    return rows.join(v, "post_id", "left")


def _triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _posts(spark, sf_dir)
    said = rows.where("report % 7 > 1").select("report", "post_id", F.col("post_id").alias("place"), (F.col("post_id") % 3 != 0).alias("include"))
    # no answer for some reports, an empty one for others
    failed = reports.chunked(rows).where("report % 7 = 0").select("report", "chunk")
    return reports.triage(rows, said, 3, failed).select("report", "post_id")


QUERIES["report_triage"] = _triage
SQL["report_triage"] = f"""WITH {POSTS_DOCS}, p AS (SELECT *, date_diff('day', DATE '2024-01-01', posted_at::DATE) AS report FROM posts),
m AS (SELECT *, (row_number() OVER (PARTITION BY report ORDER BY importance DESC, posted_at DESC, post_id) - 1) // 30 AS chunk FROM p WHERE importance BETWEEN 2 AND 3),
k AS (SELECT report, post_id FROM m WHERE report % 7 > 1 AND post_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY report, chunk ORDER BY post_id) <= 3 UNION SELECT report, post_id FROM m WHERE report % 7 = 0 UNION SELECT report, post_id FROM p WHERE importance >= 4)
SELECT report::INT AS report, post_id FROM p WHERE (report, post_id) IN (SELECT report, post_id FROM k) OR report NOT IN (SELECT m.report FROM m JOIN k USING (report))"""


def _whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = _posts(spark, sf_dir).where("importance is not null")
    return rows, reports.heads(rows, "2024-01-01 00:00:00", "2024-01-02 00:00:00", "Asia/Shanghai", "Digest")


QUERIES["tag_report"] = lambda spark, sf_dir: reports.tag_report(*_whole(spark, sf_dir), ["token"])
QUERIES["author_report"] = lambda spark, sf_dir: reports.author_report(*_whole(spark, sf_dir))
QUERIES["cluster_markdown"] = lambda spark, sf_dir: reports.cluster_report(*_whole(spark, sf_dir), threshold=0.3)
QUERIES["profile_report"] = lambda spark, sf_dir: reports.profile_report(_posts(spark, sf_dir), {"id": 1, "name": "Daily", "hours": 240, "group": "tag", "filter": {"least": 3, "exclude": ["yield"]}}, "2024-01-11 00:00:30")


def _outlines(p: DataFrame) -> DataFrame:
    """A report for each scored post: one section, one cluster."""
    rep = F.struct(F.concat(F.lit(" "), F.col("post_id").cast("string")).alias("tweetId"))
    section = F.struct(F.get("tags", F.lit(0)).alias("tag"), F.array(F.struct("tags", rep.alias("representative"))).alias("clusters"))
    return p.where("importance is not null").select(F.col("post_id").alias("report"), F.to_json(F.struct(F.lit("clustered").alias("mode"), F.array(section).alias("sections"))).alias("outline"))


QUERIES["digest_selection"] = lambda spark, sf_dir: (lambda p: delivery.selected(_outlines(p), p, ["Macro", " token", "others"]).withColumn("summary", F.coalesce("summary", F.lit("-"))))(posts_docs(spark, sf_dir))
SQL["digest_selection"] = f"WITH {POSTS_DOCS} SELECT post_id AS report, 0 AS pos, post_id::VARCHAR AS post_id, coalesce(summary, '-') AS summary FROM posts WHERE importance IS NOT NULL AND tag1 IN ('macro', 'token', 'other')"
QUERIES["outline_tags"] = lambda spark, sf_dir: outlines.tag_set(_outlines(posts_docs(spark, sf_dir))).select("report", F.array_join("tags", ",").alias("tags"))
SQL["outline_tags"] = f"WITH {POSTS_DOCS} SELECT post_id AS report, array_to_string(list_sort(list_distinct(list_filter([tag1, tag2], lambda t: t IS NOT NULL))), ',') AS tags FROM posts WHERE importance IS NOT NULL"


def _days(p: DataFrame) -> DataFrame:
    """A report for each day (some 39 posts): a section for each first tag, in their order, of clusters by importance and id."""
    first = F.get("tags", F.lit(0))
    cluster = F.struct((-F.col("importance")).alias("less"), "post_id", F.col("tags").alias("own"), "summary")
    rows = p.where("importance IS NOT NULL").where(first.isNotNull()).select(F.expr("datediff(posted_at, date '2024-01-01')").alias("report"), first.alias("tag"), cluster.alias("x"))
    shown = F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct((-x["less"]).alias("peakImportance"), x["own"].alias("tags"), F.struct(x["post_id"].cast("string").alias("tweetId"), x["summary"].alias("summary")).alias("representative")))
    sections = rows.groupBy("report", "tag").agg(shown.alias("clusters")).select("report", F.struct("tag", F.upper("tag").alias("title"), "clusters").alias("s"))
    whole = sections.groupBy("report").agg(F.array_sort(F.collect_list("s"), lambda a, b: F.when(a["tag"] < b["tag"], -1).when(a["tag"] > b["tag"], 1).otherwise(0)).alias("sections"))
    return whole.select("report", F.to_json(F.struct(F.lit("clustered").alias("mode"), "sections")).alias("outline"))


_DAYS = f"WITH {POSTS_DOCS}, d AS (SELECT *, date_diff('day', DATE '2024-01-01', posted_at::DATE)::INT AS report FROM posts WHERE importance IS NOT NULL AND tag1 IS NOT NULL)"
QUERIES["digest_order"] = lambda spark, sf_dir: (lambda p: delivery.selected(_days(p), p).withColumn("summary", F.coalesce("summary", F.lit("-"))))(posts_docs(spark, sf_dir))
SQL["digest_order"] = f"{_DAYS} SELECT report, (row_number() OVER o - 1)::INT AS pos, post_id::VARCHAR AS post_id, coalesce(summary, '-') AS summary FROM d WINDOW o AS (PARTITION BY report ORDER BY tag1, importance DESC, post_id) QUALIFY row_number() OVER o <= 20"
QUERIES["outline_entries"] = lambda spark, sf_dir: outlines.high_entries(_days(posts_docs(spark, sf_dir))).select("report", "section", "pos", "post_id", "category", "text")
SQL["outline_entries"] = f"""{_DAYS}, n AS (SELECT *, (dense_rank() OVER (PARTITION BY report ORDER BY tag1) - 1)::INT AS section, (row_number() OVER (PARTITION BY report, tag1 ORDER BY importance DESC, post_id) - 1)::INT AS pos FROM d)
SELECT report, section, pos, post_id::VARCHAR AS post_id, upper(tag1) AS category, trim(summary) AS text FROM n WHERE importance >= 4 AND trim(summary) <> ''"""


def _shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty items of each language's digest, shared among tags."""
    found = posts_docs(spark, sf_dir).select("lang", F.explode("tags").alias("tag")).groupBy(F.coalesce("lang", F.lit("-")).alias("report"), F.array_position(F.lit(TAGS), F.col("tag")).cast("int").alias("pos")).agg(F.count("*").alias("n"))
    return delivery.allocate(found, 20)


def _allocated(groups: str, total: int) -> str:
    """CTEs that end in `a`: report, pos and share, by the rule of the survey, of `groups` (a CTE of report, pos and n)."""
    return f"""e AS (SELECT *, coalesce(n / nullif(sum(n) OVER (PARTITION BY report), 0), 0)::DOUBLE * {total} AS exact FROM {groups}),
b AS (SELECT *, greatest(1, floor(exact))::BIGINT AS base, sum(greatest(1, floor(exact))::BIGINT) OVER (PARTITION BY report) - {total} AS extra, row_number() OVER (PARTITION BY report ORDER BY exact - floor(exact) DESC, pos) AS f FROM e),
u AS (SELECT report, pos, extra, row_number() OVER (PARTITION BY report ORDER BY h DESC, pos) AS r FROM b, LATERAL (SELECT unnest(range(2, base + 1)) AS h) WHERE extra > 0),
a AS (SELECT report, pos, (base - (SELECT count(*) FROM u WHERE u.report = b.report AND u.pos = b.pos AND u.r <= u.extra) + (f <= -extra)::INT)::INT AS share FROM b)"""


QUERIES["digest_shares"] = _shares
SQL["digest_shares"] = f"""WITH {POSTS_DOCS}, t AS (SELECT lang, tag1 AS tag FROM posts UNION ALL SELECT lang, tag2 FROM posts),
g AS (SELECT coalesce(lang, '-') AS report, list_position({TAGS}, tag)::INT AS pos, count(*) AS n FROM t WHERE tag IS NOT NULL GROUP BY ALL), {_allocated("g", 20)} SELECT * FROM a"""
QUERIES["fresh_embeddings"] = lambda spark, sf_dir: embedding.refreshed(texts(spark, sf_dir), spark.createDataFrame([], "post_id long, v array<double>, model string, dimensions int, hash string"), embedding.Hashing(32)).select("post_id", "hash", F.size("v").alias("dimensions"))
QUERIES["ascii_texts"] = lambda spark, sf_dir: texts(spark, sf_dir).select("post_id", F.sha2(ascii_text(F.col("text")), 256).alias("hash"))
SQL["ascii_texts"] = "SELECT doc_id AS post_id, sha256(to_base64(encode(text))) AS hash FROM documents"
QUERIES["tag_targets"] = lambda spark, sf_dir: delivery.tag_targets(posts_docs(spark, sf_dir).where("tags is not null").select(F.col("lang").alias("report"), "tags"), ["macro", "Policy", "token", " yield"], 20)
SQL["tag_targets"] = f"""WITH {POSTS_DOCS}, t AS (SELECT lang, post_id, tag1 AS tag FROM posts UNION SELECT lang, post_id, tag2 FROM posts),
c AS (SELECT lang AS report, tag, list_position(['macro', 'policy', 'token', 'yield'], tag) AS pos, count(*) AS n FROM t WHERE tag IN ('macro', 'policy', 'token', 'yield') GROUP BY ALL),
g AS (SELECT * FROM c WHERE report IN (SELECT report FROM c GROUP BY report HAVING count(*) BETWEEN 2 AND 20)), {_allocated("g", 20)} SELECT report, tag, n AS posts, share FROM a JOIN g USING (report, pos)"""
