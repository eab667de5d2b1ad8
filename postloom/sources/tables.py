"""Tables of a folder, and the posts that the statistics and routing run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions.text import TAGS, view_count

DUCK_TAGS = ",".join(TAGS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, whose rows are dealt out to all cores if the files hold less than a split for each: one row group is one task, whatever is then done with its texts.

    Larger tables are read as they are, without a shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes", "134217728b"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df


def _tag(k) -> F.Column:
    return F.element_at(F.lit(TAGS), (k % 13 + 1).cast("int"))


def posts_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts from documents and labels: the whole text, importance, verdict, tags, summary, suggestions and a view count as text."""
    d, labels = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    i, scored = F.col("doc_id"), F.col("quality").isNotNull()
    views = (
        F.when(i % 7 == 1, (i * 13).cast("string"))
        .when(i % 7 == 2, F.concat((i % 90).cast("string"), F.lit("."), (i % 10).cast("string"), F.lit("K")))
        .when(i % 7 == 3, F.concat((1 + i % 90).cast("string"), F.lit(","), (100 + i % 900).cast("string")))
        .when(i % 7 == 4, "n/a")
        .when(i % 7 == 5, F.concat((i % 5).cast("string"), F.lit(" m")))
        .when(i % 7 == 6, F.concat(F.lit("about "), (i * 3).cast("string"), F.lit(" views")))
    )
    return d.join(labels, "doc_id", "left").select(
        i.alias("post_id"),
        F.col("source").alias("account_id"),
        "lang",
        "text",
        F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id * 37 as int), 0)").alias("posted_at"),
        F.when(scored, F.when(F.col("quality") == 0, 1 + i % 2).otherwise(2 + i % 4)).cast("int").alias("importance"),
        F.when(scored, F.when(F.col("toxic") == 1, "ignore").when((F.col("quality") == 1) & (2 + i % 4 >= 4), "actionable").otherwise("watch")).alias("verdict"),
        F.when(scored, F.array_compact(F.array(_tag(i), F.when(i % 4 != 0, _tag(i * 5 + 3))))).alias("tags"),
        F.when(scored & (i % 5 != 0), F.concat(F.lit("about "), i.cast("string"))).alias("summary"),
        F.when(scored & (i % 3 == 0), F.concat(F.lit("do "), i.cast("string"))).alias("suggestions"),
        view_count(views).alias("views"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts without what labels say: post_id, account_id, lang, text."""
    return spread(table(spark, sf_dir, "documents")).selectExpr("doc_id AS post_id", "source AS account_id", "lang", "text")


POSTS_DOCS = f"""posts AS (
SELECT d.doc_id AS post_id, d.source AS account_id, d.lang, d.text,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id * 37) AS posted_at,
  (CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 0 THEN 1 + d.doc_id % 2 ELSE 2 + d.doc_id % 4 END)::INT AS importance,
  CASE WHEN l.quality IS NULL THEN NULL WHEN l.toxic = 1 THEN 'ignore' WHEN l.quality = 1 AND 2 + d.doc_id % 4 >= 4 THEN 'actionable' ELSE 'watch' END AS verdict,
  CASE WHEN l.quality IS NULL THEN NULL ELSE split_part('{DUCK_TAGS}', ',', (1 + d.doc_id % 13)::INT) END AS tag1,
  CASE WHEN l.quality IS NULL OR d.doc_id % 4 = 0 THEN NULL ELSE split_part('{DUCK_TAGS}', ',', (1 + (d.doc_id * 5 + 3) % 13)::INT) END AS tag2,
  CASE WHEN l.quality IS NOT NULL AND d.doc_id % 5 <> 0 THEN 'about ' || d.doc_id END AS summary, CASE WHEN l.quality IS NOT NULL AND d.doc_id % 3 = 0 THEN 'do ' || d.doc_id END AS suggestions,
  CASE d.doc_id % 7 WHEN 1 THEN d.doc_id * 13.0 WHEN 2 THEN round((d.doc_id % 90 + (d.doc_id % 10) / 10.0) * 1000) WHEN 3 THEN (1 + d.doc_id % 90) * 1000 + 100 + d.doc_id % 900
    WHEN 5 THEN d.doc_id % 5 * 1000000.0 WHEN 6 THEN d.doc_id * 3.0 END::DOUBLE AS views
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def posts_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts from orders: account, length, importance and views as numbers."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS post_id",
        "o_custkey AS account_id",
        "o_orderdate AS posted_at",
        "o_totalprice AS views",
        "cast(o_orderkey * 31 % 331 AS int) AS text_len",
        "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 6 - cast(substring(o_orderpriority, 1, 1) AS int) END AS importance",
    )


POSTS_ORDERS = """posts AS (SELECT o_orderkey AS post_id, o_custkey AS account_id, o_orderdate AS posted_at, o_totalprice AS views, (o_orderkey * 31 % 331)::INT AS text_len,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 6 - substring(o_orderpriority, 1, 1)::INT END AS importance FROM orders)"""

_ROUTED = """SELECT event_id AS post_id, user_id AS account_id, ts AS posted_at,
  CASE event_type WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'ROUTED' WHEN 'error' THEN 'IGNORED' WHEN 'signup' THEN 'AUTO_HIGH' ELSE 'COMPLETED' END AS status,
  CASE WHEN event_type = 'error' THEN CASE event_id % 4 WHEN 0 THEN 'embed-low' WHEN 1 THEN 'embed-negative' WHEN 2 THEN 'rule-drop' ELSE NULL END
    WHEN event_type = 'signup' THEN 'embed-high' WHEN event_type = 'click' THEN 'embed-analyze' ELSE NULL END AS reason,
  CASE WHEN event_type = 'view' THEN NULL ELSE value / 500.0 END AS score,
  CASE WHEN event_type IN ('error', 'click', 'signup') THEN split_part('macro,policy,security,funding,yield,token,airdrop,trading,onchain,tech,exchange,narrative', ',', cast(1 + event_id % 12 AS int)) ELSE NULL END AS tag
FROM """


def routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routing decisions from events."""
    return spark.sql(_ROUTED + "{events}", events=table(spark, sf_dir, "events"))


ROUTED = f"posts AS ({_ROUTED}events)"


#: The vectors of `embeddings` by tag, as unit vectors; zeros where the length is 0 or not finite.
UNITS = """v AS (SELECT vec_id, lpad(label::VARCHAR, 2, '0') AS tag, list_transform(e, lambda x: CASE WHEN size > 0 AND isfinite(size) THEN x / size ELSE 0 END) AS v
FROM (SELECT *, embedding::DOUBLE[] AS e, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS size FROM embeddings))"""
