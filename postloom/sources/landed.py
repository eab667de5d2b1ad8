"""Sources landed as JSON or text: pages of timelines, caches of samples, bulk lists of accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.functions.text import screen_name, strip
from postloom.functions.vectors import normalized
from postloom.operators.merge import keep_first

#: The fields of a landed page and its posts.
_POST = "struct<tweet_id: string, created_at: string, text: string, lang: string, views: string, conversation_id: string, author: struct<rest_id: string, name: string, screen_name: string>>"
PAGE = f"pinned {_POST}, timeline array<{_POST}>, next_cursor string, prev_cursor string"


def timeline(spark: SparkSession, path: str) -> DataFrame:
    """Posts of landed pages, one JSON object a line: a post on several pages comes once; posts without an id don't count."""
    pages = spark.read.schema(PAGE).json(path)
    posts = pages.select(F.explode("timeline").alias("p")).select("p.*").where("tweet_id <> ''")
    rows = posts.withColumn("at", F.struct("created_at", "text"))
    return keep_first(rows, "tweet_id", "at").drop("at")


def pages_after(pages: DataFrame) -> DataFrame:
    """page, rows, next_cursor, has_more of the pages of a cursor-paged source (page, timeline, next_cursor)."""
    cursor = F.nullif(strip(F.col("next_cursor")), F.lit(""))
    return pages.select("page", F.coalesce(F.size("timeline"), F.lit(0)).alias("rows"), cursor.alias("next_cursor"), cursor.isNotNull().alias("has_more"))


def _number(x: Column) -> Column:
    """A VARIANT's number as a double; null where it is anything else, or not finite."""
    n = F.when(F.schema_of_variant(x).rlike("^(DOUBLE|FLOAT|DECIMAL|[A-Z]*INT)"), F.try_variant_get(x, "$", "double"))
    return F.when(F.abs(n) < float("inf"), n)


def tag_samples(cache: DataFrame, dimensions: int) -> DataFrame:
    """tag, v: unit vectors of a cache's JSON {tag: [[...]]} (column samples), each part judged by itself.

    Components that aren't finite numbers are 0, vectors of another size (0: any) and what is no vector don't count, nor do tags without a list; text that is no JSON object holds none.
    """
    tags = cache.select(F.explode(F.try_variant_get(F.try_parse_json("samples"), "$", "map<string,variant>")).alias("tag", "vs"))
    vectors = tags.select("tag", F.explode(F.try_variant_get("vs", "$", "array<variant>")).alias("v")).select("tag", F.try_variant_get("v", "$", "array<variant>").alias("v"))
    rows = vectors.where(F.col("v").isNotNull() if dimensions <= 0 else F.size("v") == dimensions)
    return rows.select("tag", normalized(F.transform("v", lambda x: F.coalesce(_number(x), F.lit(0.0)))).alias("v"))


def sample_counts(x: Column) -> Column:
    """A JSON {tag: number} as whole numbers, 0 at least; what isn't a finite number is left out, text that is no JSON object has none (null)."""
    numbers = F.transform_values(F.try_variant_get(F.try_parse_json(x), "$", "map<string,variant>"), lambda _, n: _number(n))
    return F.transform_values(F.map_filter(numbers, lambda _, n: n.isNotNull()), lambda _, n: F.greatest(F.lit(0), F.floor(n)))


def bulk_accounts(lists: DataFrame) -> DataFrame:
    """account, note of the lines "handle,note" or "handle note" of `lists` (list_id, text): the first line of a handle counts; a blank note is null."""
    lines = lists.select("list_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).withColumn("line", strip(F.col("line"))).where("line <> ''")
    comma = F.contains("line", F.lit(","))
    part = [F.when(comma, F.regexp_extract("line", r"^([^,]*),(.*)$", i)).otherwise(F.regexp_extract("line", r"^(\S*)\s*(.*)$", i)) for i in (1, 2)]
    parts = lines.select(F.struct("list_id", "pos").alias("at"), screen_name(part[0]).alias("account"), F.nullif(strip(part[1]), F.lit("")).alias("note"))
    return keep_first(parts.where("account <> ''"), "account", "at").drop("at")
