"""What a report's outline, a JSON text, holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import strip

_CLUSTER = "struct<size int, peakImportance double, representative struct<tweetId string, summary string>, memberTweetIds array<string>, tags array<string>>"
_ITEM = "struct<tweetId string, summary string, importance double, tags array<string>>"
#: The fields of an outline.
OUTLINE = f"mode string, sections array<struct<title string, tag string, clusters array<{_CLUSTER}>, items array<{_ITEM}>, tweets array<string>>>"


def read(outline: Column) -> Column:
    """The parsed outline; null if it isn't one."""
    return F.from_json(outline, OUTLINE)


def _each(values: Column, fn) -> Column:
    """fn's lists for each value, one after the other; nulls hold none."""
    empty = F.array().cast("array<string>")
    return F.flatten(F.transform(F.coalesce(values, F.array()), lambda x: F.coalesce(fn(x), empty)))


def post_ids(outline: Column, members: bool = False) -> Column:
    """The ids an outline names, each once and in order: of clusters the representative's (and the members'), else the items' and those in its texts."""
    parsed = read(outline)

    def of_cluster(c: Column) -> Column:
        own = F.array(c["representative"]["tweetId"])
        return F.concat(own, F.coalesce(c["memberTweetIds"], F.array().cast("array<string>"))) if members else own

    def of_items(s: Column) -> Column:
        items = F.coalesce(F.transform(s["items"], lambda i: i["tweetId"]), F.array().cast("array<string>"))
        return F.concat(items, _each(s["tweets"], lambda t: F.regexp_extract_all(t, F.lit(r"([0-9]{10,})"), F.lit(1))))

    clustered = _each(parsed["sections"], lambda s: _each(s["clusters"], of_cluster))
    ids = F.when(parsed["mode"] == "clustered", clustered).otherwise(_each(parsed["sections"], of_items))
    return F.array_distinct(F.filter(F.transform(ids, strip), lambda x: x != ""))


def high_entries(reports: DataFrame, least: int = 4) -> DataFrame:
    """report, section, pos, post_id, category, text: clusters, or items, of an outline (reports has report and outline) whose importance is least or more and whose summary isn't blank."""
    sections = reports.select("report", read(F.col("outline")).alias("o")).select("report", F.col("o.mode").alias("mode"), F.posexplode("o.sections").alias("section", "s"))
    clusters = sections.where("mode = 'clustered'").select("report", "section", "s", F.posexplode("s.clusters").alias("pos", "x")).selectExpr("report", "section", "pos", "x.representative.tweetId AS post_id", "s.title AS category", "x.representative.summary AS text", "x.peakImportance AS score")
    items = sections.where("mode IS DISTINCT FROM 'clustered'").select("report", "section", "s", F.posexplode("s.items").alias("pos", "x")).selectExpr("report", "section", "pos", "x.tweetId AS post_id", "s.title AS category", "x.summary AS text", "x.importance AS score")
    rows = clusters.unionByName(items).withColumn("text", strip(F.col("text")))
    rows = rows.withColumn("category", F.coalesce(F.nullif(strip(F.col("category")), F.lit("")), F.lit("其他")))
    return rows.where((F.col("score") >= least) & (F.col("text") != "")).drop("score")


def tag_counts(reports: DataFrame) -> DataFrame:
    """report, tag, posts: a cluster counts with its size for its section's tag and for its other tags, an item once for each of its tags."""
    sections = reports.select("report", read(F.col("outline")).alias("o")).select("report", F.col("o.mode").alias("mode"), F.explode("o.sections").alias("s"))
    own = F.coalesce(strip(F.col("s.tag")), F.lit(""))
    clusters = sections.where("mode = 'clustered'").select("report", own.alias("own"), F.explode("s.clusters").alias("x"))
    others = F.filter(F.transform(F.coalesce("x.tags", F.array().cast("array<string>")), strip), lambda t: t != F.col("own"))
    of_clusters = clusters.select("report", F.explode(F.concat(F.array("own"), others)).alias("tag"), F.col("x.size").alias("n"))
    items = sections.where("mode IS DISTINCT FROM 'clustered'").select("report", F.explode("s.items").alias("x"))
    of_items = items.select("report", F.explode("x.tags").alias("tag")).select("report", strip(F.col("tag")).alias("tag"), F.lit(1).alias("n"))
    return of_clusters.unionByName(of_items).where("tag <> '' AND n > 0").groupBy("report", "tag").agg(F.sum("n").alias("posts"))


def tag_set(reports: DataFrame) -> DataFrame:
    """report, tags: the tags that an outline names, of sections, clusters or items, each once and sorted."""
    parsed = reports.select("report", read(F.col("outline")).alias("o"))
    empty = F.array().cast("array<string>")
    clustered = _each(F.col("o.sections"), lambda s: F.concat(F.array(F.coalesce(s["tag"], F.lit(""))), _each(s["clusters"], lambda c: F.coalesce(c["tags"], empty))))
    items = _each(F.col("o.sections"), lambda s: _each(s["items"], lambda i: F.coalesce(i["tags"], empty)))
    named = F.when(F.col("o.mode") == "clustered", clustered).otherwise(items)
    return parsed.select("report", F.array_sort(F.array_distinct(F.filter(F.transform(named, strip), lambda t: t != ""))).alias("tags"))
