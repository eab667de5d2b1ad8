"""Written reports as items and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom.functions.text import bullet, filter_tags, strip, summary_text
from postloom.operators.outlines import post_ids, read

#: A line that is an item of a list.
ITEM = r"^\s*(?:[-*]|[0-9]+\.)\s+"
RANGE = "时间范围："


def _lines(reports: DataFrame) -> DataFrame:
    """report, pos, raw, line of the lines that aren't blank, with the headline and range of the whole report."""
    lines = reports.where("markdown is not null").select("report", F.posexplode(F.split("markdown", r"\r?\n")).alias("pos", "raw")).withColumn("line", strip(F.col("raw")))
    headline = F.when(F.startswith("line", F.lit("# ")), F.regexp_replace("line", r"^#\s+", ""))
    quoted = F.when(F.startswith("line", F.lit("> ")), F.regexp_replace("line", r"^>\s*", ""))
    whole = Window.partitionBy("report")
    for name, x in (("headline", headline), ("time_range", F.when(F.startswith(quoted, F.lit(RANGE)), quoted))):
        lines = lines.withColumn(name, F.coalesce(F.max_by(x, F.when(x.isNotNull(), F.col("pos"))).over(whole), F.lit("")))
    return lines.where("line <> ''")


def entries(reports: DataFrame, titles: list[str]) -> DataFrame:
    """report, pos, headline, time_range, category, text of the list items below the second-level headings in titles.

    reports has report and markdown.  An item's category is the nearest heading of level two or three above it.  A null
    markdown has no items.  A report is one row, so the window of its lines is no larger than that.
    """
    before = Window.partitionBy("report").orderBy("pos")
    level, title = F.length(F.regexp_extract("line", r"^(#{2,3})\s", 1)), F.regexp_replace("line", r"^#{2,3}\s+", "")
    found = _lines(reports).withColumn("level", level).withColumn("title", title)
    found = found.withColumn("section", F.last(F.when(F.col("level") == 2, F.col("title")), ignorenulls=True).over(before))
    found = found.withColumn("category", F.last(F.when(F.col("level") > 0, F.col("title")), ignorenulls=True).over(before))
    items = found.where(F.col("raw").rlike(ITEM) & F.col("section").isin(titles)).withColumn("text", strip(F.regexp_replace("raw", ITEM, "")))
    return items.where("text <> ''").select("report", "pos", "headline", "time_range", "category", summary_text(F.col("text")).alias("text"))


def messages(reports: DataFrame, titles: list[str], size: int = 5) -> DataFrame:
    """report, n (from 1), message: the items of each category, `size` a message; a report without items is one message, a blank one none."""
    group = Window.partitionBy("report", "category")
    placed = entries(reports, titles).withColumn("first", F.min("pos").over(group)).withColumn("chunk", F.floor((F.row_number().over(group.orderBy("pos")) - 1) / size))
    parts = placed.groupBy("report", "first", "chunk", "headline", "time_range", "category").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("items"))
    body = F.array_join(F.transform("items", lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["text"])), "\n\n")
    head = F.concat_ws("\n", F.nullif("headline", F.lit("")), F.nullif("time_range", F.lit("")), F.concat(F.lit("Category: "), F.col("category")))
    n = F.row_number().over(Window.partitionBy("report").orderBy("first", "chunk"))
    made = parts.select("report", n.alias("n"), strip(F.concat(head, F.lit("\n\n"), body)).alias("message"))
    plain = reports.select("report", F.lit(1).alias("n"), strip(F.col("markdown")).alias("message")).where("message <> ''")
    return made.unionByName(plain.join(made.select("report"), "report", "left_anti"))


def digest_items(digest: Column) -> Column:
    """The strings of the list `bullets` of a JSON text, fenced or not, whatever else the list holds; of other text its lines that aren't blank.  Null is null."""
    text = strip(digest)
    json = F.coalesce(F.nullif(F.regexp_extract(text, r"(?is)```json\s*(.*?)```", 1), F.lit("")), text)
    items = F.try_variant_get(F.try_parse_json(json), "$.bullets", "array<variant>")
    read = F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string"))
    parsed = F.when(text.rlike(r"(?i)^(\{|\[|```json)"), read)
    return F.filter(F.transform(F.coalesce(parsed, F.split(text, r"\r?\n")), strip), lambda x: x != "")


def bullets(given: DataFrame, sources: DataFrame, target: int | None = None) -> DataFrame:
    """report, pos, bullet: the different bullets of `given` in their order, then those of `sources` as long as there are fewer than target.

    Both have report, pos and text.  Without a target, all given bullets stay, and sources count only for a report that
    has none: its first eight.
    """
    rows = given.select("report", F.lit(0).alias("late"), "pos", bullet(F.col("text")).alias("bullet"))
    rows = rows.unionByName(sources.select("report", F.lit(1).alias("late"), "pos", bullet(F.col("text")).alias("bullet"))).where("bullet <> ''")
    once = rows.groupBy("report", "bullet").agg(F.min(F.struct("late", "pos")).alias("at"))
    if target is None:
        own = F.min("at.late").over(Window.partitionBy("report"))
        once = once.withColumn("own", own).where(F.col("at.late") == F.col("own"))
    placed = once.withColumn("n", F.row_number().over(Window.partitionBy("report").orderBy("at", "bullet")))
    few = F.col("n") <= target if target is not None else (F.col("own") == 0) | (F.col("n") <= 8)
    return placed.where(few).select("report", (F.col("n") - 1).alias("pos"), "bullet")


def allocate(groups: DataFrame, total: int) -> DataFrame:
    """report, pos, share: `total` items shared among a report's groups (report, pos, n) in proportion to n.

    Each gets the whole part of its proportion, and one at least.  What is too much is taken from the highest shares, unit by unit;
    what is left goes to the largest fractions.  Ties go to the first.  A total of 0 or less gives no rows.
    """
    one = Window.partitionBy("report")
    rows = groups.where(F.lit(total > 0)).withColumn("exact", F.coalesce(F.try_divide("n", F.sum("n").over(one)), F.lit(0.0)) * total)
    rows = rows.withColumn("base", F.greatest(F.lit(1), F.floor("exact"))).withColumn("over", F.sum("base").over(one) - total)
    units = rows.where("over > 0 and base > 1").select("report", "pos", "over", F.explode(F.sequence(F.lit(2), F.col("base"))).alias("height"))
    gone = units.withColumn("r", F.row_number().over(one.orderBy(F.desc("height"), "pos"))).where("r <= over").groupBy("report", "pos").agg(F.count("*").alias("gone"))
    more = (F.row_number().over(one.orderBy(F.desc(F.col("exact") - F.floor("exact")), "pos")) <= -F.col("over")).cast("int")
    return rows.withColumn("more", more).join(gone, ["report", "pos"], "left").select("report", "pos", (F.col("base") - F.coalesce("gone", F.lit(0)) + F.col("more")).cast("int").alias("share"))


def selected(reports: DataFrame, insights: DataFrame, tags: list[str] = (), most: int = 20) -> DataFrame:
    """report, pos, post_id, summary of the posts that a digest is written from, in the order of the report's outline.

    Of a clustered outline those are the representatives, of the sections with one of the tags; of another its posts, whose own
    tags (insights: post_id, tags, summary) then decide.  The first `most` (held within 5 to 200) stay.
    """
    most = max(5, min(most, 200))
    wanted = [t for t in dict.fromkeys(t.strip().lower() for t in tags) if t]
    wanted = ["other" if t == "others" else t for t in wanted]
    parsed = reports.select("report", "outline", read(F.col("outline")).alias("o"))
    heads = parsed.where("o.mode = 'clustered'").select("report", F.posexplode("o.sections").alias("s", "section")).select("report", "s", F.lower(strip(F.col("section.tag"))).alias("tag"), F.posexplode("section.clusters").alias("c", "x"))
    heads = heads.select("report", "tag", F.struct("s", "c").alias("at"), strip(F.col("x.representative.tweetId")).alias("post_id")).where("tag <> '' AND post_id <> ''")
    heads = heads.groupBy("report", "post_id").agg(F.min(F.struct("at", "tag")).alias("f")).select("report", "post_id", "f.at", "f.tag")
    others = parsed.join(heads.select("report"), "report", "left_anti").select("report", F.posexplode(post_ids(F.col("outline"))).alias("c", "post_id")).select("report", "post_id", F.struct(F.lit(0).alias("s"), F.col("c")).alias("at"), F.lit(None).cast("string").alias("tag"))
    if wanted:
        heads = heads.where(F.col("tag").isin(wanted))
    first = F.row_number().over(Window.partitionBy("report").orderBy("at"))
    rows = heads.unionByName(others).withColumn("r", first)
    rows = rows.where((F.col("r") <= most) | (F.lit(bool(wanted)) & F.col("tag").isNull()))
    found = rows.join(insights.select(F.col("post_id").cast("string").alias("post_id"), "tags", "summary"), "post_id")
    if wanted:
        own = F.arrays_overlap(filter_tags(F.coalesce("tags", F.array().cast("array<string>"))), F.lit(wanted))
        found = found.where(F.col("tag").isNotNull() | F.coalesce(own, F.lit(False)))
    return found.withColumn("pos", first - 1).where(F.col("pos") < most).select("report", "pos", "post_id", "summary")


def tag_targets(chosen: DataFrame, tags: list[str], total: int) -> DataFrame:
    """report, tag, posts, share: the items (report, tags) that have each of the tags, and its part of `total`; no rows for a report with one such tag or more tags than items."""
    wanted = list(dict.fromkeys(t.strip().lower() for t in tags if t.strip()))
    held = chosen.select("report", F.explode(F.array_intersect(filter_tags(F.coalesce("tags", F.array().cast("array<string>"))), F.lit(wanted))).alias("tag"))
    counts = held.groupBy("report", "tag").agg(F.count("*").alias("posts")).withColumn("pos", F.array_position(F.lit(wanted), F.col("tag")).cast("int"))
    active = F.count("*").over(Window.partitionBy("report"))
    counts = counts.withColumn("active", active).where((F.col("active") > 1) & (F.col("active") <= total))
    return counts.join(allocate(counts.select("report", "pos", F.col("posts").alias("n")), total), ["report", "pos"]).select("report", "tag", "posts", "share")
