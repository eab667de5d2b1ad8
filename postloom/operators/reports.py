"""Reports: sections by key, their overview, clusters of like posts, and normalised insights."""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom.functions.text import TITLES, author_title, filter_tags, known_tag, local_minute, post_url, screen_name, strip, truncate
from postloom.operators import filters
from postloom.operators.jobs import next_window
from postloom.operators.merge import numbered


def primary_tag(wanted: list[str] = ()) -> Column:
    """The first tag that is wanted, else the first; other where that has no title."""
    names = filter_tags(F.coalesce("tags", F.array().cast("array<string>")))
    first = F.get(names, F.lit(0))
    if wanted:
        first = F.coalesce(F.get(F.filter(names, lambda t: t.isin(list(wanted))), F.lit(0)), first)
    return F.when(first.isin(list(TITLES)), first).otherwise("other")


def title(tag: Column) -> Column:
    out = F.lit(None)
    for name, shown in TITLES.items():
        out = F.when(tag == name, shown).otherwise(out)
    return F.coalesce(out, tag)


def author_key() -> Column:
    """The author's handle, else name, else the post itself."""
    parts = [F.nullif(screen_name(F.col("handle")), F.lit("")), F.nullif(F.lower(strip(F.col("name"))), F.lit("")), F.col("post_id").cast("string")]
    return F.coalesce(*parts)


def sections(posts: DataFrame, key: Column) -> DataFrame:
    """section, post_id, pos: in each section by importance, then newest first."""
    rows = posts.select(key.alias("section"), "post_id", F.coalesce("importance", F.lit(0)).alias("importance"), "posted_at")
    order = [F.desc("importance"), F.desc("posted_at"), F.asc("post_id")]
    bucket = F.struct(-F.col("importance"), F.datediff(F.lit("2100-01-01").cast("date"), "posted_at"))
    return numbered(rows, "section", order, bucket, "pos").select("section", "post_id", "pos")


def overview(posts: DataFrame, key: Column, top: int = 3) -> DataFrame:
    """The first sections by their highest importance, then size, then title."""
    found = posts.groupBy(key.alias("section")).agg(F.count("*").alias("posts"), F.coalesce(F.max("importance"), F.lit(0)).alias("peak"))
    return found.orderBy(F.desc("peak"), F.desc("posts"), "section").limit(top)


def normalized_insights(items: DataFrame) -> DataFrame:
    """post_id, verdict, importance, tags, summary, suggestions of scores made by a model (verdict, importance double, tags, summary, suggestions, text), which cannot be trusted.

    Unknown verdicts are ignore; importance is rounded half up into 1..5 (NaN: null); an actionable post without
    suggestions is to watch, with an importance of 3 at most; unknown tags are other.
    """
    low = F.lower(F.trim("verdict"))
    verdict = F.when(low.isin("ignore", "watch", "actionable"), low).otherwise("ignore")
    score = F.when(F.isnan("importance"), None).otherwise(F.least(F.lit(5), F.greatest(F.lit(1), F.floor(F.col("importance") + 0.5)))).cast("int")
    suggestions = F.nullif(truncate(F.col("suggestions"), 180), F.lit(""))
    demoted = (verdict == "actionable") & suggestions.isNull()
    return items.select(
        "post_id",
        F.when(demoted, "watch").otherwise(verdict).alias("verdict"),
        F.when(demoted, F.least(score, F.lit(3))).otherwise(score).alias("importance"),
        F.array_distinct(F.transform("tags", known_tag)).alias("tags"),
        F.coalesce(F.nullif(truncate(F.col("summary"), 120), F.lit("")), truncate(F.col("text"), 120)).alias("summary"),
        suggestions.alias("suggestions"),
    )


def filled(posts: DataFrame, insights: DataFrame) -> DataFrame:
    """Insights of all posts; those that the model left out are to watch, of importance 2, tagged other, with their text as summary."""
    known = insights.withColumn("known", F.lit(True))
    found = posts.select("post_id", "text").join(known, "post_id", "left")
    own = lambda c, other: F.when(F.col("known"), F.col(c)).otherwise(other).alias(c)
    return found.select("post_id", own("verdict", F.lit("watch")), own("importance", F.lit(2)), own("tags", F.array(F.lit("other"))), own("summary", truncate(F.col("text"), 120)), own("suggestions", F.lit(None)))


def _instant(posts: DataFrame) -> Column:
    """posted_at as a whole number."""
    if dict(posts.dtypes)["posted_at"].startswith("timestamp"):
        return F.expr("timestampdiff(MICROSECOND, timestamp_ntz '1970-01-01 00:00:00', cast(posted_at AS timestamp_ntz))")
    return F.col("posted_at").cast("long")


class Clusters:
    """The clusters of one report, grown post by post."""

    def __init__(self, threshold: float, bump: float) -> None:
        self.need, self.need_across, self.seen = threshold, min(0.98, threshold + bump), 0
        self.tried = self.all = 0  #: pairs of post and cluster that were compared, and that there were
        self.sums, self.units = np.zeros((16, 0)), np.zeros((16, 0))
        self.found: list[dict] = []

    def _unit(self, v) -> np.ndarray:
        vector = np.asarray(v, float)
        norm = np.sqrt(vector @ vector)
        return vector / norm if norm > 0 and np.isfinite(norm) else np.zeros_like(vector)

    def look(self, rows: list) -> None:
        """Multiplies the next posts with the centroids as they are, as one block; add() then takes these posts in order."""
        self.block = [self._unit(r.v) for r in rows]
        if not self.found:
            self.sums, self.units = (np.zeros((16, len(self.block[0]))) for _ in range(2))
        n = len(self.found)
        self.at, self.near, self.moved = 0, self.units[:n] @ np.array(self.block).T, np.zeros(n)

    def room(self) -> int:
        """How many posts to look at together: products of some 32 MB."""
        return max(1, min(512, 4_000_000 // max(1, len(self.found))))

    def add(self, row) -> None:
        """The post joins, of the clusters near enough, the nearest, or founds one.

        A unit vector's product with a centroid is at most that of the block and how far the centroid has moved since; only clusters
        where that reaches the lower threshold are tried, and those founded since.
        """
        self.seen += 1
        tags = list(row.tags)
        names = [t.strip().lower() for t in tags]
        primary = next((t for t in names if t), "other")
        unit, n = self.block[self.at], len(self.found)
        likely = np.flatnonzero(self.near[:, self.at] + self.moved >= min(self.need, self.need_across) - 1e-9)
        likely = np.concatenate([likely, np.arange(len(self.moved), n)])
        self.at += 1
        self.tried += len(likely)
        self.all += n
        scores = self.units[likely] @ unit
        mine = {t for t in names if t}
        needs = np.array([self.need if primary == (c := self.found[k])["primary"] or mine & c["names"] else self.need_across for k in likely.tolist()])
        fit = np.flatnonzero(scores >= needs) if len(likely) else []
        if len(fit):
            at = int(likely[fit[np.argmax(scores[fit])]])
        else:
            at = n
            if n == len(self.sums):
                self.sums, self.units = (np.concatenate([x, np.zeros_like(x)]) for x in (self.sums, self.units))
            self.found.append({"cluster": f"c{self.seen}", "primary": primary, "counts": Counter(), "members": [], "tags": tags, "best": (row.importance, row.posted_at), "representative": row.post_id})
        c = self.found[at]
        c["members"].append(row.post_id)
        c["counts"].update(t for t in names if t)
        if (row.importance, row.posted_at) > c["best"]:
            c["best"], c["representative"] = (row.importance, row.posted_at), row.post_id
        if len(c["members"]) > 1:  # a founder's tags stand as they are; Counter keeps the order of ties
            c["tags"] = [t for t, _ in c["counts"].most_common(5)]
        c["names"] = {t.strip().lower() for t in c["tags"]} - {""}
        self.sums[at] += unit
        size = np.sqrt(self.sums[at] @ self.sums[at])
        old = self.units[at].copy()
        self.units[at] = self.sums[at] / size if size > 0 else 0
        if at < len(self.moved):
            self.moved[at] += np.sqrt(((self.units[at] - old) ** 2).sum())

    def ranked(self) -> list[dict]:
        """By highest importance, size and time of the representative."""
        return sorted(self.found, key=lambda c: (c["best"][0], len(c["members"]), c["best"][1]), reverse=True)


def clusters(posts: DataFrame, threshold: float = 0.86, bump: float = 0.05) -> DataFrame:
    """report, pos, cluster, size, peak, tags, representative, members of each report's posts (report, post_id, importance, posted_at, tags, v).

    From the most important and newest on, a post joins the nearest cluster that it is near enough to (nearer, where they have
    no tag in common) or founds one; a cluster's tags are the five most frequent of its posts.  A null importance is 0.

    The choice depends on all posts before, so a report, the posts of a window of time, is worked off in order by one task: as a
    stream of sorted rows, of which the clusters stay in memory.  Reports are separate.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(report, state: Clusters) -> pd.DataFrame:
            rows = state.ranked()
            return pd.DataFrame({
                "report": [report] * len(rows), "pos": range(len(rows)), "cluster": [c["cluster"] for c in rows], "size": [len(c["members"]) for c in rows], "peak": [c["best"][0] for c in rows],
                "tags": [c["tags"] for c in rows], "representative": [c["representative"] for c in rows], "members": [c["members"] for c in rows],
            })

        report, state = None, None
        for batch in batches:
            rows, i = list(batch.itertuples(index=False)), 0
            while i < len(rows):
                if state is None or rows[i].report != report:
                    if state is not None:
                        yield done(report, state)
                    report, state = rows[i].report, Clusters(threshold, bump)
                some = list(itertools.takewhile(lambda r: r.report == report, rows[i : i + state.room()]))
                state.look(some)
                for row in some:
                    state.add(row)
                i += len(some)
        if state is not None:
            yield done(report, state)

    rows = posts.where("report is not null and v is not null").select("report", "post_id", F.coalesce("importance", F.lit(0)).cast("int").alias("importance"), _instant(posts).alias("posted_at"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "v")
    ordered = rows.repartition("report").sortWithinPartitions("report", F.desc("importance"), F.desc("posted_at"), "post_id")
    kinds = dict(rows.dtypes)
    return ordered.mapInPandas(run, f"report {kinds['report']}, pos int, cluster string, size int, peak int, tags array<string>, representative {kinds['post_id']}, members array<{kinds['post_id']}>")


def stratified(posts: DataFrame, stratum: Column, limit: int, seed: int = 17) -> DataFrame:
    """A sample of `limit` posts over all strata, the same for the same seed; see quotas() for how many each gets.

    Strata are languages by lengths, a few; so their sizes are collected, and never their posts.
    """
    rows = posts.select("post_id", stratum.alias("stratum")).where("stratum is not null")
    sizes = {r["stratum"]: r["count"] for r in sorted(rows.groupBy("stratum").count().collect())}
    quota = quotas(sizes, limit)
    spark = posts.sparkSession
    each = spark.createDataFrame(list(quota.items()), "stratum string, quota long")
    # hash values up to a bound that holds the quota and more are ranked, the others can't be among the first
    share = F.lit(float(1 << 63)) * F.lit(2.0)
    place = (F.xxhash64("post_id", F.lit(seed)).cast("double") + float(1 << 63)) / share
    near = rows.join(F.broadcast(spark.createDataFrame([(k, min(1.0, (3 * quota[k] + 50) / n)) for k, n in sizes.items()], "stratum string, upto double")), "stratum").withColumn("place", place)
    order = Window.partitionBy("stratum").orderBy("place", "post_id")
    ranked = near.where("place <= upto").withColumn("r", F.row_number().over(order)).join(F.broadcast(each), "stratum")
    return ranked.where("r <= quota").select("post_id", "stratum")


# reports as a whole: posts (report, post_id, importance, posted_at, verdict, tags, author_tags, summary, suggestions, text, handle, name, url) of a window each

#: Importance from which a post is always kept, that of the middle, posts of a chunk, and how many of a chunk stay.
HIGH, MIDDLE, CHUNK, KEEP = 4, (2, 3), 30, 15


def window(end: str, hours: int) -> tuple[str, str]:
    """A profile's window: up to the minute of its end, both ends included."""
    last = datetime.fromisoformat(end).replace(second=0, microsecond=0)
    return tuple(t.strftime("%Y-%m-%d %H:%M:%S") for t in (last - timedelta(hours=hours), last))


def chunked(posts: DataFrame) -> DataFrame:
    """report, post_id, chunk, pos of the posts of middle importance, by importance, then newest: what a model looks through chunk by chunk."""
    mid = posts.where(F.col("importance").between(*MIDDLE)).select("report", "post_id", "importance", "posted_at")
    order = [F.desc("importance"), F.desc("posted_at"), F.asc("post_id")]
    placed = numbered(mid, "report", order, F.struct(-F.col("importance"), F.datediff(F.lit("2100-01-01").cast("date"), "posted_at")), "pos")
    return placed.select("report", "post_id", F.floor(F.col("pos") / CHUNK).cast("int").alias("chunk"), "pos")


def triage(posts: DataFrame, decisions: DataFrame | None, keep: int = KEEP, failed: DataFrame | None = None) -> DataFrame:
    """The posts that stay: those of high importance, and of each chunk of the middle the first `keep` that the decisions include.

    decisions (report, post_id, place, include) come from a model that saw chunked().  failed (report, chunk) names the chunks that got no
    answer: they stay whole; of a chunk whose answer includes nothing, or is empty, nothing stays.  Without decisions (None), or in a report without posts of the middle or with nothing to stay, all posts stay.
    """
    if decisions is None:
        return posts
    mid = chunked(posts)
    keep = max(1, min(CHUNK, int(keep)))
    said = mid.join(decisions.select("report", "post_id", "place", "include"), ["report", "post_id"], "left")
    first = F.row_number().over(Window.partitionBy("report", "chunk").orderBy("place", "post_id"))  # a chunk at most
    chosen = said.where("include").withColumn("r", first).where(F.col("r") <= keep).select("report", "post_id")
    whole = mid.join(failed.select("report", "chunk").distinct(), ["report", "chunk"]).select("report", "post_id") if failed is not None else chosen.limit(0)
    kept = chosen.union(whole).union(posts.where(F.col("importance") >= HIGH).select("report", "post_id")).distinct()
    looked = mid.select("report").distinct().join(kept.select("report").distinct(), "report")
    # reports that weren't looked through stay whole, with their posts of high importance once
    return posts.join(kept.join(looked, "report"), ["report", "post_id"], "left_semi").unionByName(posts.join(looked, "report", "left_anti"))


def _summary() -> Column:
    return F.coalesce(F.nullif(strip(F.col("summary")), F.lit("")), truncate(F.col("text")))


def _sections(posts: DataFrame, key: Column, heading: Column) -> DataFrame:
    """report, section, title, size, peak, place, items: a report's sections in order, the items of each by importance, then newest."""
    rows = posts.select("report", key.alias("section"), heading.alias("title"), "post_id", "importance", "posted_at", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), _summary().alias("summary"), post_url(F.col("url"), F.col("handle"), F.col("post_id")).alias("url"), _instant(posts).alias("at"))
    item = F.struct((-F.coalesce("importance", F.lit(0))).alias("i"), (-F.col("at")).alias("t"), "post_id", "summary", "importance", "tags", "url")
    found = rows.groupBy("report", "section").agg(F.min_by("title", F.struct(F.col("posted_at"), "post_id")).alias("title"), F.count("*").alias("size"), F.coalesce(F.max("importance"), F.lit(0)).alias("peak"), F.array_sort(F.collect_list(item)).alias("items"))
    place = F.row_number().over(Window.partitionBy("report").orderBy(F.desc("peak"), F.desc("size"), F.collate("title", "zh"), "section"))
    return found.withColumn("place", place)


def _stars(x: Column) -> Column:
    return F.concat(x.cast("string"), F.lit("⭐"))


def _written(sections_: DataFrame, heads: DataFrame, lead: str, close: str) -> DataFrame:
    """report, headline, sections, markdown of sections and heads (report, headline, start, end)."""
    def line(x: Column) -> Column:
        stars = F.when(x["importance"] > 0, F.concat(_stars(x["importance"]), F.lit(" "))).otherwise("")
        tags = F.when(F.size(x["tags"]) > 0, F.concat(F.lit(" ["), F.array_join(x["tags"], ", "), F.lit("]"))).otherwise("")
        return F.concat(F.lit("- "), stars, x["summary"], F.lit(" ("), x["url"], F.lit(")"), tags)

    rating = F.when(F.col("peak") > 0, _stars(F.col("peak"))).otherwise("暂无评分")
    # fixed values: the sentences of a report
    about = F.concat(F.lit("共 "), F.col("size").cast("string"), F.lit(" 条洞察，最高 "), rating, F.lit("，已按重要度降序排列。"))
    body = sections_.select("report", "place", "title", "size", F.array_join(F.concat(F.array(F.concat(F.lit("### "), F.col("title")), about), F.transform("items", line)), "\n\n").alias("text"))
    whole = body.groupBy("report").agg(F.array_sort(F.collect_list(F.struct("place", "title", "size", "text"))).alias("s"), F.sum("size").cast("string").alias("n"))
    first = F.array_join(F.transform(F.slice("s", 1, 3), lambda x: F.concat(x["title"], F.lit("（"), x["size"].cast("string"), F.lit("）"))), "、")
    # fixed values: the sentences of a report
    lines = [F.concat(F.lit("# "), F.col("headline")), F.concat(F.lit("> 时间范围："), F.col("start"), F.lit(" - "), F.col("end")), F.lit("## 概览"), F.concat(F.lit(f"- {lead}："), first), F.concat(F.lit("- 本次共保留 "), F.col("n"), F.lit(f" 条洞察，{close}")), F.lit("## 重点洞察")]
    text = F.array_join(F.concat(F.array(*lines), F.transform("s", lambda x: x["text"])), "\n\n")
    return whole.join(heads, "report").select("report", "headline", F.size("s").alias("sections"), text.alias("markdown"))


def heads(posts: DataFrame, start: str, end: str, zone: str, name: str) -> DataFrame:
    """report, headline, start, end: a report's name after its end, times in the zone."""
    times = {c: local_minute(F.expr(f"timestamp_ntz '{t}'"), zone) for c, t in (("start", start), ("end", end))}
    return posts.select("report").distinct().select("report", F.concat(times["end"], F.lit(f" {name}")).alias("headline"), *[t.alias(c) for c, t in times.items()])


def tag_report(posts: DataFrame, heads_: DataFrame, wanted: list[str] = ()) -> DataFrame:
    """report, headline, sections, markdown: a section for each first tag."""
    key = primary_tag(wanted)
    # fixed values: the sentences of a report
    return _written(_sections(posts, key, title(key)), heads_, "重点分类", "均按标签与重要度排序，便于直接引用。")


def author_report(posts: DataFrame, heads_: DataFrame) -> DataFrame:
    """report, headline, sections, markdown: a section for each author."""
    # fixed values: the sentences of a report
    return _written(_sections(posts, author_key(), author_title(F.col("name"), F.col("handle"))), heads_, "热点作者", "按作者与重要度排序。")


def cluster_report(posts: DataFrame, heads_: DataFrame, wanted: list[str] = (), most: int = 0, least: int = 2, threshold: float = 0.86, bump: float = 0.05) -> DataFrame:
    """report, headline, outline, markdown: clusters of the posts that have a vector v, in sections by their representative's first tag; the first `most` clusters (0: all)."""
    found = clusters(posts, threshold, bump).withColumn("cluster", F.concat(F.lit("c"), (F.col("pos") + 1).cast("string")))
    totals = found.groupBy("report").agg(F.count("*").cast("int").alias("clusters"), F.sum("size").cast("int").alias("insights"))
    shown = found.where(F.col("pos") < most) if most else found
    about = posts.select("report", F.col("post_id").alias("representative"), primary_tag(wanted).alias("tag"), truncate(_summary(), 160).alias("summary"), "importance", "verdict", "suggestions", post_url(F.col("url"), F.col("handle"), F.col("post_id")).alias("url"))
    rows = shown.join(about, ["report", "representative"])
    one = F.struct((-F.col("peak")).alias("p"), (-F.col("size")).alias("n"), F.col("cluster").alias("id"), "size", F.col("peak").alias("peakImportance"), "tags", F.struct(F.col("representative").cast("string").alias("tweetId"), F.col("url").alias("tweetUrl"), "summary", "importance", "verdict", "suggestions").alias("representative"), F.transform("members", lambda m: m.cast("string")).alias("memberTweetIds"))
    secs = rows.groupBy("report", "tag").agg(F.array_sort(F.collect_list(one)).alias("clusters"), F.max("peak").alias("peak"), F.count("*").alias("n")).withColumn("title", title(F.col("tag")))
    place = F.row_number().over(Window.partitionBy("report").orderBy(F.desc("peak"), F.desc("n"), F.collate("title", "zh"), "tag"))
    secs = secs.withColumn("place", place).withColumn("clusters", F.transform("clusters", lambda c: c.dropFields("p", "n")))

    def line(c: Column) -> Column:
        tags = F.when(F.size(c["tags"]) > 0, F.concat(F.lit(" ["), F.array_join(F.slice(c["tags"], 1, 5), ", "), F.lit("]"))).otherwise("")
        return F.concat(F.lit("- "), c["representative"]["summary"], F.lit("（"), c["size"].cast("string"), F.lit("条 / 最高"), _stars(c["peakImportance"]), F.lit("） [推文]("), c["representative"]["tweetUrl"], F.lit(")"), tags)

    text = F.array_join(F.concat(F.array(F.concat(F.lit("\n### "), F.col("title"), F.lit("\n"))), F.transform("clusters", line)), "\n")
    whole = secs.groupBy("report").agg(F.array_sort(F.collect_list(F.struct("place", text.alias("text"), F.struct("tag", "title", "clusters").alias("s")))).alias("all"), F.sum("n").cast("int").alias("shown"))
    both = whole.join(totals, "report").join(heads_, "report")
    # fixed values: the sentences of a report
    counted = F.concat(F.lit("- 本次共 "), F.col("insights").cast("string"), F.lit(f" 条洞察（importance≥{least}），聚合为 "), F.col("clusters").cast("string"), F.lit(" 个主题簇，展示 "), F.col("shown").cast("string"), F.lit(" 个。"))
    lines = [F.concat(F.lit("# "), F.col("headline")), F.concat(F.lit("> 时间范围："), F.col("start"), F.lit(" - "), F.col("end")), F.lit(""), F.lit("## 概览"), counted, F.lit(""), F.lit("## 分类")]
    outline = F.to_json(F.struct(F.lit("clustered").alias("mode"), F.col("insights").alias("totalInsights"), F.lit(least).alias("minImportance"), F.col("clusters").alias("totalClusters"), F.col("shown").alias("shownClusters"), F.transform("all", lambda x: x["s"]).alias("sections")))
    return both.select("report", "headline", outline.alias("outline"), F.array_join(F.concat(F.array(*lines), F.transform("all", lambda x: x["text"])), "\n").alias("markdown"))


def by_title(sections_: DataFrame) -> DataFrame:
    """Sections in the order of their titles in Chinese: by sound, Han before Latin."""
    return sections_.orderBy(F.collate("title", "zh"))


def global_report(posts: DataFrame, last_end: datetime | None, now: datetime, hours: int = 6, zone: str = "UTC") -> DataFrame | None:
    """The report of the next window of all posts, see jobs.next_window(); None until the window has passed."""
    found = next_window(last_end, now, hours)
    if found is None:
        return None
    spec = {"id": 0, "name": "Report", "hours": hours, "zone": zone, "group": "cluster", "filter": {"least": MIDDLE[0]}}
    return profile_report(posts, spec, found[1].strftime("%Y-%m-%d %H:%M:%S"))


def profile_report(posts: DataFrame, profile: dict, end: str, done: DataFrame | None = None, decisions: DataFrame | None = None) -> DataFrame:
    """report, headline, markdown of a profile (id, name, hours, zone, group: tag, author or cluster, filter: see filters.profile()) for the window that ends there.

    A window that is among the done (profile, period_end) gives none; without usable vectors clusters fall back to tags.
    """
    start, last = window(end, profile.get("hours", 24))
    if done is not None and not done.where((F.col("profile") == profile["id"]) & (F.col("period_end") == F.expr(f"timestamp_ntz '{last}'"))).isEmpty():
        posts = posts.limit(0)
    rows = posts.where(filters.in_time(F.col("posted_at"), start, last) & (F.col("verdict") != "ignore")).withColumn("report", F.lit(profile["id"]))
    spec = profile.get("filter", {})
    rows = triage(filters.profile(rows, **spec), decisions)
    head = heads(rows, start, last, profile.get("zone", "UTC"), profile["name"])
    group = profile.get("group", "cluster")
    if group == "author":
        return author_report(rows, head).select("report", "headline", "markdown")
    if group == "cluster" and "v" in rows.columns and not rows.where("v is not null").isEmpty():
        return cluster_report(rows, head, spec.get("include", ()), least=spec.get("least", 2)).select("report", "headline", "markdown")
    return tag_report(rows, head, spec.get("include", ())).select("report", "headline", "markdown")


def quotas(sizes: dict[str, int], limit: int) -> dict[str, int]:
    """Posts to take of each stratum: one each where the limit allows, the rest in proportion to what is left, the largest remainders first."""
    out = {k: int(n > 0 and limit >= len(sizes)) for k, n in sizes.items()}
    while (free := limit - sum(out.values())) > 0 and (left := sum(sizes.values()) - sum(out.values())) > 0:
        shares = {k: free * (n - out[k]) / left for k, n in sizes.items()}
        more = {k: min(sizes[k] - out[k], int(x)) for k, x in shares.items()}
        if not any(more.values()):
            best = max((k for k in sizes if out[k] < sizes[k]), key=lambda k: shares[k])
            more = {best: 1}
        for k, n in more.items():
            out[k] += n
    return out


#: The report profile that there is without any other of its name.
DEFAULT_PROFILE = {"name": "默认日报", "cron": "0 9 * * *", "hours": 24, "timezone": "Asia/Shanghai", "least": 2, "group": "cluster", "triage": True}


def with_default(profiles: DataFrame) -> DataFrame:
    """The profiles (the columns of DEFAULT_PROFILE, and others, which are null), and the default one where none has its name."""
    own = profiles.sparkSession.createDataFrame([tuple(DEFAULT_PROFILE.values())], "name string, cron string, hours int, timezone string, least int, `group` string, triage boolean")
    new = own.join(profiles.select("name"), "name", "left_anti")
    return profiles.unionByName(new, allowMissingColumns=True)
