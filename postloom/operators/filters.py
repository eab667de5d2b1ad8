"""Filters of posts as predicates of columns; what is not asked for (None, empty) lets all rows pass."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import filter_tags, screen_name

#: Reasons of a low likeness.
LOW_REASONS = ["embed-low", "embed-negative"]


def every(*conditions: Column | None) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def between(x: Column, lo=None, hi=None) -> Column:
    """Both ends belong to the range, each may be missing; nulls are out if any end is given."""
    if lo is not None and hi is not None and lo > hi:
        raise ValueError("the range's end is before its start")
    return every(x >= lo if lo is not None else None, x <= hi if hi is not None else None)


def in_time(x: Column, start: str | None = None, end: str | None = None) -> Column:
    """between() of times written as YYYY-MM-DD HH:MM:SS."""
    if start and end and start > end:
        raise ValueError("the range's end is before its start")
    at = [F.expr(f"timestamp_ntz '{t}'") if t else None for t in (start, end)]
    return every(x >= at[0] if start else None, x <= at[1] if end else None)


def not_among(x: Column, values: list) -> Column:
    """Null or none of the values."""
    return x.isNull() | ~x.isin(values)


def category(name: str) -> Column:
    """The predicate of a routing category over status and reason."""
    status, reason = F.col("status"), F.col("reason")
    known = {
        "embedding-high": status == "AUTO_HIGH",
        "embedding-low": (status == "IGNORED") & reason.isin(LOW_REASONS),
        "llm": status.isin("ROUTED", "LLM_QUEUED", "COMPLETED"),
        "ignored-other": (status == "IGNORED") & not_among(reason, LOW_REASONS),
        "pending": status == "PENDING",
    }
    return known[name]


def routed_as(flag: str, category_: str | None = None) -> Column:
    """ignored, default (all but ignored) or all; a category comes before the flag."""
    if category_:
        return category(category_)
    return {"ignored": F.col("status") == "IGNORED", "default": F.col("status") != "IGNORED", "all": F.lit(True)}[flag]


def posts(rows: DataFrame, *, account=None, tag: str | None = None, start: str | None = None, end: str | None = None, score: tuple = (None, None), importance: tuple = (None, None), flag: str = "all", category_: str | None = None) -> DataFrame:
    """Rows of routed posts (account_id, tag, posted_at, score, status, reason and, where asked for, importance)."""
    return rows.where(
        every(
            F.col("account_id") == account if account is not None else None,
            F.col("tag") == tag if tag else None,
            in_time(F.col("posted_at"), start, end),
            between(F.col("score"), *score),
            between(F.col("importance"), *importance) if importance != (None, None) else None,
            routed_as(flag, category_),
        )
    )


def among(rows: DataFrame, key: str, ids: DataFrame | Iterable) -> DataFrame:
    """Rows whose key is in a list: a few values as they are, a table by a semi join."""
    if isinstance(ids, DataFrame):
        return rows.join(ids.select(F.col(ids.columns[0]).alias(key)), key, "left_semi")
    return rows.where(F.col(key).isin(list(ids)))


def ordered_as(rows: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows whose key is in the list, with pos, its first place there (from 0)."""
    first = {k: i for i, k in reversed(list(enumerate(ids)))}
    places = rows.sparkSession.createDataFrame(list(first.items()), f"{key} {dict(rows.dtypes)[key]}, pos int")
    return rows.join(F.broadcast(places), key)


def pending(rows: DataFrame, insights: DataFrame, newest: int | None = None) -> DataFrame:
    """Pending posts that are not abandoned and have no insight; at most the newest."""
    found = rows.where((F.col("status") == "PENDING") & F.col("abandoned_at").isNull()).join(insights.select("post_id"), "post_id", "left_anti")
    return found if newest is None else found.orderBy(F.desc("posted_at"), F.desc("post_id")).limit(newest)


def _overlap(tags: Column, wanted: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(tags, F.lit(wanted)), F.lit(False))


def profile(rows: DataFrame, least: int = 2, verdicts: list[str] = (), include: list[str] = (), exclude: list[str] = (), include_authors: list[str] = (), exclude_authors: list[str] = ()) -> DataFrame:
    """Insights (importance, verdict, tags, author_tags) that a report's profile lets in.

    The least importance is held within 1 to 5, and a null importance is 0.  Tags are compared as filter_tags() makes them, a
    null list is empty; verdicts in lower case, and a null verdict passes only where none are asked for.
    """
    spec = {name: _normal(values) for name, values in (("v", verdicts), ("i", include), ("e", exclude), ("ia", include_authors), ("ea", exclude_authors))}
    empty = F.array().cast("array<string>")
    tags, authors = (filter_tags(F.coalesce(c, empty)) for c in ("tags", "author_tags"))
    return rows.where(
        every(
            F.coalesce("importance", F.lit(0)) >= max(1, min(5, int(least))),
            F.coalesce(F.lower("verdict").isin(spec["v"]), F.lit(False)) if spec["v"] else None,
            _overlap(tags, spec["i"]) if spec["i"] else None,
            ~_overlap(tags, spec["e"]) if spec["e"] else None,
            _overlap(authors, spec["ia"]) if spec["ia"] else None,
            ~_overlap(authors, spec["ea"]) if spec["ea"] else None,
        )
    )


def _normal(values: Iterable[str]) -> list[str]:
    names = [v.strip().lower() for v in values]
    return list(dict.fromkeys("other" if v == "others" else v for v in names if v))


def accounts(rows: DataFrame, query: str) -> DataFrame:
    """Accounts (handle, name) whose handle, or name, holds the query; one @ in front doesn't count, a blank query holds all."""
    needle = query.strip().lower().removeprefix("@")
    holds = [F.coalesce(F.contains(x, F.lit(needle)), F.lit(False)) for x in (screen_name(F.col("handle")), F.lower("name"))]
    return rows.where(holds[0] | holds[1]) if needle else rows


def candidates(rows: DataFrame, action: str | None = None, handle: str = "") -> DataFrame:
    """Accounts proposed for an action (all: any but none), whose handle holds a text."""
    needle = handle.strip().lower().removeprefix("@")
    wanted = F.col("action") == action if action else F.col("action") != "none"
    return rows.where(every(wanted, F.contains(screen_name(F.col("handle")), F.lit(needle)) if needle else None))


def suggestions(tags: DataFrame, typed: str, limit: int = 8) -> DataFrame:
    """Tags (tag, posts) that hold the last of the typed tags and are not among those before it, the most used first."""
    *chosen, last = [t.strip().lower() for t in typed.replace("，", ",").split(",")]
    return tags.where(every(not_among(F.col("tag"), [c for c in chosen if c]), F.contains("tag", F.lit(last)) if last else None)).orderBy(F.desc("posts"), "tag").limit(limit)


def jobs(rows: DataFrame, kind: str | None = None, status: str | None = None, limit: int = 20) -> DataFrame:
    """The newest jobs of a kind and status."""
    found = rows.where(every(F.col("kind") == kind if kind else None, F.col("status") == status if status else None))
    return found.orderBy(F.desc("created_at"), F.desc("job_id")).limit(limit)


def usable(vectors: DataFrame, size: int) -> DataFrame:
    """Rows (v, dimensions) whose vector has the size, and says so."""
    return vectors.where((F.size("v") == size) & (F.col("dimensions") == size))
