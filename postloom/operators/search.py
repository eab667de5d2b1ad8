"""The search language: `;` parts alternatives, `,` parts terms that must all match."""

from __future__ import annotations

import re
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: The columns that a term is looked for in.
FIELDS = ["text", "summary", "suggestions", "verdict"]


def terms(query: str) -> list[list[str]]:
    return [g for g in ([t.strip() for t in group.split(",") if t.strip()] for group in query.split(";")) if g]


#: Where a term names a post: an address, the whole term, digits on their own.
_IDS = [r"(?i)status(?:es)?/([0-9]{10,})", r"^([0-9]{10,})$", r"\b([0-9]{10,})\b"]


def post_id(term: str) -> str | None:
    """The id of a post that a term names."""
    return next((m[1] for pattern in _IDS if (m := re.search(pattern, term.strip(), re.ASCII))), None)


def window(query: str | None, vector_query: str | None, start: str | None, end: str | None, now: datetime) -> tuple[str | None, str | None]:
    """The range of times of a search: the one given; without one the last 24 hours, unless nothing is looked for or a term names a post."""
    named = any(post_id(t) for g in terms(query or "") for t in g)
    if start or end or named or not (query or (vector_query or "").strip()):
        return start, end
    return tuple(t.strftime("%Y-%m-%d %H:%M:%S") for t in (now - timedelta(hours=24), now))


def matches(query: str, fields: list[Column], tags: Column, id_: Column | None = None, url: Column | None = None) -> Column:
    """Literal substrings of any field in any case, or a whole tag; a term that names a post also matches it by id or address.  Nulls don't match."""

    def one(term: str) -> Column:
        hits = [F.contains(F.lower(f), F.lit(term.lower())) for f in fields] + [F.array_contains(tags, term)]
        if named := post_id(term):
            hits += [id_.cast("string") == named] if id_ is not None else []
            hits += [F.contains(url, F.lit(named))] if url is not None else []
        return reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits])

    groups = [reduce(lambda a, b: a & b, map(one, g)) for g in terms(query)]
    return reduce(lambda a, b: a | b, groups) if groups else F.lit(True)


def search(posts: DataFrame, query: str) -> DataFrame:
    known = {c: F.col(c) for c in ("post_id", "url") if c in posts.columns}
    return posts.where(matches(query, [F.col(c) for c in FIELDS], F.col("tags"), known.get("post_id"), known.get("url")))


def order(mode: str) -> list[Column]:
    """newest, oldest, or priority: by importance, nulls last, then newest."""
    return {"newest": [F.desc("posted_at"), F.asc("post_id")], "oldest": [F.asc("posted_at"), F.asc("post_id")], "priority": priority()}[mode]


def page_of(posts: DataFrame, order_: list[Column], number: int, size: int, total: bool = True) -> tuple[DataFrame, int | None, bool]:
    """A page's rows, how many rows there are in all (None where that isn't asked for), and whether more follow.

    number is 1 at least and size 1 to 50, else the nearest of these.  Without the total one row beyond the page is looked at.
    """
    number, size = max(1, number), max(1, min(50, size))
    rows = posts.orderBy(*order_).offset((number - 1) * size)
    if not total:
        ahead = rows.limit(size + 1).count()
        return rows.limit(size), None, ahead > size
    n = posts.count()
    return rows.limit(size), n, number * size < n


def page(posts: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    if number < 1 or not 1 <= size <= 50:
        raise ValueError("number starts at 1, size is 1 to 50")
    return posts.orderBy(*order).offset((number - 1) * size).limit(size)


def priority() -> list[Column]:
    return [F.col("importance").desc_nulls_last(), F.desc("posted_at"), F.asc("post_id")]
