"""Posts scored by a model in batches: retries with growing pauses, and batches halved until what the model refuses is alone."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.reports import filled, normalized_insights

#: Calls of a batch, and seconds of pause after the first (twice as many after the second).
TRIES, PAUSE = 3, 1.5
#: Why a batch is given up.
RISK, TRIED = "content-risk", "max-retries"
_RISKY = "content exists risk"
_SCORED = "post_id long, outcome string, reason string, calls int, verdict string, importance double, tags array<string>, summary string, suggestions string, text string"


class Model(Protocol):
    def score(self, posts: list[dict[str, Any]], tag: str | None) -> list[dict[str, Any]]:
        """post_id, verdict, importance, tags, summary, suggestions of some of the posts (post_id, text); raises where the call fails."""


def answered(model: Model, posts: list[dict[str, Any]], tag: str | None, tries: int, pause: float, halve: bool, sleep: Callable[[float], None]) -> Iterator[tuple[dict[str, Any], dict[str, Any] | None, str | None, int]]:
    """For each post its answer, or None, why it is given up, or None, and how many calls its last batch took."""
    reason, calls, items = TRIED, 0, None
    while items is None and calls < tries:
        calls += 1
        try:
            items = {i["post_id"]: i for i in model.score(posts, tag) if isinstance(i, dict) and i.get("post_id") is not None}
        except Exception as e:  # whatever a provider raises is a failed call
            if _RISKY in str(e).lower():
                reason = RISK
                break
            if calls < tries:
                sleep(pause * calls)
    if items is not None:
        for p in posts:
            yield p, items.get(p["post_id"]), None, calls
    elif halve and reason == RISK and len(posts) > 1:
        middle = len(posts) // 2
        for part in (posts[:middle], posts[middle:]):
            yield from answered(model, part, tag, tries, pause, halve, sleep)
    else:
        for p in posts:
            yield p, None, reason, calls


def _text(x: Any) -> str | None:
    return x if isinstance(x, str) else None


def _number(x: Any) -> float | None:
    try:
        return None if isinstance(x, bool) else float(x)
    except (TypeError, ValueError):
        return None


def scored(posts: DataFrame, model: Model, tries: int = TRIES, pause: float = PAUSE, halve: bool = True, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """post_id, outcome, reason, calls and the model's answer, once for each row of posts (post_id, tag, batch, text; see classification.batches()).

    outcome: scored, filled (the answer left the post out) or abandoned (reason: content-risk or max-retries).  A batch is one group of its own,
    of a few rows, and one call.  With halve, a batch that is refused for its content is cut until the refused post is alone; without it the whole batch is abandoned.
    Answers are what a model made: fields of other types are null.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tag = key[1] if isinstance(key[1], str) else None
        given = [{"post_id": int(p), "text": t} for p, t in zip(rows["post_id"], rows["text"], strict=True)]
        out = []
        for post, item, reason, calls in answered(model, sorted(given, key=lambda p: p["post_id"]), tag, tries, pause, halve, sleep):
            outcome, item = ("abandoned", {}) if reason else ("scored", item) if item is not None else ("filled", {})
            tags = item.get("tags")
            tags = [t for t in tags if isinstance(t, str)] if isinstance(tags, list) else None
            out.append((post["post_id"], outcome, reason, calls, _text(item.get("verdict")), _number(item.get("importance")), tags, _text(item.get("summary")), _text(item.get("suggestions")), post["text"]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _SCORED.split(", ")])

    rows = posts.select(F.col("post_id").cast("long").alias("post_id"), "tag", "batch", "text")
    return rows.groupBy("batch", "tag").applyInPandas(run, _SCORED)


def insights(found: DataFrame) -> DataFrame:
    """The insights of scored(): of what is scored normalised, of what is filled the default; abandoned posts have none."""
    answers = normalized_insights(found.where("outcome = 'scored'").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))))
    return filled(found.where("outcome <> 'abandoned'"), answers)


def given_up(found: DataFrame) -> DataFrame:
    """post_id and reason of the posts to abandon."""
    return found.where("outcome = 'abandoned'").select("post_id", "reason")


class LengthModel:
    """A model without a network: posts are worth watching by their length; it leaves out every `skips`-th id and refuses calls that hold a `refuses`-th."""

    def __init__(self, skips: int, refuses: int) -> None:
        self.skips, self.refuses = skips, refuses

    def score(self, posts: list[dict[str, Any]], tag: str | None) -> list[dict[str, Any]]:
        if any(p["post_id"] % self.refuses == 0 for p in posts):
            raise RuntimeError("Content Exists Risk")
        return [{"post_id": p["post_id"], "verdict": "watch", "importance": 1 + len(p["text"] or "") % 5, "tags": [tag], "summary": ""} for p in posts if p["post_id"] % self.skips]
