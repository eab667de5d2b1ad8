"""Scoring in batches against a model that fails on chosen rows."""

import collections
import sys

import pytest
from pyspark import cloudpickle

from postloom.operators import scoring

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers can't import a test

LOG: list = []


class Stub:
    """Refuses some posts, is busy on some calls, leaves some out, and answers others oddly."""

    def __init__(self, risky, busy, left_out):
        self.risky, self.busy, self.left_out, self.calls = set(risky), busy, set(left_out), 0

    def score(self, posts, tag):
        self.calls += 1
        if self.risky & {p["post_id"] for p in posts}:
            raise RuntimeError("400 Content Exists Risk")
        if self.calls <= self.busy:
            raise RuntimeError("503 too busy")
        odd = [None, "text", {"verdict": "watch"}, {"post_id": 10**6}]
        return odd + [{"post_id": p["post_id"], "verdict": "WATCH ", "importance": "4", "tags": [tag, 7], "summary": 5} for p in posts if p["post_id"] not in self.left_out]


@pytest.mark.parametrize("risky", [[], [3], [0, 9], list(range(10))])
def test_a_refused_batch_is_halved(risky):
    posts = [{"post_id": i, "text": "x"} for i in range(10)]
    found = list(scoring.answered(Stub(risky, 0, [5]), posts, "macro", 3, 1.5, True, LOG.append))
    assert [p["post_id"] for p, *_ in found] == list(range(10))
    assert {p["post_id"] for p, _, why, _ in found if why} == set(risky) and all(why in (None, "content-risk") for _, _, why, _ in found)
    assert {p["post_id"] for p, item, why, _ in found if item is None and not why} == {5} - set(risky)


def test_pauses_and_last_try():
    posts = [{"post_id": i, "text": "x"} for i in range(4)]
    pauses: list = []
    found = list(scoring.answered(Stub([], 2, []), posts, None, 3, 1.5, True, pauses.append))
    assert pauses == [1.5, 3.0] and all(item for _, item, _, _ in found) and {n for *_, n in found} == {3}
    pauses = []
    found = list(scoring.answered(Stub([], 9, []), posts, None, 3, 1.5, True, pauses.append))
    assert pauses == [1.5, 3.0] and {why for _, _, why, _ in found} == {"max-retries"}
    # without halving the whole batch goes
    found = list(scoring.answered(Stub([2], 0, []), posts, None, 3, 1.5, False, pauses.append))
    assert [why for _, _, why, _ in found] == ["content-risk"] * 4


def test_every_row_once(spark):
    rows = [(i, ["macro", "tech", None][i % 3], (i // 30) * 3 + i % 3, f"text {i}" if i % 4 else None) for i in range(200)]
    posts = spark.createDataFrame(rows, "post_id long, tag string, batch int, text string").repartition(3)
    found = scoring.scored(posts, Stub([7, 100], 0, [5, 6]), pause=0.0)
    got = {r["post_id"]: r for r in found.collect()}
    assert collections.Counter(r["outcome"] for r in got.values()) == {"scored": 196, "filled": 2, "abandoned": 2} and len(got) == 200
    assert {i for i, r in got.items() if r["outcome"] == "abandoned"} == {7, 100} and {i for i, r in got.items() if r["outcome"] == "filled"} == {5, 6}
    assert got[8]["importance"] == 4.0 and got[8]["summary"] is None and got[6]["verdict"] is None
    made = {r["post_id"]: r for r in scoring.insights(found).collect()}
    assert set(made) == set(range(200)) - {7, 100}
    assert (made[9]["verdict"], made[9]["importance"], made[9]["tags"]) == ("watch", 4, ["macro"]) and (made[5]["importance"], made[5]["tags"], made[5]["summary"]) == (2, ["other"], "text 5")
    assert {tuple(r) for r in scoring.given_up(found).collect()} == {(7, "content-risk"), (100, "content-risk")}
    assert scoring.scored(posts.limit(0), Stub([], 0, [])).count() == 0
