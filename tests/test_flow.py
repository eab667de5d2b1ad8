"""Rules, clusters, samples and reports against hand-made rows and plain loops."""

import collections
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.functions import text
from postloom.operators import classification, embedding, filters, jobs, merge, quantiles, reports, routing, search, similarity
from postloom.streaming import windows


@pytest.mark.parametrize(
    ("raw", "lang", "want"),
    [
        ("up 5%", "en", "rule-drop"), ("3 sol in 2 minutes", "en", "rule-keep"), ("usdc 3 hours", "en", "rule-keep"), ("hello", " ZXX ", "low-lang"), ("hello there", "en", "low-info-short"), (None, None, "low-info-short"),
        ("x" * 79, "en", "low-info-short"), ("x" * 80, "en", "rule-drop"), ("x" * 119, "en", "rule-drop"), ("x" * 120, "und", "rule-keep"), ("😀" * 40, "en", "rule-drop"), ("😀" * 60, "en", "rule-keep"), ("😀" * 39, "en", "low-info-short"),
        ("an ETF", "en", "rule-keep"), ("主网 now", "und", "rule-keep"), ("$abc 1 2", "en", "rule-keep"), ("$abc 1", "en", "low-info-short"), ("1 2 3", "en", "rule-drop"), ("涨btc啊 3天", "zh", "rule-keep"),
    ],
)
def test_rules(spark, raw, lang, want):
    assert routing.rules(spark.createDataFrame([(1, raw, lang)], "post_id long, text string, lang string")).first()["outcome"] == want


def grown(posts, threshold, bump):
    """The clusters of one report, one post at a time, from nothing but lists."""
    out = []
    for n, (pid, imp, at, tags, v) in enumerate(sorted(posts, key=lambda p: (-p[1], -p[2], p[0]))):
        u = v / np.linalg.norm(v)
        names = [t.strip().lower() for t in tags]
        first = next((t for t in names if t), "other")
        best, where = -1, None
        for c in out:
            total = np.sum([m[4] for m in c["m"]], axis=0)
            score = float(u @ (total / np.linalg.norm(total)))
            near = first == c["first"] or {t for t in names if t} & {t.strip().lower() for t in c["tags"]}
            if score >= (threshold if near else min(0.98, threshold + bump)) and score > best:
                best, where = score, c
        if where is None:
            out.append({"id": f"c{n + 1}", "m": [(pid, imp, at, names, u)], "first": first, "tags": tags})
            continue
        where["m"].append((pid, imp, at, names, u))
        count = collections.Counter(t for m in where["m"] for t in m[3] if t)
        where["tags"] = [t for t, _ in sorted(count.items(), key=lambda x: -x[1])][:5]
    for c in out:
        c["rep"] = max(c["m"], key=lambda m: (m[1], m[2]))
    out.sort(key=lambda c: (-c["rep"][1], -len(c["m"]), -c["rep"][2]))
    return [(i, c["id"], len(c["m"]), c["rep"][1], list(c["tags"]), c["rep"][0], [m[0] for m in c["m"]]) for i, c in enumerate(out)]


def test_clusters_against_a_plain_loop(spark):
    rng, gen = random.Random(4), np.random.default_rng(4)
    centres = gen.normal(0, 1, (6, 8))
    posts = [(r, i, rng.randrange(6), i * 7 % 100, [rng.choice(["a", " B", "c", "", "d", "e", "f"]) for _ in range(rng.randrange(4))], centres[rng.randrange(6)] + gen.normal(0, 0.5, 8)) for r in range(3) for i in range(120)]
    df = spark.createDataFrame([(r, i, imp, at, tags, v.tolist()) for r, i, imp, at, tags, v in posts], "report int, post_id long, importance int, posted_at long, tags array<string>, v array<double>").repartition(5)
    got = collections.defaultdict(list)
    for x in sorted(reports.clusters(df, 0.8, 0.1).collect()):
        got[x["report"]].append((x["pos"], x["cluster"], x["size"], x["peak"], x["tags"], x["representative"], x["members"]))
    for r in range(3):
        assert got[r] == grown([p[1:] for p in posts if p[0] == r], 0.8, 0.1)
    assert max(x[2] for x in got[0]) > 3
    assert reports.clusters(df.limit(0)).count() == 0


def test_quotas_and_samples(spark):
    assert reports.quotas({"a": 100, "b": 10, "c": 1}, 20) == {"a": 17, "b": 2, "c": 1}
    assert sum(reports.quotas({"a": 5, "b": 5}, 7).values()) == 7 and reports.quotas({"a": 5, "b": 5}, 1) in ({"a": 1, "b": 0}, {"a": 0, "b": 1})
    df = spark.createDataFrame([(i, "x" if i % 10 else "y") for i in range(500)], "post_id long, s string")
    got = reports.stratified(df, F.col("s"), 40).collect()
    assert collections.Counter(r["stratum"] for r in got) == reports.quotas({"x": 450, "y": 50}, 40) and len({r["post_id"] for r in got}) == 40
    assert sorted(got) == sorted(reports.stratified(df.repartition(3), F.col("s"), 40).collect())
    now = datetime(2024, 3, 1)
    rows = [(i, now - timedelta(days=i % 150), 3 + i % 3, "ignore" if i % 11 == 0 else "watch", [["market"], ["macro", "yield"], ["policy", "zzz"]][i % 3], "s") for i in range(600)]
    insights = spark.createDataFrame(rows, "post_id long, created_at timestamp_ntz, importance int, verdict string, tags array<string>, stratum string")
    found = classification.tag_samples(insights, "2024-03-01 00:00:00", per_tag=150).collect()
    by = collections.defaultdict(list)
    for r in found:
        by[r["tag"], r["late"]].append(r["post_id"])
    fine = [r for r in rows if r[1] >= now - timedelta(days=120) and r[3] != "ignore"]
    of = lambda tag, test: {r[0] for r in fine if test(r[2]) and ({tag, "market"} if tag == "macro" else {tag}) & set(r[4])}
    for tag in ("macro", "policy", "yield"):
        high, low = of(tag, lambda x: x >= 4), of(tag, lambda x: x == 3)
        assert len(by[tag, False]) == min(150, len(high)) and set(by[tag, False]) <= high
        assert len(by[tag, True]) == (min(150 - len(high), len(low)) if len(high) < 100 else 0) and set(by[tag, True]) <= low
    assert classification.refresh(None, "m", 2) == "full" and classification.refresh({"model": "m", "dimensions": 2}, "m", 2, " Market") == "tag"
    assert classification.refresh({"model": "n", "dimensions": 2}, "m", 2, "macro") == "full" and classification.refresh(None, "m", 2, "zzz") == "unknown-tag"


def unit(v):
    v = np.array(v, float)
    size = np.linalg.norm(v)
    return v / size if size > 0 and np.isfinite(size) else np.zeros(len(v))


def plain_scores(posts, samples, order, k):
    """Best tag, its score and the second score by post: a loop over the tags in order, as long as one is higher than all before."""
    want = {}
    for i, v in posts:
        if v is None or len(v) != 4:
            continue
        tag, best, second = None, -1.0, -1.0
        for t in order:
            each = sorted((float(unit(v) @ unit(w)) for u, w, s in samples if u == t and s != i), reverse=True)[:k]
            if not each:
                continue
            score = sum(each) / len(each)
            if score > best:
                tag, best, second = t, score, best
            elif score > second:
                second = score
        want[i] = (tag, round(best, 9) if tag else None, round(second, 9) if second > -1 else None)
    return want


def test_neighbours_in_parts_and_odd_vectors(spark, monkeypatch):
    gen = np.random.default_rng(1)
    samples = [(f"t{i % 5}", (gen.normal(0, 1, 4) * [1, 0.1, 5, 0][i % 4]).tolist(), 1000 + i) for i in range(60)]
    samples += [("t9", samples[1][1], 1001), ("t0", samples[1][1], 2000)]  # a post that is a sample of two tags
    posts = [(i, (gen.normal(0, 1, 4) * [1, 0.1, 5][i % 3]).tolist()) for i in range(40)] + [(1003, samples[3][1]), (1001, samples[1][1]), (80, [0.0] * 4), (81, [1e200] * 4), (90, None), (91, [1.0]), (92, [])]
    p, s = spark.createDataFrame(posts, "post_id long, v array<double>"), spark.createDataFrame(samples, "tag string, v array<double>, sample_id long")
    names = ["t3", "t9", "t0", "t1", "t2", "t4"]
    for order in (sorted(names), names):
        for most in (20_000, 25, 10):
            monkeypatch.setattr(similarity, "CACHE", most)
            rows = similarity.tag_scores(p, s, (1, 3), order).collect()
            assert len(rows) == 2 * len(posts) and not any(r["known"] for r in rows if r["post_id"] in (90, 91, 92))
            for k in (1, 3):
                got = {r["post_id"]: (r["tag"], r["score"] and round(r["score"], 9), r["second"] and round(r["second"], 9)) for r in rows if r["known"] and r["k"] == k}
                assert got == plain_scores(posts, samples, order, k)
    reasons = {r["post_id"]: r["reason"] for r in routing.knn(p, s.limit(0)).collect()}
    assert set(reasons.values()) == {"embed-missing"}
    one = routing.knn(p, s.where("tag = 't1'"), low=-9.0, high=-8.0, margin=0.0).where("post_id < 40").collect()
    assert all(r["status"] == "AUTO_HIGH" and r["margin"] is None for r in one)
    own = spark.createDataFrame([("t1", 99.0, 99.0, 0.0, 99.0)], "tag string, low double, high double, margin double, strict double")
    assert {r["reason"] for r in routing.knn(p, s.where("tag = 't1'"), thresholds=own).where("post_id < 40").collect()} == {"embed-low"}
    back = spark.createDataFrame([(1, [1.0, 0.0])], "post_id long, v array<double>")
    assert routing.knn(back, spark.createDataFrame([("a", [-3.0, 0.0])], "tag string, v array<double>")).first()["reason"] == "embed-unrouted"


def test_tags_below_the_second_best_are_left_out():
    gen = np.random.default_rng(2)
    centres = gen.normal(0, 1, (40, 16))
    rows = [{"tag": f"t{i:02}", "v": (c + gen.normal(0, 0.05, 16)).tolist()} for i, c in enumerate(centres) for _ in range(50)]
    cache = similarity._Cache(rows, {f"t{i:02}": i for i in range(40)}, 16)
    posts = np.array([unit(centres[i % 40] + gen.normal(0, 0.05, 16)) for i in range(400)])
    tag, top, second, done = cache.best(posts, [None] * 400, np.ones(400, bool), (1,))
    each = np.stack([(posts @ cache.grid[a:b].T).max(1) for a, b in zip(cache.starts, cache.ends, strict=True)], 1)
    assert (tag[0] == each.argmax(1)).all() and np.allclose(top[0], each.max(1)) and np.allclose(second[0], np.sort(each, 1)[:, -2])
    assert done < 0.7 * 400 * 40


def test_interpolated_quantiles(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 10.0, None)], "x double")
    assert tuple(quantiles.interpolated(df, "x", {"a": 0.9, "b": 0.5, "c": 0.0, "d": 1.0}).first()) == pytest.approx((7.9, 2.5, 1.0, 10.0))
    assert tuple(quantiles.interpolated(df.limit(0), "x", {"a": 0.9}).first()) == (None,)


def test_quantiles_of_skewed_values(spark):
    gen = np.random.default_rng(5)
    values = {"even": gen.normal(0, 1, 5000).tolist(), "far": [*gen.normal(0, 1e-9, 19_999).tolist(), 1e12], "one": [3.0] * 700, "two": [-1e300, 1e300], "nan": [float("nan"), 1.0, 2.0]}
    df = spark.createDataFrame([(k, float(x)) for k, xs in values.items() for x in xs] + [("even", None), (None, 1.0)], "k string, x double")
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for rounds in (1, 2, 3):
        got = {(r["k"], r["q"], r["at"]): r["value"] for r in quantiles.elements(df, "k", "x", qs, {"lo": F.floor, "hi": F.ceil}, rounds=rounds).collect()}
        for k, xs in values.items():
            order = sorted(x for x in xs if x == x) + [x for x in xs if x != x]
            for q in qs:
                for at, place in (("lo", np.floor), ("hi", np.ceil)):
                    want = order[int(place((len(order) - 1) * q))]
                    assert got[k, q, at] == want or (want != want and got[k, q, at] != got[k, q, at]), (k, q, at)
        assert len(got) == len(values) * len(qs) * 2


def test_search_ids_and_windows(spark):
    assert search.post_id("x.com/u/status/1234567890") == "1234567890" and search.post_id("123456789") is None and search.post_id("see 1234567890!") == "1234567890"
    now = datetime(2024, 1, 2, 3)
    day = ("2024-01-01 03:00:00", "2024-01-02 03:00:00")
    assert search.window("a", None, None, None, now) == day and search.window(None, " v ", None, None, now) == day
    assert search.window("a,1234567890", None, None, None, now) == (None, None) and search.window("a", None, None, "x", now) == (None, "x") and search.window(None, " ", None, None, now) == (None, None)
    with pytest.raises(ValueError):
        filters.between(F.lit(1), 2, 1)


@pytest.mark.parametrize(
    ("fn", "cases"),
    [
        (text.json_text, {'a {"b": {}} c': '{"b": {}}', '```json\n{"a": 1}\n```': '{"a": 1}', "none": "none", None: None}),
        (text.error_kind, {"Content Exists Risk": "content-risk", "HTTP 503": "service-busy", "Service is too busy": "service-busy", "x": "failed"}),
        (text.thread_id, {"12": 12, "0": None, "-3": None, "x": None, None: None, "99999999999999999999": None}),
        (text.listed, {"a, b，c\n\n d": ["a", "b", "c", "d"], "": []}),
        (text.size_group, {" " + "x" * 79: "short", "x" * 80: "medium", "x" * 160: "medium", "😀" * 161: "long"}),
        (text.lang_group, {" ZH-tw": "zh", "En": "en", "fr": "other", None: "other"}),
        (text.raw_views, {'{"views": "1.2K"}': 1200.0, '{"views": 7}': 7.0, "[1]": None, "{}": None, None: None}),
        (text.embedding_text, {"rt hello": "hello", "RT @a: rt x": "x", "fat.co/x": "fat.co/x", " rt @a: b": "rt : b"}),
    ],
)
def test_more_functions(spark, fn, cases):
    df = spark.createDataFrame(list(enumerate(cases)), "i int, x string").select("i", fn(F.col("x")).alias("y"))
    assert [r["y"] for r in sorted(df.collect(), key=lambda r: r["i"])] == list(cases.values())


def test_report_markdown(spark):
    at = datetime(2024, 1, 1, 12)
    rows = [
        (1, 11, 5, at, "watch", ["token", "macro"], "s1", None, "t1", "@Ann", "Ann Lee", "https://u/1", [1.0, 0.0]),
        (1, 12, 3, at, "watch", ["Others"], " ", None, "whole  text", None, "Bob", None, [0.0, 1.0]),
        (1, 13, 5, at + timedelta(hours=1), "watch", ["token"], "s3", "do", "t3", "ann", "Ann Lee", None, [1.0, 0.1]),
        (1, 14, None, at, "watch", [], None, None, "t4", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "report int, post_id long, importance int, posted_at timestamp_ntz, verdict string, tags array<string>, summary string, suggestions string, text string, handle string, name string, url string, v array<double>")
    heads = reports.heads(df, "2024-01-01 00:00:00", "2024-01-01 23:00:00", "Asia/Shanghai", "Daily")
    top = "# 2024-01-02 07:00 Daily\n\n> 时间范围：2024-01-01 08:00 - 2024-01-02 07:00\n\n## 概览\n\n"
    got = reports.tag_report(df, heads).first()
    assert got["markdown"] == top + (
        "- 重点分类：代币 / 市场（2）、其他（2）\n\n- 本次共保留 4 条洞察，均按标签与重要度排序，便于直接引用。\n\n## 重点洞察\n\n### 代币 / 市场\n\n共 2 条洞察，最高 5⭐，已按重要度降序排列。\n\n"
        "- 5⭐ s3 (https://twitter.com/ann/status/13) [token]\n\n- 5⭐ s1 (https://u/1) [token, macro]\n\n### 其他\n\n共 2 条洞察，最高 3⭐，已按重要度降序排列。\n\n- 3⭐ whole text (https://twitter.com/i/web/status/12) [Others]\n\n- t4 (https://twitter.com/i/web/status/14)"
    )
    assert "### 宏观 / 行情" in reports.tag_report(df, heads, ["macro"]).first()["markdown"]
    authors = reports.author_report(df, heads).first()["markdown"]
    assert "### Ann Lee" in authors and "### Bob" in authors and "### Unknown" in authors and authors.index("Ann") < authors.index("### Bob")
    whole = reports.cluster_report(df, heads, threshold=0.9).first()
    assert "- s3（2条 / 最高5⭐） [推文](https://twitter.com/ann/status/13) [token, macro]" in whole["markdown"] and "聚合为 2 个主题簇，展示 2 个。" in whole["markdown"]
    from postloom.operators import outlines

    named = spark.createDataFrame([(1, whole["outline"])], "report int, outline string").select(outlines.post_ids(F.col("outline"), members=True).alias("ids")).first()["ids"]
    assert named == ["13", "11", "12"]
    spec = {"id": 7, "name": "P", "hours": 24, "group": "tag", "filter": {"least": 3}}
    tagged = df.withColumn("author_tags", F.array().cast("array<string>"))
    made = reports.profile_report(tagged, spec, "2024-01-01 13:00:45").first()
    assert made["report"] == 7 and "（1）" in made["markdown"] and "s3" in made["markdown"] and "t4" not in made["markdown"]
    done = spark.createDataFrame([(7, datetime(2024, 1, 1, 13))], "profile int, period_end timestamp_ntz")
    assert reports.profile_report(tagged, spec, "2024-01-01 13:00:45", done).count() == 0
    assert "簇" in reports.profile_report(tagged, spec | {"group": "cluster"}, "2024-01-01 13:00:45").first()["markdown"]


def test_embeddings(spark):
    provider = embedding.Hashing(8)
    posts = spark.createDataFrame([(1, "a b", "en"), (2, None, None), (3, "c", "fr")], "post_id long, text string, lang string")
    empty = spark.createDataFrame([], "post_id long, v array<double>, model string, dimensions int, hash string")
    cache = embedding.refreshed(posts, empty, provider)
    assert sorted((r["post_id"], len(r["v"])) for r in cache.collect()) == [(1, 8), (2, 8), (3, 8)]
    old = cache.withColumn("v", F.when(F.col("post_id") == 1, F.array(F.lit(1.0))).otherwise(F.transform("v", lambda x: F.lit(9.0)))).withColumn("hash", F.when(F.col("post_id") == 3, "x").otherwise(F.col("hash")))
    again = {r["post_id"]: r["v"] for r in embedding.refreshed(posts, old, provider).collect()}
    assert again[2] == [9.0] * 8 and len(again[1]) == 8 and again[3] != [9.0] * 8


def test_states_windows_and_last_rows(spark, tmp_path):
    pairs = [("PENDING", "ROUTED", True), ("ROUTED", "IGNORED", False), ("LLM_QUEUED", "COMPLETED", True), ("IGNORED", "ROUTED", False), ("x", "ROUTED", False)]
    df = spark.createDataFrame(pairs, "a string, b string, want boolean")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", jobs.move_allowed(F.col("a"), F.col("b"))).collect())
    now = datetime(2024, 1, 1, 12)
    assert jobs.next_window(None, now) == (datetime(2024, 1, 1, 6), now) and jobs.next_window(datetime(2024, 1, 1, 7), now) is None
    assert reports.window("2024-01-01 12:00:59", 2) == ("2024-01-01 10:00:00", "2024-01-01 12:00:00")
    rows = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 1, "z")], "k int, t int, x string")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = windows.last_of_each(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), "k", "t")
    query = stream.writeStream.format("memory").queryName("last").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r["k"], r["x"]) for r in spark.table("last").collect()) == [(1, "c"), (2, "z")] == sorted((r["k"], r["x"]) for r in windows.last_of_each(rows, "k", "t").collect())


def test_samples_titles_and_global_reports(spark):
    from postloom.operators import merge

    df = spark.range(500).select(F.col("id").alias("k"))
    one = [r["k"] for r in merge.sampled(df, "k", 20).collect()]
    assert len(set(one)) == 20 and sorted(one) == sorted(r["k"] for r in merge.sampled(df.repartition(7), "k", 20).collect()) and one != [r["k"] for r in merge.sampled(df, "k", 20, 3).collect()]
    titles = spark.createDataFrame([(t,) for t in ("Zeta", "宏观", "安全", "DeFi", "政策")], "title string")
    assert [r["title"] for r in reports.by_title(titles).collect()] == ["安全", "宏观", "政策", "DeFi", "Zeta"]
    assert reports.global_report(titles, datetime(2024, 1, 1, 7), datetime(2024, 1, 1, 12)) is None


def test_leading_rows_and_includes(spark):
    gen = np.random.default_rng(3)
    rows = [("hot" if i % 10 else "cold", int(gen.integers(0, 500)), i) for i in range(3000)] + [("hot", 7, 1), (None, 1, 2)]
    df = spark.createDataFrame(rows, "k string, x int, id long").repartition(6)
    for most in (1, 40):
        got = sorted((r["k"] or "", r["r"], r["x"], r["id"]) for r in merge.leading(df, "k", [F.desc("x"), F.asc("id")], most, parts=8).collect())
        want = []
        for k in ("", "cold", "hot"):
            mine = sorted(((-x, i) for q, x, i in rows if (q or "") == k))[:most]
            want += [(k, n + 1, -x, i) for n, (x, i) in enumerate(mine)]
        assert [g[:3] + g[3:] for g in got] == sorted(want)
    posts = spark.createDataFrame([(1, 10), (2, 30), (3, None)], "post_id long, owner long")
    owners = spark.createDataFrame([(10, "a"), (20, "b")], "id long, name string")
    nested = merge.include(spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "key long"), merge.include(posts, owners, "owner", "id", "account"), "key", "post_id", "post")
    got = {r["key"]: (r["post"] is not None, r["post"] and r["post"]["account"] and r["post"]["account"]["name"]) for r in nested.collect()}
    assert got == {1: (True, "a"), 2: (True, None), 3: (True, None), 4: (False, None), None: (False, None)}
