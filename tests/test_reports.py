"""Landed sources, messages, digests and outlines against hand-made rows."""

import collections
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom import registry
from postloom.functions import text
from postloom.operators import delivery, embedding, outlines, reports
from postloom.sources import landed


def test_messages(spark):
    lines = ["# H", "> 时间范围：x", "- early", "## 分类", *[f"- a{i}" for i in range(6)], "### B", "1. [t](u) [k]", "## Other", "- out", "## 分类", "- a6"]
    rows = [(1, "\n".join(lines)), (2, " plain "), (3, "  "), (4, None)]
    got = {(r["report"], r["n"]): r["message"] for r in delivery.messages(spark.createDataFrame(rows, "report int, markdown string"), ["分类"]).collect()}
    head = "H\n时间范围：x\nCategory: "
    assert got == {
        (1, 1): head + "分类\n\n" + "\n\n".join(f"{i + 1}. a{i}" for i in range(5)),
        (1, 2): head + "分类\n\n1. a5\n\n2. a6",
        (1, 3): head + "B\n\n1. t: u Tags: k",
        (2, 1): "plain",
    }


@pytest.mark.parametrize(("raw", "want"), [("1. see https://x.y  now", "see now"), ("up（3条）[推文](u) [a, b]", "up推文: u"), ("news 推文：", "news"), ("x" * 50, "x" * 47 + "…"), ("", ""), (None, None)])
def test_bullet(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(text.bullet(F.col("x"))).first()[0] == want


def test_digest(spark):
    given = ['{"bullets": [" a ", "", "b"]}', '```json\n{"bullets": ["c"]}\n```', "d\r\n\n e ", "{broken", "", None]
    df = spark.createDataFrame(list(enumerate(given)), "i int, x string").select("i", delivery.digest_items(F.col("x")).alias("y"))
    assert [r["y"] for r in sorted(df.collect())] == [["a", "b"], ["c"], ["d", "e"], ["{broken"], [], None]


def test_digest_bullets(spark):
    schema = "report int, pos int, text string"
    given = spark.createDataFrame([(1, 0, "a"), (1, 1, "1. a"), (1, 2, "b"), (1, 3, None)], schema)
    sources = spark.createDataFrame([(1, 0, "b"), (1, 1, "c"), (1, 2, "d"), *[(2, i, f"s{i}") for i in range(9)]], schema)

    def run(target):
        return [(r["report"], r["bullet"]) for r in sorted(delivery.bullets(given, sources, target).collect())]

    assert run(3) == [(1, "a"), (1, "b"), (1, "c"), (2, "s0"), (2, "s1"), (2, "s2")]
    assert run(None) == [(1, "a"), (1, "b"), *[(2, f"s{i}") for i in range(8)]]


def shared(total, sizes):
    """Shares, one step at a time."""
    exact = [n / sum(sizes) * total if sum(sizes) else 0 for n in sizes]
    out = [max(1, int(x)) for x in exact]
    while sum(out) > total and max(out) > 1:
        out[out.index(max(out))] -= 1
    for i in sorted(range(len(out)), key=lambda i: int(exact[i]) - exact[i])[: max(0, total - sum(out))]:
        out[i] += 1
    return out


def test_allocate(spark):
    cases = [(10, [6, 3, 1]), (5, []), (3, [100, 1, 1]), (2, [0, 0, 0]), (7, [1, 1]), (20, [9, 9, 1, 1, 1, 30]), (4, [5, 5, 5, 5, 5]), (9, [50, 50, 1, 1, 1, 1])]
    for total, sizes in cases:
        groups = spark.createDataFrame([(1, i, n) for i, n in enumerate(sizes)], "report int, pos int, n int")
        assert [r["share"] for r in delivery.allocate(groups, total).orderBy("pos").collect()] == (shared(total, sizes) if sizes else []), (total, sizes)
    assert delivery.allocate(spark.createDataFrame([(1, 0, 1)], "report int, pos int, n int"), 0).count() == 0


def test_outlines(spark):
    items = {"sections": [{"title": " T ", "items": [{"tweetId": " 7 ", "summary": " s ", "importance": 4, "tags": ["a", " a"]}, {"tweetId": "8", "summary": " ", "importance": 5}], "tweets": ["see 1234567890 and 7", None]}, {"title": None}]}
    clusters = {"mode": "clustered", "sections": [{"tag": "k", "clusters": [{"size": 2, "peakImportance": 5, "tags": ["k", "m"], "representative": {"tweetId": "1", "summary": "z"}, "memberTweetIds": ["2", "1"]}]}]}
    df = spark.createDataFrame([(0, json.dumps(items)), (1, json.dumps(clusters)), (2, "no"), (3, None)], "report int, outline string")
    ids = {r["report"]: (r["a"], r["b"]) for r in df.select("report", outlines.post_ids(F.col("outline")).alias("a"), outlines.post_ids(F.col("outline"), True).alias("b")).collect()}
    assert ids[0] == (["7", "8", "1234567890"],) * 2 and ids[1] == (["1"], ["1", "2"]) and not ids[2][0] and not ids[3][0]
    assert sorted(tuple(r) for r in outlines.tag_counts(df).collect()) == [(0, "a", 2), (1, "k", 2), (1, "m", 2)]
    assert sorted((r["report"], r["category"], r["post_id"], r["text"]) for r in outlines.high_entries(df).collect()) == [(0, "T", " 7 ", "s"), (1, "其他", "1", "z")]


def test_landed(spark, tmp_path):
    pages = [{"timeline": [{"tweet_id": "1", "created_at": "a", "text": "x"}, {"tweet_id": "2", "text": "y"}], "next_cursor": "c"}, {"timeline": [{"tweet_id": "1", "created_at": "a", "text": "x"}, {"text": "no id"}]}]
    (tmp_path / "p.json").write_text("\n".join(map(json.dumps, pages)))
    assert sorted((r["tweet_id"], r["text"]) for r in landed.timeline(spark, str(tmp_path)).collect()) == [("1", "x"), ("2", "y")]
    read = spark.read.schema(landed.PAGE).json(str(tmp_path)).withColumn("page", F.col("next_cursor").isNull().cast("int"))
    assert sorted(tuple(r) for r in landed.pages_after(read).collect()) == [(0, 2, "c", True), (1, 2, None, False)]
    cache = spark.createDataFrame([('{"a": [[3, 4], [1], [0, null]], "b": []}',), ("junk",), (None,)], "samples string")
    assert sorted((r["tag"], [round(x, 6) for x in r["v"]]) for r in landed.tag_samples(cache, 2).collect()) == [("a", [0.0, 0.0]), ("a", [0.6, 0.8])]
    counts = spark.createDataFrame([('{"a": 2.7, "b": -1, "c": null}',)], "x string").select(landed.sample_counts(F.col("x"))).first()[0]
    assert counts == {"a": 2, "b": 0}
    lists = spark.createDataFrame([(1, "@Ann, likes, tea\n\nbob  the  one\r\nann again\n,x"), (2, None)], "list_id int, text string")
    assert sorted((r["account"], r["note"]) for r in landed.bulk_accounts(lists).collect()) == [("ann", "likes, tea"), ("bob", "the  one")]


def test_clusters_against_a_plain_loop():
    """Posts about 150 topics: the same clusters as a loop over all of them, with few of the pairs compared."""
    gen = np.random.default_rng(8)
    centres = gen.normal(0, 1, (150, 24))
    post = collections.namedtuple("post", "post_id importance posted_at tags v")
    posts = [post(i, int(gen.integers(1, 6)), i, [["a", "b", " C ", ""][int(k)] for k in gen.integers(0, 4, 2)], (centres[int(gen.integers(0, 150))] + gen.normal(0, 0.35, 24)) * [1, 0.1, 5][i % 3]) for i in range(3000)]
    posts[700] = posts[700]._replace(v=np.zeros(24))
    got = reports.Clusters(0.86, 0.05)
    i = 0
    while i < len(posts):
        some = posts[i : i + got.room()]
        got.look(some)
        for p in some:
            got.add(p)
        i += len(some)
    plain = []
    for p in posts:
        size = np.linalg.norm(p.v)
        unit = p.v / size if size else p.v
        names = [t.strip().lower() for t in p.tags]
        primary = next((t for t in names if t), "other")
        best = None
        for c in plain:
            near = float(c["unit"] @ unit)
            need = 0.86 if primary == c["primary"] or (set(names) - {""}) & c["names"] else 0.91
            if near >= need and (best is None or near > best[0]):
                best = near, c
        if best is None:
            c = {"primary": primary, "names": set(names) - {""}, "sum": np.zeros(24), "members": [], "counts": collections.Counter()}
            plain.append(c)
        else:
            c = best[1]
        c["members"].append(p.post_id)
        c["counts"].update(t for t in names if t)
        if len(c["members"]) > 1:
            c["names"] = {t for t, _ in c["counts"].most_common(5)}
        c["sum"] = c["sum"] + unit
        c["unit"] = c["sum"] / (np.linalg.norm(c["sum"]) or 1.0)
    assert [c["members"] for c in got.found] == [c["members"] for c in plain]
    assert got.tried < 0.35 * got.all


def test_default_profile_and_id_links(spark):
    mine = spark.createDataFrame([("Own", "x")], "name string, note string")
    got = {r["name"]: r for r in reports.with_default(mine.selectExpr("name", "note", "'c' AS cron", "5 AS hours", "'UTC' AS timezone", "1 AS least", "'tag' AS `group`", "false AS triage")).collect()}
    assert set(got) == {"Own", "默认日报"} and got["默认日报"]["hours"] == 24 and got["默认日报"]["note"] is None
    there = reports.with_default(spark.createDataFrame([], "name string, cron string, hours int, timezone string, least int, `group` string, triage boolean"))
    assert reports.with_default(there).count() == 1
    link = "[1234567890](https://x.com/i/web/status/1234567890)"
    cases = {"a (1234567890) b": f"a ({link}) b", "（来源: 1234567890）": f"（来源: {link}）", "- 1234567890 ": f"- {link} ", "tweet id：1234567890": f"tweet id：{link}", "1234567890": "1234567890", "(123456789)": "(123456789)", "x\n-  1234567890\ny": f"x\n-  {link}\ny"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", text.linked_ids(F.col("t")).alias("u"))
    assert {r["t"]: r["u"] for r in df.collect()} == cases


def test_triage_of_reports_without_middle_posts(spark):
    posts = spark.createDataFrame([(1, 1, 5, 1), (1, 2, None, 2), (2, 3, 4, 3), (2, 4, 2, 4), (2, 5, 2, 5), (3, 6, 1, 6)], "report int, post_id long, importance int, at long").selectExpr("report", "post_id", "importance", "timestamp_seconds(at) AS posted_at")
    said = posts.select("report", "post_id", F.col("post_id").alias("place"), (F.col("post_id") == 5).alias("include"))
    for failed in (None, posts.selectExpr("report", "0 AS chunk").where("report = 3")):
        assert sorted(tuple(r) for r in reports.triage(posts, said, 3, failed).select("report", "post_id").collect()) == [(1, 1), (1, 2), (2, 3), (2, 5), (3, 6)]


@pytest.mark.parametrize(("name", "n"), [("high_profile_authors", 20), ("high_profile_tags", 13)])
def test_profiles_list_all(spark, tmp_path, name, n):
    spark.range(520).selectExpr("id AS doc_id", "'x' AS text", "'en' AS lang", "concat('s', id div 26) AS source", "1 AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(520).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic").write.parquet(f"{tmp_path}/labels.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == n and "LIMIT" not in registry.SQL[name]


def test_inputs_are_made_once(spark):
    df = spark.createDataFrame([("RT @a: x\u3000 y  #z http://q.r", " En\t x "), ("@a", None), (None, "en")], "t string, lang string").select(text.embedding_input(F.col("t"), F.col("lang")).alias("u"))
    assert df._jdf.queryExecution().analyzed().toString().count("pic") == 1
    assert [r["u"] for r in df.collect()] == ["[lang:en x] x y z", "@a", None]


def test_provider_is_asked_once(spark, tmp_path):
    class Logged(embedding.Hashing):
        def embed(self, texts):
            with open(tmp_path / "asked", "a") as f:
                f.writelines(t + "\n" for t in texts)
            return super().embed(texts)

    provider = Logged(4)
    posts = spark.createDataFrame([(1, "a", None), (2, "b", None), (3, "c", None), (None, "d", None)], "post_id long, text string, lang string")
    old = spark.createDataFrame([(2, [0.5] * 4, "hashing", 4, "x"), (9, [0.25] * 4, "hashing", 4, "y"), (8, [0.5] * 3, "hashing", 4, None)], "post_id long, v array<double>, model string, dimensions int, hash string")
    cache = embedding.refreshed(posts, old, provider).localCheckpoint()
    assert sorted((tmp_path / "asked").read_text().split()) == ["a", "b", "c"]
    want = dict(zip((1, 2, 3), provider.embed(["a", "b", "c"]), strict=True)) | {9: [0.25] * 4, 8: [0.5] * 3}
    assert {r["post_id"]: r["v"] for r in cache.collect()} == want and cache.columns == old.columns
    (tmp_path / "asked").unlink()
    again = embedding.refreshed(posts, cache, provider)
    assert {r["post_id"]: r["v"] for r in again.collect()} == want and not (tmp_path / "asked").exists()


@pytest.mark.parametrize("name", ["embedding_inputs", "text_normalize"])
def test_odd_texts_as_sql(spark, tmp_path, name):
    import duckdb

    odd = ["", " \n", None, "@t.co/abc", "@foohttps://x y", "@http://a", "a\xa0b\u3000", "\x0ba", "rt\x0b@a: x", "rt\xa0@a: z", "https://a\x0bb c", "http\u017f://a b", "rt @\u017f\u212a: x", "\ufeffa", "a" * 321, "@x", "é" * 400]
    rows = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate((t, lang) for t in odd for lang in ("en", "EN", " e\tn ", " ", "", None))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect()), key=repr) == sorted(con.sql(registry.SQL[name]).fetchall(), key=repr)


def test_inputs_know_wide_blanks_and_links_before_mentions(spark):
    rows = [("https://a\u3000b", " EN "), ("@foohttps://x y", "\u3000"), ("rt\u3000@a: z", None), ("", "en")]
    df = spark.createDataFrame(rows, "t string, lang string").select(text.embedding_input(F.col("t"), F.col("lang")).alias("u"))
    assert [r["u"] for r in df.collect()] == ["[lang:en] b", "y", "z", "[lang:en]"]
