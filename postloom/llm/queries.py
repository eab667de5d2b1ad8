"""The queries of the corpus operators over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm import alignment, fingerprint, langid, linededup, ngramjoin, ngramlm, packing, passages, sentencepieces, spelling, tokenfile, topk, toxicity
from postloom.llm.common import read_table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.digests(read_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return langid.predict(documents, langid.train(documents))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return toxicity.predict(documents, toxicity.train(documents, read_table(spark, sf_dir, "labels"))).select("doc_id", "held_out", "score", "predicted")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read_table(spark, sf_dir, "embeddings"))


def op5_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.roundtrip(read_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint.compare_with_next(read_table(spark, sf_dir, "documents"))
    return found.withColumns({c: fingerprint.as_string(c) for c in ("fingerprint", "edited_fingerprint")})


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(read_table(spark, sf_dir, "documents").select("doc_id", "text")).selectExpr("doc_id", "n_lines", "n_kept", "sha2(text, 256) AS text_sha256")


def op8_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngramlm.score(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", *[F.round(c, 6).alias(c) for c in ("log_score", "mean_log_score")])


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(read_table(spark, sf_dir, "documents"))


def op10_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(read_table(spark, sf_dir, "documents"))


def op11_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.kept(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read_table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), _tokenizer("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_sentencepiece, op2_language, op3_toxicity, op4_topk, op5_tokenfile, op6_fingerprint, op7_linededup, op8_backoff, op9_packing, op10_ngramjoin, op11_passages, op12_spelling, op13_alignment)}

SQL = {
    "op8_backoff": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
g AS (SELECT r, i, w AS u, lag(w) OVER o AS v, v || ' ' || w AS b, lag(w, 2) OVER o || ' ' || v AS c, lag(w, 2) OVER o || ' ' || b AS t FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
n1 AS (SELECT u, count(*) AS n FROM g GROUP BY u), n2 AS (SELECT b, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b), n3 AS (SELECT t, count(*) AS n FROM g WHERE t IS NOT NULL GROUP BY t),
s AS (SELECT r, sum(ln(CASE WHEN g.t IS NOT NULL THEN n3.n / p2.n WHEN g.b IS NOT NULL THEN 0.4 * n2.n / p1.n ELSE 0.4::DOUBLE * 0.4 * n1.n / (SELECT count(*) FROM w) END)) AS score
  FROM g JOIN n1 USING (u) LEFT JOIN n2 ON n2.b = g.b LEFT JOIN n3 ON n3.t = g.t LEFT JOIN n1 p1 ON p1.u = g.v LEFT JOIN n2 p2 ON p2.b = g.c GROUP BY r)
SELECT doc_id, len(ws) AS n_words, round(score, 6) AS log_score, round(score / len(ws), 6) AS mean_log_score FROM d LEFT JOIN s USING (r)
""",
    "op4_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op10_ngramjoin": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(1, len(ws) - 3) + 1)) AS i) WHERE len(ws) > 0),
n AS (SELECT w.doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY w.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * c >= 85 * (i.n + j.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.y, r.root FROM r JOIN e ON e.x = r.doc_id)
SELECT doc_id, n AS n_shingles, min(root) AS component_id FROM n JOIN r USING (doc_id) GROUP BY ALL
""",
    "op7_linededup": r"""
WITH docs AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL),
l AS (
  SELECT doc_id, text, i AS pos, string_split(text, chr(10))[i] AS line FROM docs, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)
), w AS (
  SELECT doc_id, pos, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM l
), k AS (SELECT doc_id, pos, ws, array_to_string(ws, ' ') AS line, len(ws) AS n FROM w WHERE len(ws) > 0),
f AS (SELECT line, any_value(ws) AS ws, any_value(n) AS n, min((doc_id, pos)) AS spot FROM k GROUP BY line),
v AS (
  SELECT line, n, spot, i, md5(array_to_string(ws[: i - 1] || ws[i + 1 :], ' ')) AS d FROM f, LATERAL (SELECT unnest(range(1, n + 1)) AS i) WHERE n >= 2
), later AS (
  SELECT v.line FROM v JOIN (SELECT d, i, n, min(spot) AS m FROM v GROUP BY ALL) g ON g.d = v.d AND g.i = v.i AND g.n = v.n WHERE v.spot > g.m
  UNION SELECT f.line FROM f JOIN (SELECT d, min(spot) AS m FROM v WHERE n > 2 GROUP BY d) g ON g.d = md5(f.line) WHERE f.spot > g.m
  UNION SELECT v.line FROM v JOIN f ON md5(f.line) = v.d WHERE v.n > 2 AND v.spot > f.spot
), gone AS (
  SELECT k.doc_id, k.pos FROM k JOIN f ON f.line = k.line WHERE (k.doc_id, k.pos) <> f.spot OR k.line IN (SELECT line FROM later)
), counts AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE g.pos IS NULL) AS n_kept FROM k LEFT JOIN gone g USING (doc_id, pos) GROUP BY doc_id
), kept AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM l LEFT JOIN gone g USING (doc_id, pos) WHERE g.pos IS NULL GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(c.n_lines, 0)::BIGINT AS n_lines, coalesce(c.n_kept, 0)::BIGINT AS n_kept,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(p.text, '')) END AS text_sha256
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN kept p USING (doc_id)
""",
    "op11_passages": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT r, doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 48)) AS i)),
f AS (SELECT h, bool_or(doc_id IS NULL) AS none, min(doc_id) AS first FROM w GROUP BY h),
gone AS (SELECT DISTINCT r, i + k AS i FROM w JOIN f USING (h), LATERAL (SELECT unnest(range(50)) AS k) WHERE w.doc_id > f.first OR (f.none AND w.doc_id IS NOT NULL)),
each AS (SELECT r, i, ws[i] AS word FROM d, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM each ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
""",
    "op12_spelling": r"""
WITH RECURSIVE r AS (
  SELECT d, run, count(*) AS n FROM (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE length(run) >= 5 GROUP BY ALL
), c AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform(range(1, 2 * strlen(d || ':' || run), 2), lambda i: [('0x' || substr(hex(d || ':' || run), i, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, e: xor(xor(a, e) >> 1, 3988292384 * (xor(a, e) & 1)))) AS h FROM r
), w AS (
  SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n AS k FROM c)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(k) >= 3
), v AS (
  SELECT word, n, length(word) AS l, i, substr(word, 1, i - 1) || substr(word, i + 1) AS d FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)
), p AS (
  SELECT a.word, b.word AS other, b.n AS m FROM v a JOIN v b ON a.d = b.d AND a.i = b.i AND a.l = b.l AND a.word <> b.word
  UNION SELECT v.word, w.word, w.n FROM v JOIN w ON w.word = v.d UNION SELECT w.word, v.word, v.n FROM v JOIN w ON w.word = v.d
), b AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM p GROUP BY word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM w LEFT JOIN b USING (word)
), t(word, top) AS (
  SELECT word, word FROM f UNION ALL SELECT t.word, f.form FROM t JOIN f ON f.word = t.top WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, t.top AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n FROM f JOIN t USING (word) JOIN f e ON e.word = t.top WHERE e.form IS NULL
""",
}
