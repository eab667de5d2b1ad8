"""The operators against brute force, round trips and held-out accuracy."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from postloom.llm import fingerprint, langid, linededup, ngramjoin, ngramlm, packing, queries, sentencepieces, tokenfile, topk, toxicity

TEXTS = [None, "", " ", "\n\n", "a", "Ünï cödé ▁ \x1c\x1d tabs\tand\r\nlines", "word " * 3000, "word " * 3000, "x" * 5000, "日本語 テキスト", "%%% *** 123"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeats and clashing columns."""
    rows = [(i, t, "en" if i % 2 else None, None, None, "x", 1.0) for i, t in enumerate(TEXTS)]
    rows += [rows[4], rows[7], (None, "no id at all here", "en", "s", 3, "y", 2.0), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ref string, score double").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


# 1


def test_sentencepiece_samples_in_proportion():
    vocab = sentencepieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    unit = "▁there"

    def all_of(s):
        if not s:
            yield (), 1.0
        for n in range(1, len(s) + 1):
            if s[:n] in vocab.weights:
                i, w = vocab.weights[s[:n]]
                for rest, v in all_of(s[n:]):
                    yield (i, *rest), w * v

    exact = dict(all_of(unit))
    total = sum(exact.values())
    encoder = sentencepieces.Encoder(vocab)
    got = collections.Counter(tuple(x.tolist()) for x in encoder.encode(["there"] * 20000, np.arange(20000)))
    assert set(got) <= set(exact)
    for ids, w in exact.items():
        p = w / total
        assert abs(got[ids] / 20000 - p) < 5 * math.sqrt(p * (1 - p) / 20000) + 1e-3


def test_sentencepiece_round_trip(spark, odd, empty, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    for table in (odd, docs):
        ids = sentencepieces.encode(table, path)
        back = sentencepieces.decoded(ids, path)
        want = collections.Counter((r["doc_id"], r["text"]) for r in table.collect())
        assert collections.Counter((r["doc_id"], r["text"]) for r in back.collect()) == want
    again = {r["doc_id"]: r["ids"] for r in sentencepieces.encode(docs.repartition(7), path).collect()}
    assert again == {r["doc_id"]: r["ids"] for r in ids.collect()}
    other = {r["doc_id"]: r["ids"] for r in sentencepieces.encode(docs, path, seed=21).collect()}
    assert other != again
    assert sentencepieces.digests(empty, path).count() == 0
    assert all(r["lossless"] is not False for r in sentencepieces.digests(odd, path).collect())


# 2


def test_phrases_against_search():
    rng = random.Random(5)
    samples = {"a": ["".join(rng.choice("abc ") for _ in range(300))], "b": ["".join(rng.choice("abcd") for _ in range(200))]}
    model = langid.build_model(samples)
    texts = ["".join(rng.choice("abcdé!") for _ in range(n)) for n in (1, 5, 40, 700, 1024, 1025, 3000)]
    got, _ = langid.phrases(texts, model)
    for k, lang in enumerate(model.langs):
        ref = bytes(np.concatenate([model.encode(t + " ") for t in samples[lang]]).astype(np.uint8))
        for i, text in enumerate(texts):
            codes = bytes(model.encode(text).astype(np.uint8))
            n = 0
            for lo in range(0, len(codes), langid.BLOCK):
                at, block = 0, codes[lo : lo + langid.BLOCK]
                while at < len(block):
                    size = 1
                    while at + size < len(block) + 1 and block[at : at + size] in ref and at + size <= len(block):
                        size += 1
                    at += max(1, size - 1)
                    n += 1
            assert got[i, k] == n


def spoken(rng, letters, n):
    """Words of a made-up language: each letter is followed by one of three."""
    after = {c: rng.sample(letters, 3) for c in letters}
    words = []
    for _ in range(n):
        w = rng.choice(letters)
        while len(w) < rng.choice([3, 5, 7]):
            w += rng.choice(after[w[-1]])
        words.append(w)
    return words


def test_language_whole_result_by_brute_force():
    """Language, score and fit from phrases that a plain search finds, texts of one symbol to several blocks."""
    rng = random.Random(8)
    words = {lang: spoken(random.Random(lang), letters, 400) for lang, letters in {"a": "abcdefgh", "b": "efghijkl", "c": "дежзикл"}.items()}
    text = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    samples = {lang: [text(lang, 60) for _ in range(4)] for lang in words}
    model = langid.with_limits(langid.build_model(samples), {lang: [text(lang, 50) for _ in range(5)] for lang in words})
    texts = [text(lang, n) for lang in words for n in (1, 3, 60, 400)] + [" ".join("".join(rng.choice("qrstuvwxyz") for _ in range(6)) for _ in range(60)), "", None, "12 3", "x"]

    def greedy(text, lang):
        ref = " ".join(samples[lang]) + " "
        norm = re.sub(r"\W+", " ", text.lower())
        n = 0
        for lo in range(0, len(norm), langid.BLOCK):
            block, at = norm[lo : lo + langid.BLOCK], 0
            while at < len(block):
                size = 1
                while at + size < len(block) and block[at : at + size + 1] in ref:
                    size += 1
                at, n = at + size, n + 1
        return n, len(norm)

    langs, scores, fits = langid.classify(texts, model)
    for i, t in enumerate(texts):
        if not t or not any(c.isalpha() for c in t):
            assert (langs[i], scores[i], fits[i]) == ("und", 0.0, False)
            continue
        bits = {lang: greedy(t, lang)[0] * math.log2(len(" ".join(samples[lang])) + 2) for lang in words}
        best = min(bits, key=bits.get)
        assert langs[i] == best and abs(scores[i] - 1 / sum(2 ** (bits[best] - b) for b in bits.values())) < 1e-6
        size = greedy(t, best)[1]
        assert fits[i] == (size < langid.LEAST_SYMBOLS or bits[best] <= model.limits[sorted(words).index(best)] * size)
    assert fits[:12].all() and not fits[12] and fits[16]


def test_language_letters_labels_and_scripts(spark):
    rng = random.Random(6)
    han = [chr(0x4E00 + i) for i in range(900)]
    alphabets = {f"l{i:02}": rng.sample("abcdefghijklmnopqrstuvwxyz", 12) for i in range(45)} | {"zh": han[:600], "zx": han[300:], "hi": [chr(c) for c in range(0x905, 0x930)]}
    rows, words = [], {lang: spoken(random.Random(lang), letters, 300) for lang, letters in alphabets.items()}
    for lang in words:
        rows += [(len(rows) + k, " ".join(rng.choice(words[lang]) for _ in range(80)), lang) for k in range(12)]
    odd = [(9000, "²", None), (9001, "½ ①", None), (9002, "Ⅷ", None), (9003, "\u0301", None), (9004, " ".join(words["hi"][:3]), None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = langid.train(df)
    assert model.langs == sorted(words)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, model).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i] == lang for i, lang in held) / len(held) > 0.97
    assert [got[9000 + k] for k in range(5)] == ["und"] * 4 + ["hi"]


def test_language_keeps_short_rows_and_drops_unlearned_ones(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(documents)
    kept = {r["doc_id"] for r in langid.keep_identified(documents, model).collect()}
    assert kept >= {r["doc_id"] for r in documents.collect() if langid.has_letter(r["text"])}
    rng = random.Random(1)
    noise = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(600))
    rows = [(1, "a", "x"), (2, "on die", "x"), (3, "12 34", "x"), (4, noise, "x"), (5, noise[:60], "x"), (6, " ".join("".join(rng.choice("абвгдежзик") for _ in range(6)) for _ in range(60)), "x")]
    kept = langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, langs string"), model)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5]


def test_language_accuracy(spark, odd, empty):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict(documents, langid.train(documents)).join(documents.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").collect()
    assert len(held) > 100 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert found.where("held_out <> (crc32(cast(doc_id as string)) % 5 = 0)").count() == 0
    model = langid.train(documents)
    got = {(r["doc_id"]): (r["lang_pred"], r["score"]) for r in langid.predict(odd, model).collect()}
    assert got[0] == got[1] == got[2] == got[10] == ("und", 0.0) and got[4][0] != "und"
    assert langid.predict(empty, langid.train(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.train(empty)).collect()} == {"und"}
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {5, 6}


# 3


def test_restoring():
    words = collections.Counter({"idiot": 40, "pathetic": 30, "clown": 20, "the": 500, "coffee": 50, "committee": 10, "worthless": 9})
    model = toxicity.CharModel(words)
    for raw, want in (("1d10t", "idiot"), ("idiooooot", "idiot"), ("p@th3tic!", "pathetic"), ("cl0wn,", "clown"), ("w0rthle$$", "worthless"), ("coffee", "coffee"), ("the%%%", "the"), ("123", "123")):
        assert toxicity.restore_token(raw, model) == want
    assert toxicity.spaced("you i d i o t there") == ["idiot"]


def test_restoring_letters_apart_doubled_and_signs():
    for raw in ("you are an i d i o t.", "i d i o t, really", "(i d i o t)", "i-d-i-o-t!", "i.d.i.o.t,", "_i_d_i_o_t_", "x, i d i o t? no"):
        assert toxicity.spaced(raw) == ["idiot"], raw
    assert toxicity.spaced("don't a b, so i d i'd") == [] and toxicity.spaced("a" + "*" * 200 + "bb") == []
    model = toxicity.CharModel(collections.Counter({"idiot": 40, "stupid": 30, "ass": 20, "the": 500, "coffee": 50, "committee": 10, "asset": 9}))
    for raw, want in (("stuupid", "stupid"), ("iidiioott", "idiot"), ("4$$", "ass"), ("coffee", "coffee"), ("committee", "committee"), ("455", "455"), ("1,200", "1,200"), ("***", "")):
        assert toxicity.restore_token(raw, model) == want, raw


def test_toxicity_learns_from_whole_texts(spark):
    rng = random.Random(9)
    filler = lambda: " ".join("".join(rng.choice("abcdefghijk") for _ in range(7)) for _ in range(1500))
    rows = [(i, filler() + (" vile dolt" if i % 2 else " mild tea"), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    features = toxicity.Features(model)
    assert toxicity.score(toxicity.hits("a vile dolt", features), model) >= toxicity.THRESHOLD > toxicity.score(toxicity.hits("a mild tea", features), model)
    for text in ("you d o l t.", "(v i l e)", "ddoolltt", "viile!"):
        assert toxicity.hits(text, features), text


def test_viterbi_against_enumeration():
    model = toxicity.CharModel(collections.Counter({"idiot": 40, "coffee": 50, "abba": 3, "seat": 7}))

    def cost(text):
        ctx, s = "^" * toxicity.ORDER, 0.0
        for c in text + "$":
            s += model.logp(ctx, c)
            ctx = ctx[1:] + c
        return s

    for token in ("1d10t", "c0fffeee", "5ee4ttt", "a-b_b.a"):
        best = max(((cost("".join(p for p, _ in way)) - sum(c for _, c in way), "".join(p for p, _ in way)) for way in itertools.product(*toxicity.lattice(token))))[1]
        assert toxicity.viterbi(token, model) == best


def test_toxicity_held_out(spark, odd, empty):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(documents, labels)
    rows = toxicity.predict(documents, model).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in rows)
    assert hit / sum(r["toxic"] for r in rows) > 0.9
    assert hit / max(1, sum(r["predicted"] for r in rows)) > 0.85
    features = toxicity.Features(model)
    for text in ("you are an 1d10t", "what a p a t h e t i c thing", "sooo w0rthl3ss", "cloooown"):
        assert toxicity.score(toxicity.hits(text, features), model) >= toxicity.THRESHOLD, text
    got = toxicity.predict(odd, model).collect()
    assert len(got) == odd.count() and not any(r["predicted"] for r in got)
    assert toxicity.predict(empty, toxicity.train(empty, labels)).count() == 0
    assert {r["score"] for r in toxicity.predict(odd, toxicity.train(odd, labels.limit(0))).collect()} == {0.0}
    assert toxicity.keep_clean(odd, model).columns == odd.columns


# 4


@pytest.mark.parametrize(("shard", "pack"), [(150, 300), (20, 1 << 20)])
def test_topk_against_brute_force(spark, shard, pack):
    rng = np.random.default_rng(3)
    v = rng.integers(-3, 4, (700, 6)) / 256
    rows = [(i, [float(x) for x in v[i]], "x") for i in range(700)] + [(701, None, "x"), (702, [1.0, None], "x"), (703, [float("nan")] * 6, "x"), (704, [0.5], "x"), (705, [], "x"), (None, [1.0] * 6, "x"), (750, [float("inf")] * 6, "x"), (1 << 60, [0.25] * 6, "x"), (-(1 << 60), [0.1] * 6, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(table, shard_rows=shard, pack_bytes=pack).collect()}
    whole = {i: [math.floor(256 * x) for x in e] for i, e, _ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    want = {}
    for q in whole:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(whole[q], e)), i) for i, e in whole.items() if i != q)[:5]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert topk.search(table.limit(0)).count() == 0


def test_topk_prunes_and_stays_exact():
    rng = np.random.default_rng(4)
    rows = np.round(rng.normal(0, 1, (4000, 8)) + np.repeat(rng.normal(0, 9, (8, 8)), 500, 0)) * 10
    ids = np.arange(4000) * 3
    at, vec, sc = topk.best_k(ids[::50], rows[::50], ids, rows, 5, block=100)
    for q in range(80):
        exact = sorted((-(rows[q * 50] @ rows[i]), ids[i]) for i in range(4000) if i != q * 50)[:5]
        assert [(-s, i) for s, i in zip(sc[at == q], vec[at == q])] == [(s, i) for s, i in exact]


def test_topk_of_repeated_ids(spark):
    rows = [(5, [i / 256, 1.0]) for i in range(400)] + [(50, [1.0, 1.0]), (100, [-1.0, 1.0])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=30).orderBy("query_id", "rank").collect()
    want = {q: sorted((-(math.floor(256 * x) * math.floor(256 * v[0]) + 65536), i) for i, v in rows if i != q)[:5] for q, x in ((50, 1.0), (100, -1.0))}
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got] == [(q, k + 1, i, -s) for q in (50, 100) for k, (s, i) in enumerate(want[q])]


# 5


def test_tokens_against_the_library(spark, odd, docs, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(["<|endoftext|>a<|startoftext|> b", "don't I'LL it's", "é ́x ΣΑΣ Σ", "\x85a b 　c", "🙂🙂 100%…"])], "doc_id long, text string")
    for table in (odd.where("doc_id is not null").dropDuplicates(["doc_id"]), docs.select("doc_id", "text").union(extra)):
        got = sorted(tokenfile.roundtrip(table, path).collect(), key=lambda r: r["doc_id"])
        start = 0
        for r, want in zip(got, sorted(table.collect(), key=lambda r: r["doc_id"]), strict=True):
            ids = [*whole.encode(want["text"] or "", add_special_tokens=False).ids, 2]
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (want["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
            start += len(ids)
    assert tokenfile.roundtrip(odd, path).count() == odd.count()
    assert tokenfile.roundtrip(odd.limit(0), path).count() == 0
    same = spark.createDataFrame([(None, f"t {i}") for i in range(300)], "doc_id long, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so small a table is else one part
    tokenfile.write(same, str(tmp_path / "same"), path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    held = collections.Counter(r["part"] for r in tokenfile.read(spark, str(tmp_path / "same")).collect())
    assert len(held) > 1 and sum(held.values()) == 300 and sorted(r["start"] for r in tokenfile.roundtrip(same, path).collect())[0] == 0
    tokenfile.write(docs, str(tmp_path / "t"), path)
    one = tokenfile.read(spark, str(tmp_path / "t"), [17])
    assert [r["doc_id"] for r in one.collect()] == [17]
    assert "PushedFilters: [" in one._jdf.queryExecution().toString() and "doc_id" in one._jdf.queryExecution().toString().split("PushedFilters: [")[1].split("\n")[0]
    assert list((tmp_path / "t").glob("*.orc"))


# 6


def test_fingerprints(spark, odd, docs):
    for table in (docs, odd):
        rows = sorted(((r["doc_id"] if r["doc_id"] is not None else -(2**63), r["text"] or "") for r in table.collect()))
        got = {}
        for r in fingerprint.compare_with_next(table).collect():
            got.setdefault((r["doc_id"] if r["doc_id"] is not None else -(2**63)), []).append(r)
        assert sum(map(len, got.values())) == len(rows)
        want = collections.defaultdict(list)
        for i, (key, text) in enumerate(rows):
            other = rows[(i + 1) % len(rows)][1]
            cut = len(text) // 4
            edited = text[: len(text) - cut] + other[:cut]
            want[key].append((len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint.sketch(text).tolist(), fingerprint.sketch(edited).tolist()))
        for key, rs in want.items():
            assert sorted((r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in got[key]) == sorted(rs)
    assert fingerprint.compare_with_next(odd.limit(0)).count() == 0
    assert fingerprint.compare_with_next(docs.limit(1)).count() == 1


def test_sketch_estimates(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    a = [rng.choice(words) for _ in range(900)]
    b = a[:600] + [rng.choice(words) for _ in range(300)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    x, y = shingles(a), shingles(b)
    near = fingerprint.likeness(fingerprint.sketch(" ".join(a), 256), fingerprint.sketch(" ".join(b), 256), 256)
    assert abs(near - len(x & y) / len(x | y)) < 0.1
    parts = fingerprint.fingerprints(spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, None)], "doc_id long, text string")).withColumn("all", F.lit(1))
    whole = fingerprint.combine(parts.where("size(fingerprint) > 0"), "all").first()["fingerprint"]
    hashes = sorted(set(fingerprint.sketch(" ".join(a), 9999).tolist()) | set(fingerprint.sketch(" ".join(b), 9999).tolist()))
    assert whole == hashes[:64]
    two = parts.alias("a").join(parts.alias("b"), F.expr("a.doc_id < b.doc_id"))
    est = two.select(F.col("a.doc_id").alias("i"), F.col("b.doc_id").alias("j"), fingerprint.resemblance(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("r"), fingerprint.containment(F.col("a.fingerprint"), F.col("b.fingerprint")).alias("c"), fingerprint.distinct_count(F.col("a.fingerprint")).alias("n")).collect()
    est = {(r["i"], r["j"]): r for r in est}
    assert abs(est[1, 2]["r"] - len(x & y) / len(x | y)) < 0.2 and abs(est[1, 2]["c"] - len(x & y) / len(x)) < 0.25 and abs(est[1, 2]["n"] / len(x) - 1) < 0.4
    assert est[1, 3]["r"] == 0.0


# 7


def brute_lines(rows, shortest=linededup.SHORTEST):
    lines = []
    for doc_id, text in sorted({(d, t) for d, t in rows if t is not None}, key=lambda x: (x[0] if x[0] is not None else -(2**63), linededup.text_hash(x[1]))):
        for pos, line in enumerate(text.split("\n")):
            words = line.encode().lower().split()
            if words:
                lines.append((doc_id, text, pos, words))

    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < shortest or abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))

    return {(d, t, p) for i, (d, t, p, w) in enumerate(lines) if any(near(w, x[3]) for x in lines[:i])}


def test_lines_against_brute_force(spark, odd):
    rng = random.Random(7)
    base = [" ".join(rng.choice("abcdefghij") for _ in range(rng.choice([1, 3, 7, 8, 9, 12, 30]))) for _ in range(25)]

    def edit(line):
        w = line.split()
        for _ in range(rng.choice([0, 1, 1, 2])):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.choice([0, 1])] = rng.choice([[], ["Z"], ["q"]])
        return " ".join(w)

    rows = [(i, "\n".join(edit(rng.choice(base)) for _ in range(rng.randrange(1, 7)))) for i in range(80)]
    rows += [(3, "one two three four five six seven eight\n\n one  two three four five six seven EIGHT"), (3, rows[3][1]), (None, base[3])]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    gone = brute_lines(rows)
    assert len(gone) > 30
    got = linededup.dedup(table).collect()
    assert len(got) == len(rows)
    left = collections.Counter((r["doc_id"], r["text"]) for r in got)
    want = collections.Counter((d, "\n".join(x for p, x in enumerate(t.split("\n")) if (d, t, p) not in gone)) for d, t in rows)
    assert left == want
    out = linededup.dedup(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_kept"] and out.count() == odd.count()
    assert linededup.dedup(odd.limit(0)).count() == 0
    exact = {r["doc_id"]: r["n_kept"] for r in linededup.dedup(table, 0).collect()}
    assert sum(exact.values()) > sum(r["n_kept"] for r in got) > 0


def test_lines_with_clashing_names_null_ids_and_a_template(spark):
    line = "one two three four five six seven eight nine"
    rows = [(None, f"{line} {i}\n\nown {i}", i, "k", 1, 2) for i in range(30)] + [(None, f"{line} 3\n\nown 3", 3, "k", 1, 2), (5, line, 0, None, None, None), (6, None, 0, "k", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _key long, _gone string, n_lines long, by long").repartition(4)
    got = linededup.dedup(df)
    assert got.columns == ["doc_id", "text", "_key", "_gone", "by", "n_lines", "n_kept"]
    gone = brute_lines([r[:2] for r in rows])
    want = collections.Counter((d, t if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (d, t, p) not in gone)) for d, t, *_ in rows)
    assert collections.Counter((r["doc_id"], r["text"]) for r in got.collect()) == want
    named = linededup.dedup(df, counts=("a", "b"))
    assert named.columns == [*df.columns, "a", "b"] and sorted(r["n_lines"] for r in named.collect() if r["n_lines"] is not None) == [0] + [1] * 31
    few = spark.createDataFrame([(1, "a b c d\na b c x")], "doc_id long, text string")
    assert [r["n_kept"] for r in linededup.dedup(few, shortest=8).collect()] == [2] and [r["n_kept"] for r in linededup.dedup(few).collect()] == [1]


# 8


@pytest.mark.parametrize("apart", [False, True])
def test_backoff_against_brute_force(spark, odd, apart):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("the of a cat dog sat On on mat unique".split()) for _ in range(rng.randrange(0, 12)))) for i in range(60)] + [(99, None), (7, "zebra"), (None, "the cat"), (98, "zebra the")]
    got = collections.Counter((r["doc_id"], r["n_words"], None if r["log_score"] is None else round(r["log_score"], 9)) for r in ngramlm.score(spark.createDataFrame(rows, "doc_id long, text string"), apart).collect())
    tokens = [(d, (t or "").lower().split()) for d, t in rows]
    grams = lambda w: collections.Counter(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    all_ = sum((grams(w) for _, w in tokens), collections.Counter())
    total = sum(len(w) for _, w in tokens)
    want = collections.Counter()
    for d, w in tokens:
        f = all_.copy()
        if apart:
            f.subtract(grams(w))
        s = 0.0
        for i in range(len(w)):
            tri, bi = tuple(w[i - 2 : i + 1]), tuple(w[i - 1 : i + 1])
            if i > 1 and f[tri] > 0:
                s += math.log(f[tri] / f[tri[:2]])
            elif i > 0 and f[bi] > 0:
                s += math.log(0.4 * f[bi] / f[bi[:1]])
            else:
                s += math.log(0.16 * max(f[(w[i],)], 0.5) / (total - len(w) * apart))
        want[(d, len(w), round(s, 9) if w else None)] += 1
    assert got == want
    assert ngramlm.score(odd, apart).count() == odd.count() and ngramlm.score(odd.limit(0), apart).count() == 0


def test_large_counts_are_kept():
    for x in ([0, 1, 255], [256, 1 << 33], [(1 << 40) + 7], []):
        assert ngramlm.unpack_counts(ngramlm.pack_counts(np.array(x, np.int64))).tolist() == x


# 9


def check_packing(rows, capacity):
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r)
    for b in bins.values():
        assert sum(r["size"] for r in b) <= capacity
        assert sorted(r["bin_pos"] for r in b) == list(range(len(b)))
    return bins


def test_best_fit_against_scan():
    rng = random.Random(3)
    pieces = sorted(((rng.randrange(1, 60), rng.choice("abcd"), rng.choice([None, 1, 2, 3, 4, 5, 6])) for _ in range(300)), key=lambda p: -p[0])
    bins, want = [], []
    for size, s, c in pieces:
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= size and s not in b["s"] and (c is None or c not in b["c"])]
        i = min(fits)[1] if fits else len(bins)
        if i == len(bins):
            bins.append({"left": 100, "s": set(), "c": set()})
        bins[i]["left"] -= size
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
        want.append(i)
    assert packing.best_fit(pieces, 100) == want


def test_packing_is_whole(spark, odd, docs):
    table = docs.unionByName(docs.limit(20))
    rows = packing.packed_documents(table, shard=50).collect()
    size = {r["doc_id"]: len((r["text"] or "").split()) + 1 for r in docs.collect()}
    source = {r["doc_id"]: (r["source"], r["text"]) for r in docs.collect()}
    for b in check_packing(rows, packing.CAPACITY).values():
        assert len({source[r["doc_id"]][0] for r in b}) == len(b) and len({source[r["doc_id"]][1] for r in b}) == len(b)
    got = collections.Counter()
    for r in rows:
        got[r["doc_id"]] += r["size"]
    twice = {r["doc_id"] for r in docs.limit(20).collect()}
    assert got == {d: n * (1 + (d in twice)) for d, n in size.items()}
    rows = packing.packed_documents(odd).collect()
    check_packing(rows, packing.CAPACITY)
    assert collections.Counter(r["doc_id"] for r in rows if r["piece"] == 0) == collections.Counter(r["doc_id"] for r in odd.collect())
    assert packing.packed_documents(odd.limit(0)).count() == 0


def test_packing_whole_result_by_a_plain_scan(spark):
    rng = random.Random(12)
    rows = [(i, rng.randrange(1, 900) if i % 9 else 5000 + i, rng.choice(["a", "b", None]), rng.choice(["x", "y", "z", None])) for i in range(120)] + [(7, 300, "a", "x")] * 900
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, size long, source string, cluster string").repartition(3), 1000, 250).collect()
    assert len({r["shard"] for r in got}) > 3 and max(collections.Counter(r["shard"] for r in got).values()) < 700
    bins = check_packing(got, 1000)
    size, about = collections.Counter(), {r[0]: r[2:] for r in rows}
    for r in got:
        size[r["doc_id"]] += r["size"]
    assert size == sum((collections.Counter({r[0]: r[1]}) for r in rows), collections.Counter())
    for b in bins.values():
        for which in (0, 1):
            held = [about[r["doc_id"]][which] for r in b if about[r["doc_id"]][which] is not None]
            assert len(held) == len(set(held))
    for shard in {r["shard"] for r in got}:  # the tightest bin that holds a piece, and is free of its source and cluster
        rest = sorted((r for r in got if r["shard"] == shard and not (r["size"] == 1000 and r["bin_pos"] == 0)), key=lambda r: (-r["size"], [], 0))
        open_ = []
        sizes = collections.Counter()
        for r in rest:
            s, c = about[r["doc_id"]]
            fits = [b for b in open_ if b["left"] >= r["size"] and (s is None or s not in b["s"]) and (c is None or c not in b["c"])]
            b = min(fits, key=lambda b: b["left"], default=None)
            if b is None:
                b = {"left": 1000, "s": set(), "c": set()}
                open_.append(b)
            b["left"] -= r["size"]
            b["s"].add(s)
            b["c"].add(c)
            sizes[r["size"]] += 1
        assert abs(len(open_) - len({r["bin_id"] for r in rest})) <= max(1, len(open_) // 20)


# 10


def brute_components(rows, n, num, den):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and min(len(a), len(b)) * den >= num * max(len(a), len(b)) and den * len(a & b) >= num * len(a | b):
            parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(d, low.get(root(i), d))
    return collections.Counter((d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80)])
def test_join_against_brute_force(spark, n, num):
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(4000)}"
    rows = []
    for size in (1, 2, 3, 4, 5, 6, 7, 9, 12, 20, 40, 80, 150, 300):
        for _ in range(4):
            base = [word() for _ in range(size)]
            rows.append(base)
            for _ in range(6):
                copy = list(base) if rng.random() < 0.6 else list(rows[-1])
                for _ in range(rng.randrange(0, 2 + size // 40)):
                    i = rng.randrange(len(copy) + 1)
                    copy[i : i + rng.choice([0, 1])] = [word() for _ in range(rng.choice([0, 1]))]
                rows.append(copy)
    rng.shuffle(rows)
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)] + [(9000, None), (9001, "  "), (9002, "Same Words here"), (9003, "same words here")]
    got = ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), n, num)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows, n, num, 100)


def test_join_on_documents(spark, odd, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngramjoin.join(docs).collect())
    assert got == brute_components(rows, 4, 85, 100)
    found = ngramjoin.join(odd).collect()
    assert len(found) == odd.count() and {r["component_id"] for r in found if r["doc_id"] in (6, 7)} == {6}
    assert ngramjoin.join(odd.limit(0)).count() == 0
    kept = ngramjoin.keep_one(odd)
    assert kept.columns == odd.columns and 7 not in {r["doc_id"] for r in kept.collect()} and 6 in {r["doc_id"] for r in kept.collect()}


def test_keep_one_of_repeated_rows_and_ids(spark):
    rng = random.Random(3)
    base = {k: [f"{k}{rng.randrange(10**6)}" for _ in range(60)] for k in "abcd"}
    text = {k: " ".join(w) for k, w in base.items()} | {k.upper(): " ".join([*w[:-1], "end"]) for k, w in base.items()}
    rows = [(1, text["a"], "x"), (1, text["a"], "x"), (1, text["a"], "y")]  # repeated rows
    rows += [(2, text["A"], "x"), (2, text["b"], "x")]  # one text a near copy of id 1, the other alone
    rows += [(3, text["c"], "x"), (3, text["C"], "x"), (3, text["d"], "x"), (4, text["D"], "x")]  # near copies of one id; a component beside them with the same smallest id
    rows += [(5, "", "x"), (5, "", "x"), (5, " ", "x"), (6, None, "x"), (6, None, "x"), (None, text["a"], "x"), (None, text["a"], "x")]
    rows += [(2, text["b"].upper(), "x")]  # another text of one set
    df = spark.createDataFrame(rows, "doc_id long, text string, ref string").repartition(5)
    kept = [tuple(r) for r in ngramjoin.keep_one(df).collect()]
    assert set(kept) <= set(rows)
    head = {k: " ".join(w[:-1]) for k, w in base.items()}
    named = collections.Counter((d, next((k for k in head if (t or "").lower().startswith(head[k])), t)) for d, t, _ in kept)
    assert named == collections.Counter({(1, "a"): 1, (2, "b"): 1, (3, "c"): 1, (3, "d"): 1, (5, ""): 1, (5, " "): 1, (6, None): 1, (None, "a"): 2})
    assert sorted(map(repr, kept)) == sorted(repr(tuple(r)) for r in ngramjoin.keep_one(df.repartition(2)).collect())
    some = [(d, t) for d, t, _ in rows if d is not None]
    found = ngramjoin.join(df.where("doc_id is not null"), 5, 80).collect()
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found) == brute_components(some, 5, 80, 100)


def test_copies_are_signed_once_a_task_and_dealt_out(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(i, text) for i in range(500)] + [(1000, text + " more")], "doc_id long, text string").repartition(4)
    rows = ngramjoin._signed(df, 4, 85, 100, 3).collect()
    mine = [r for r in rows if r["doc_id"] is not None]
    assert len(mine) == 501 and len({r["sig"] for r in mine}) == 501
    assert max(collections.Counter(r["sig"] for r in rows if r["doc_id"] is None).values()) <= 5
    assert {r["component_id"] for r in ngramjoin.join(df).collect()} == {0}


def test_large_groups_are_flushed(spark, monkeypatch):
    rows = [(i, f"a b c d e f g h i j k l m n o p q r s t u v w x y z {i}" ) for i in range(300)]
    monkeypatch.setattr(ngramjoin, "LARGE", 40)
    got = {r["component_id"] for r in ngramjoin.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0}


def workers_of_a_task(node, above=0):
    """The most Python nodes that one task of the plan feeds one from another."""
    here = 0 if node.nodeName() in ("Join", "Aggregate", "RepartitionByExpression") else above + (node.nodeName() == "MapInArrow")
    return max([above, here, *(workers_of_a_task(node.children().apply(i), here) for i in range(node.children().size()))])


def test_line_tasks_have_one_python_worker(spark):
    df = spark.createDataFrame([(1, "a b c\nd e f"), (2, "a b x\nd e f"), (3, None)], "doc_id long, text string")
    out = linededup.dedup(df)
    assert workers_of_a_task(out._jdf.queryExecution().optimizedPlan()) == 1
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_kept"]) for r in out.collect()} == {1: ("a b c\nd e f", 2, 2), 2: ("", 2, 0), 3: (None, 0, 0)}


def test_parted_texts_encode_alike():
    encoder = tokenfile.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["Ab, cd. EF.", "a.. b ., c,.", "Été, ÉTÉ. ß. x'S, it's.", "5, 6. a5, a_b.", "<|ENDOFTEXT|> A, <|endoftext|>. B,", "Ｆ, Ｇ. A.", "İ. A,", "µ, ª. º,\xa0\x85x.", "a.\n\nB,\tc", "", ".", ",", " . ", "Å, A\u030a, e\u0301."]
    rng = random.Random(3)
    odd += ["".join(rng.choices(["a", "B", "é", "Ü", "1", ",", ".", " ", "\n", "'s", "'", "!", "_", "<|", "中", "\u0301", "\xa0"], k=12)) for _ in range(3000)]
    assert [x.tolist() for x in encoder.encode(odd)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in odd]
    # words are known once, whatever their case and the stop after them
    new = tokenfile.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    new.encode(["Word, WORD. word"])
    assert set(new) == {"word", ",", "."}


# all


def test_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    for name, sql in queries.SQL.items():
        want = con.sql(sql).df()
        got = queries.QUERIES[name](spark, "/root/testdata/sf0.01").toPandas()[list(want.columns)]
        keys = list(want.columns)
        assert got.sort_values(keys).reset_index(drop=True).astype(str).equals(want.sort_values(keys).reset_index(drop=True).astype(str)), name


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf_dir)
        assert after.dtypes == docs.dtypes, name
        assert set(r[0] for r in after.select("doc_id").collect()) <= set(r[0] for r in before.select("doc_id").collect())
        if name == "line_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            gone = brute_lines(rows, corpus_pipeline.SHORTEST_LINE)
            want = {d: "\n".join(x for p, x in enumerate(t.split("\n")) if (d, t, p) not in gone) for d, t in rows}
            lost = {d for d, t in rows if t.split() and all((d, t, p) in gone for p, x in enumerate(t.split("\n")) if x.split())}
            assert {r["doc_id"]: r["text"] for r in after.collect()} == {d: t for d, t in want.items() if d not in lost}
            assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in after.collect()} == {c for _, _, c in brute_components(rows, 5, 80, 100)}
        before = spark.createDataFrame(after.collect(), docs.schema)
    rows = corpus_pipeline.STAGES[-1][1](spark, before, sf_dir).collect()
    check_packing(rows, packing.CAPACITY)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in before.collect()}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, rows))
    assert re.fullmatch("[a-z_]+", corpus_pipeline.STAGES[0][0])


def test_sentencepiece_thresholds_of_any_batch():
    vocab = sentencepieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    units = ["▁there", "▁internationalisation", "▁a", "▁unbelievable", "▁straße", "▁wonderful", "▁日本語", "▁thththere"]

    def thresholds(encoder, unit):
        begins, first, upto, to, code = encoder.known
        row, out = encoder.end[unit], []
        while True:
            edges = upto[first[row] : first[row] + 40].tolist()
            out.append(edges[: next((i for i, x in enumerate(edges) if x >= 2), 0) + 1])
            if begins[row]:
                return out
            row -= 1

    alone = []
    for u in units:
        encoder = sentencepieces.Encoder(vocab)
        encoder.add([u])
        alone.append(thresholds(encoder, u))
    together = sentencepieces.Encoder(vocab)
    together.add(["▁others"] + units[::-1])
    assert [thresholds(together, u) for u in units] == alone


def test_topk_of_large_components(spark):
    big = 2.0**20 + 1 / 256
    rows = [(50, [big, 1.0]), (1, [big, 1 / 256]), (2, [big, 2 / 256]), (3, [-big, 0.0]), (4, [1e300, 0.0]), (5, [1e300, 1.0]), (100, [1.0, 2.0]), (6, [1.7e308, 0.0])]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=3).collect()}
    ints = {i: [math.floor(256 * int(x)) if abs(x) > 1e15 else math.floor(256 * x) for x in v] for i, v in rows if 256 * max(v) < math.inf}
    for q in (50, 100):
        order = sorted((-max(-(10**38 - 1), min(10**38 - 1, sum(x * y for x, y in zip(ints[q], v)))), i) for i, v in ints.items() if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, max(-(2**63), min(2**63 - 1, -s))) for s, i in order]


def test_fingerprint_text(spark, odd):
    for r in fingerprint.compare_with_next(odd).withColumn("text", fingerprint.as_string("fingerprint")).withColumn("back", fingerprint.from_string(F.col("text"))).collect():
        assert r["back"] == r["fingerprint"] and r["text"] == ",".join(map(str, r["fingerprint"]))


def test_toxicity_learns_from_all_rows(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("bdfgklmnprstvz") for _ in range(4))
    rows = [(i, " ".join([word(), word(), *(["dolt"] if i < 2400 or i % 40 == 0 else []), word(), word()]), int(i < 2400)) for i in range(6800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    taught = [(text, toxic) for i, text, toxic in rows if zlib.crc32(str(i).encode()) % 4 != 2 and "dolt" in text]
    assert model.words["dolt"] == toxicity.lower_bound(sum(toxic for _, toxic in taught), sum(not toxic for _, toxic in taught))


def test_language_learns_from_all_rows(spark):
    """The words of the automata and the limits, from counts over all labelled rows that aren't held out."""
    rng = random.Random(9)
    spoke = {lang: spoken(random.Random(lang), letters, 300) for lang, letters in {"a": "abcdefgh", "b": "efghijkl"}.items()}
    rows = [(i, " ".join(rng.choice(spoke[lang]) for _ in range(30)), lang) for i in range(900) for lang in ["ab"[i % 2]]]
    rows += [(1000 + i, "xyzzy " * 40 + "q" * 30, "a") for i in range(30)] + [(2000, None, "a"), (2001, "dolt", None), (2002, "12", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = [(lang, text) for i, text, lang in rows if text and lang and zlib.crc32(str(i).encode()) % 5 != 0]
    halves = {r["text"]: r["half"] for r in df.select("text", F.expr("pmod(xxhash64(text), 2)").alias("half")).collect()}
    counts = {(part, lang): collections.Counter() for part in (0, 1, 2) for lang in spoke}
    for lang, text in taught:
        for part in (halves[text], 2):
            counts[part, lang].update(w for x in text.split() if x.isalpha() for w in ([x] if len(x) <= 24 else [x[k : k + 8] for k in range(0, len(x), 8)]))
    assert counts[2, "a"]["xyzzy"] > 800 and counts[2, "a"]["qqqqqqqq"] > 60
    texts = {k: " ".join(sorted(c, key=lambda w: (-c[w], w))) for k, c in counts.items()}
    model, want = langid.train(df), langid.build_model({lang: [texts[2, lang]] for lang in spoke})
    for name in ("langs", "points", "base", "owner", "target", "roots", "first", "bits"):
        assert np.array_equal(getattr(model, name), getattr(want, name)), name
    other = {k: langid.build_model({k[1]: [t]}) for k, t in texts.items()}
    for k, lang in enumerate(model.langs):
        need = []
        for text in {t for of, t in taught if of == lang and langid.has_letter(t)}:
            half = other[1 - halves[text], lang]
            count, sizes = langid.phrases([text], half)
            need.append(count[0, 0] * half.bits[0] / sizes[0])
        assert abs(model.limits[k] - langid.MOST_BITS * np.median(need)) < 2 / langid.STEPS
    # of the most frequent words about so many characters are taken
    some = langid.frequent(spark.createDataFrame([("a", w, n, 0) for w, n in counts[2, "a"].items()], "lang string, word string, a long, b long"), 200)[0, "a"].split(" ")
    assert some[0] == "xyzzy" and 150 < len(" ".join(some)) < 250
    assert min(counts[2, "a"][w] for w in some) >= max(n for w, n in counts[2, "a"].items() if w not in some)


def test_toxicity_restores_only_what_may_hold_a_feature(spark, monkeypatch):
    rng = random.Random(11)
    chars = toxicity.CharModel(collections.Counter({"idiot": 40, "stupid": 30, "the": 500, "coffee": 50, "committee": 10, "loser": 9, "ass": 5}))
    model = toxicity.ToxicModel({"idiot": 0.9, "loser": 0.8, "ass": 0.7}, {"stup": 0.9, "stupid": 0.95, "commit": 0.7}, 0.1, chars)
    tokens = ["".join(rng.choice([c, c, c + c, c * 3, {"i": "1", "o": "0", "s": "$", "e": "3", "a": "@"}.get(c, c), c + rng.choice("*.-!")]) for c in w) for w in ["idiot", "stupidly", "losers", "loser", "coffee", "committees", "ass", "pass", "a"] * 40]
    tokens += ["", "!!!", "***", "ß", "123", "1", "a" * 500, "coffee" * 50, "$$$"]
    features = toxicity.Features(model)
    plain = [features.of_word(toxicity.restore_token(t, chars)) for t in tokens]
    decoded = []
    viterbi = toxicity.viterbi
    monkeypatch.setattr(toxicity, "viterbi", lambda token, m: decoded.append(token) or viterbi(token, m))
    assert [features[t] for t in tokens] == plain and len(set(plain)) > 5
    assert decoded and not any("ff" in t for t in decoded)
    # words and stems as plain search finds them
    words = {w[:n] for w in ("idiot", "stupidly", "stuck", "committee", "loser", "losers", "ass") for n in range(len(w) + 1)}
    for w in words:
        want = w if w in model.words else max((s + "~" for s in model.stems if w.startswith(s)), key=lambda f: model.stems[f[:-1]], default=None)
        assert features.of_word(w) == want


def test_tokens_of_words_with_signs():
    """Letters and the signs after them are encoded apart, to the ids of the tokenizer's whole chain."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, whole = tokenfile.WordEncoder(path), tokenfile.WordEncoder(path)
    signs = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    ends = [*signs, *("".join(x) for x in itertools.product(signs, repeat=2)), "###", ".%%%", "<|", "|>", "<|>", "_-'s", "'s", "'t"]
    words = [core + end for core in ("oninea", "Éoure", "s", "X", "endoftext") for end in ends] + ["<|endoftext|>", "a<|endoftext|>", "a'll", "a.'ll"]
    for word in words:
        assert encoder[word] == whole.whole(word), word
    assert {"oninea", "###", ".%%%"} <= encoder.cores.keys()


def test_tokens_of_letters_are_made_once(monkeypatch):
    """Letters already met as a word, or as the word before signs, aren't encoded again, also after the words were set aside."""
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, whole, made = tokenfile.WordEncoder(path), tokenfile.WordEncoder(path), []
    letters = tokenfile.WordEncoder.letters
    monkeypatch.setattr(tokenfile.WordEncoder, "letters", lambda self, low: made.append(low) or letters(self, low))
    monkeypatch.setattr(tokenfile, "CACHE", 9)
    for word in ("oninea", "Oninea", "oninea.", "éoure!?", "éoure", "ONINEA)", "x'", "it's", "d1", "oninea...", "Oninea-", "ÉOURE", "ﬁn", "ǅ", "İ!", "ſ.", "µ", "ª."):
        assert encoder[word] == whole.whole(word), word
    assert made == ["oninea", "éoure"] and encoder.before


def test_language_counts_given_on_in_parts():
    """Counts don't depend on where batches end, nor on how many words a worker holds; it holds few."""
    import pyarrow as pa

    rng = random.Random(12)
    rows = [(rng.choice("ab"), rng.randrange(2), " ".join(f"{rng.choice('xyz')}{rng.choice('uvw') * rng.randrange(9)}" for _ in range(20)) + rng.choice(["", " 12", " ß"])) for _ in range(3000)]
    want = collections.Counter((lang, half, w) for lang, half, text in rows for w in langid.words(text) if w)
    for size, most in ((3000, 10**6), (700, 40), (1, 10**6)):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[lo : lo + size], strict=True), (pa.string(), pa.int32(), pa.string()), strict=True)], ["lang", "half", "text"]) for lo in range(0, len(rows), size)]
        got, given = collections.Counter(), list(langid._tally(iter(batches), most))
        for lang, word, *n in (r for b in given for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            got.update({(lang, k, word): x for k, x in enumerate(n) if x})
        assert got == want and len(given) == (2 if most > 40 else 2 * 13)
    assert list(langid._tally(iter([]))) == []
