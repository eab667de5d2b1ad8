"""Passages, spelling variants and alignments against plain versions."""

import bisect
import collections
import hashlib
import random
import re
import zlib

import public_tokenizers
import pytest

from postloom.llm import alignment, common, passages, spelling

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = "doc_id long, text string, lang string, word string, n long, key long, piece long, block long"


def table(spark, rows):
    """Rows of (doc_id, text) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "w", 1, 2, 3, 4) for i, t in rows], COLUMNS).repartition(3)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 11


def plain_passages(rows, window):
    first = {}
    low = -(1 << 63)
    for i, t in rows:
        ws = words_of(t)
        for k in range(len(ws) - window + 1):
            w = tuple(ws[k : k + window])
            first[w] = min(first.get(w, 1 << 63), low if i is None else i)
    out = []
    for i, t in rows:
        ws = words_of(t)
        gone = set()
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < (low if i is None else i):
                gone.update(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((i, len(ws), len(gone), kept))
    return collections.Counter(out)


def got_passages(found):
    return collections.Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in found.collect())


@pytest.mark.parametrize(("window", "gram", "shard"), [(50, 25, 60_000), (6, 3, 40), (4, 4, 1_000)])
def test_passages_against_all_windows(spark, window, gram, shard):
    rng = random.Random(window)
    vocabulary = [f"w{k}" for k in range(4 if window < 50 else 60)]
    passage = [rng.choice(vocabulary) for _ in range(window + 13)]
    line = [rng.choice(vocabulary) for _ in range(window - 2)]
    rows = []
    for i in range(60):
        ws = [rng.choice(vocabulary) for _ in range(rng.randrange(0, 3 * window))]
        for put in (passage, line, passage[3:], passage[:-4]):
            if rng.random() < 0.4:
                at = rng.randrange(len(ws) + 1)
                ws[at:at] = put
        rows.append((rng.randrange(50), rng.choice([" ", "  ", "\n", "\t"]).join(ws)))
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, rows[6][1]), (7, None), (8, ""), (9, " \n "), (10, rows[4][1]), (11, "Wort wort " * 40)]
    assert got_passages(passages.kept(table(spark, rows), window, gram, shard)) == plain_passages(rows, window)


def test_passages_hot_and_long(spark):
    rng = random.Random(3)
    def fresh(n):
        return [f"u{rng.randrange(10**9)}" for _ in range(n)]

    passage, line = fresh(80), fresh(45)
    rows = [(i, " ".join(fresh(20) + (passage if i % 2 else line) + fresh(20))) for i in range(200)]
    long = " ".join(fresh(150_000))  # more than a megabyte
    rows += [(500, long), (501, "x " + long), (502, "same text " * 60), (503, "same text " * 80)]
    found = passages.kept(table(spark, rows))
    assert got_passages(found) == plain_passages(rows, 50)
    assert passages.kept(table(spark, rows).limit(0)).count() == 0
    # one anchor of more runs than a shard holds
    assert got_passages(passages.kept(table(spark, rows[:60]), shard_words=100)) == plain_passages(rows[:60], 50)


def test_automaton_against_search():
    rng = random.Random(1)
    for _ in range(60):
        runs = [([rng.randrange(3) for _ in range(rng.randrange(1, 30))], rng.randrange(9)) for _ in range(6)]
        shard = passages.Automaton()
        for run, key in runs:
            shard.add(run, key)
        shard.close()
        text = [rng.randrange(3) for _ in range(60)]
        for w in (1, 2, 4, 7):
            want = [min((k for r, k in runs if any(r[j : j + w] == text[i : i + w] for j in range(len(r) - w + 1))), default=1 << 63) for i in range(len(text) - w + 1)]
            assert shard.first(text, w) == want


# 12


def plain_words(rows):
    n = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    n = plain_words(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def got_variants(found):
    rows = found.collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}


@pytest.mark.parametrize("bucket", [1, 4, 32])
def test_spelling_against_all_pairs(spark, bucket):
    rng = random.Random(bucket)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randrange(5, 9))) for _ in range(12)] + ["internation", "x" * 300]
    def slip(w):
        at = rng.randrange(len(w) + 1)
        return rng.choice([w[:at] + rng.choice("abéÀ") + w[at:], w[:at] + w[at + 1 :], w[:at] + "b" + w[at + 1 :]])

    # words that all share a start: keys that must be cut again
    words = stems + [slip(rng.choice(stems)) for _ in range(60)] + ["zzzzz" + a + b for a in "abcdefghi" for b in "abcdefghi"]
    rows = []
    for i in range(150):
        chosen = [rng.choice(words) if rng.random() < 0.7 else rng.choice(words[:14]) for _ in range(30)]
        rows.append((i, rng.choice([" ", ", ", "7", "×\n"]).join(w.upper() if rng.random() < 0.1 else w for w in chosen)))
    rows += [rows[0], (None, rows[1][1]), (None, None), (3, None), (4, ""), (5, "12 34"), (6, "Ünïcödé " * 5)]
    want = plain_variants(rows)
    assert any(r[2] not in (r[0], r[1]) for r in want)  # chains of forms
    assert got_variants(spelling.variants(table(spark, rows), bucket=bucket)) == want


def test_spelling_chains_and_empty(spark):
    # each word twice as frequent as the one before
    words = ["a" * k + "b" * (17 - k) for k in range(1, 11)]
    rows = [(None, " ".join([w] * (3 << k))) for k, w in enumerate(words)]
    found = {r["word"]: r for r in spelling.variants(table(spark, rows)).collect()}
    want = {r[0]: r for r in plain_variants(rows)}
    assert {w: (r["form"], r["root"]) for w, r in found.items()} == {w: r[1:3] for w, r in want.items()}
    assert spelling.variants(table(spark, rows).limit(0)).count() == 0


# 13

TEXTS = [None, "", " ", "  ", "\n", "a", " a b", "Ünï cödé \x1c\x1d tabs\tand\r\nlines\n\nmore  spaces \n", "word " * 3000, "x" * 5000, "日本語 テキスト 🙂🙂 é", "%%% *** 123 it's we'll", "odd ▁ piece", "<s> </s> <|endoftext|> <0x0A> <unk>", "\x00nul  nbsp sep 　wide", " x \x85y", "end\n", "\nstart", "a\n b\n\tc ​ d"]


def plain_alignments(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    alphabet = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(sorted(set(range(256)) - set(shown)))}
    each, counts = [], collections.Counter()
    for i, text in rows:
        none = (i, 0, 0, 0, [], "")
        if not text:
            each.append(none)
            continue
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_x = [bytes(alphabet[c] for c in a.id_to_token(k)) for k in x]
        raw_y = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
        if not b"".join(raw_x) == b"".join(raw_y) == (" " + text).encode():
            each.append(none)
            continue
        ends = []
        for raws in (raw_x, raw_y):
            at = 0
            ends.append([at := at + len(r) for r in raws])
        both = sorted(set(ends[0]) & set(ends[1]))
        groups, lo = [], (0, 0)
        for end in both:
            hi = bisect.bisect_right(ends[0], end), bisect.bisect_right(ends[1], end)
            groups.append((x[lo[0] : hi[0]], y[lo[1] : hi[1]]))
            lo = hi
        links = [(p, q) for g, h in groups for p in g for q in h]
        counts.update(set(links))
        text_ = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        each.append((i, len(x), len(y), len(groups), links, hashlib.sha256(text_.encode()).hexdigest()))
    best = collections.defaultdict(int)
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    return collections.Counter((i, n_a, n_b, n, len(links), sum(counts[k] == best[k[0]] for k in links), sum(counts[k] for k in links), digest) for i, n_a, n_b, n, links, digest in each)


def got_alignments(found):
    return collections.Counter(tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in found.collect())


def test_alignment_against_offsets(spark, sf_dir):
    rng = random.Random(2)
    alphabet = "ab eé\n\t .,'19日🙂 ́"
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))) for i in range(300)]
    rows += [rows[8], (None, "a b"), (None, None), (5, "the long one " * 90_000)]
    assert got_alignments(alignment.align(table(spark, rows), A, B, block_links=50)) == plain_alignments(rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    own = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got_alignments(alignment.align(docs, A, B)) == plain_alignments(own)
    assert alignment.align(docs.limit(0), A, B).count() == 0


def test_alignment_whatever_is_remembered(spark, monkeypatch):
    own = alignment.Aligner(A, B)
    monkeypatch.setattr(alignment, "CACHE", 3)
    monkeypatch.setattr(alignment, "TRANSITIONS", 5)
    forgetful = alignment.Aligner(A, B)
    texts = [t for t in TEXTS if t] * 2
    assert own.rows(texts) == [forgetful.rows([t])[0] for t in texts]


def test_transducer_sides():
    moves = alignment.Transducer([b"a", b"ab", b"c"], [b"a", b"b", b"bc", b"abc", b"x"])
    assert moves.groups([0, 0], [0, 0]) == [([0], [0]), ([0], [0])]
    assert moves.groups([1, 2], [0, 2]) == [([1, 2], [0, 2])]
    assert moves.groups([1, 2], [3]) == [([1, 2], [3])]
    assert moves.groups([1], [0]) is None
    assert moves.groups([0], [4]) is None
    assert moves.groups([0], [0, 1]) is None
    assert moves.moves[0, b"ab", 0] == (0, b"b")
    assert moves.moves[0, b"b", 2] == (1, b"c")


# what operators store


def test_stored_tables_are_cleared(spark):
    common.clear_stored(spark)
    kept = common.stored(spark.range(5), "five")
    path = kept.inputFiles()[0]
    assert kept.count() == 5 and path.startswith("file:" + common.shared_dir(spark).removeprefix("file:").replace("//", "/")[:1])
    assert common.clear_stored(spark) == 1 and common.clear_stored(spark) == 0
    assert common.stored(spark.range(3), "three").count() == 3
