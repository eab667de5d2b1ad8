"""Stupid-backoff scores from corpus-wide n-gram counts.

A document's words are scored in turn: f(w1 w2 w3) / f(w1 w2) where the trigram occurs,
else ALPHA f(w2 w3) / f(w2) where the bigram does, else ALPHA^2 f(w3) / N, and half a
count for a word that occurs nowhere.  The counts f and N are of the whole table; with
leave_one_out they are of all other rows, less the row's own, and backing off is common.

Documents are dealt into blocks; a block explodes into its distinct n-grams and their
counts, packed by hash range (bucket): that is what is shuffled.  A bucket sums them to
its part of the count table, joins that to the blocks' n-grams and sends each block the
sums; a block then adds up the logarithms per document.

N-grams are known by hashes of HASH_BITS bits.  Among 10^9 different n-grams about one in
4 * 10^6 shares its hash with another, among 10^13 one in 450; such counts are too high.
More bits are shuffled as they are: eight more take half the input's size.

Defined cases: null and empty texts have 0 words and a null score, as has, with
leave_one_out, every row where no other row has a word; repeated rows each count as
another row, and those equal in doc_id and text are of one block; a null doc_id is scored like any other; empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import ngram_hashes, partitions, word_hashes

ALPHA, ORDER = 0.4, 3
HASH_BITS, PLANES = 52, 7
#: Characters of a block, n-grams (with repeats) of a bucket.
BLOCK_CHARS, BUCKET_NGRAMS = 12_000_000, 3_000_000


def pack(x: np.ndarray) -> bytes:
    """Ascending integers below 2^HASH_BITS as byte planes, of which the high ones compress well."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:PLANES].tobytes()


def unpack(raw: bytes) -> np.ndarray:
    n = len(raw) // PLANES
    out = np.zeros((8, n), np.uint8)
    out[:PLANES] = np.frombuffer(raw, np.uint8).reshape(PLANES, n)
    return np.ascontiguousarray(out.T).view("<u8").ravel()


def pack_counts(x: np.ndarray) -> bytes:
    """Counts as byte planes, of as many bytes as the largest needs; their number comes first."""
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes()


def unpack_counts(raw: bytes) -> np.ndarray:
    width, n = raw[0], (len(raw) - 1) // raw[0]
    out = np.zeros((8, n), np.uint8)
    out[:width] = np.frombuffer(raw, np.uint8, offset=1).reshape(width, n)
    return np.ascontiguousarray(out.T).view("<i8").ravel()


def document_ngrams(text: str | None) -> list[np.ndarray]:
    """Hashes of the text's n-grams of 1, 2 .. ORDER words."""
    words = word_hashes(text)
    return [ngram_hashes(words, n) >> np.uint64(64 - HASH_BITS) for n in range(1, ORDER + 1)]


def backoff(counts: list[np.ndarray], total: float) -> float:
    """Sum of the logarithms; counts[n - 1]: of the n-grams in order."""
    uni, n = counts[0], len(counts[0])
    score = 2 * math.log(ALPHA) + np.log(np.maximum(uni, 0.5) / total)
    for order in range(2, ORDER + 1):
        if n < order:
            break
        here, context = counts[order - 1], counts[order - 2][: n - order + 1]
        seen = here > 0
        better = np.log(np.where(seen, here, 1) / np.where(seen, context, 1)) + (ORDER - order) * math.log(ALPHA)
        score[order - 1 :] = np.where(seen, better, score[order - 1 :])
    return float(score.sum())


def score(documents: DataFrame, leave_one_out: bool = False) -> DataFrame:
    """doc_id, n_words, log_score and mean_log_score of every row, by the counts of the whole table or of all other rows."""
    spark = documents.sparkSession
    kind = documents.schema["doc_id"].dataType.simpleString()
    chars = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(partitions(spark), -(-chars // BLOCK_CHARS))
    bits = max(4, math.ceil(math.log2(chars / 6 * ORDER / BUCKET_NGRAMS + 1)))
    docs = documents.select("doc_id", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int").alias("block"))

    def ask(block: pa.Table) -> pa.Table:
        found, words = [], 0
        for text in block.column("text").to_pylist():
            ngrams = document_ngrams(text)
            words += len(ngrams[0])
            found += ngrams
        hashes, counts = np.unique(np.concatenate(found), return_counts=True)
        which = (hashes >> np.uint64(HASH_BITS - bits)).astype(np.int32)
        cuts = np.flatnonzero(np.diff(which, prepend=-1))
        ends = [*cuts[1:], len(hashes)] if len(cuts) else []
        rows = [(int(which[a]), pack(hashes[a:b]), pack_counts(counts[a:b])) for a, b in zip(cuts, ends, strict=True)]
        rows.append((-1, b"", pack_counts(np.array([words]))))
        bucket, h, c = zip(*rows, strict=True)
        return pa.table({"block": pa.array([block.column("block")[0].as_py()] * len(rows), pa.int32()), "bucket": pa.array(bucket, pa.int32()), "hashes": pa.array(h, pa.binary()), "counts": pa.array(c, pa.binary())})

    def count(bucket: pa.Table) -> pa.Table:
        counts = [unpack_counts(c) for c in bucket.column("counts").to_pylist()]
        if bucket.column("bucket")[0].as_py() < 0:
            others = [pack_counts(np.array([sum(int(c[0]) for c in counts)]))] * len(counts)
        else:
            hashes = [unpack(h) for h in bucket.column("hashes").to_pylist()]
            distinct, at = np.unique(np.concatenate(hashes), return_inverse=True)
            sums = np.zeros(len(distinct), np.int64)
            np.add.at(sums, at, np.concatenate(counts))
            parts = np.split(sums[at], np.cumsum([len(h) for h in hashes])[:-1])
            others = [pack_counts(s - c) for s, c in zip(parts, counts, strict=True)]
        return pa.table({"block": bucket.column("block"), "bucket": bucket.column("bucket"), "others": pa.array(others, pa.binary())})

    def add_up(block: pa.Table, answers: pa.Table) -> pa.Table:
        each = [document_ngrams(t) for t in block.column("text").to_pylist()]
        if not each:
            return pa.table({"doc_id": block.column("doc_id"), "n_words": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64())})
        lengths = [len(x) for ngrams in each for x in ngrams]
        distinct, at, own = np.unique(np.concatenate([x for ngrams in each for x in ngrams]), return_inverse=True, return_counts=True)
        got = sorted(zip(answers.column("bucket").to_pylist(), answers.column("others").to_pylist(), strict=True))
        words = int(unpack_counts(got[0][1])[0])
        sums = own + np.concatenate([np.zeros(0, np.int64), *[unpack_counts(x) for _, x in got[1:]]])
        ends = np.cumsum([0, *lengths])
        scores = []
        for i, ngrams in enumerate(each):
            n, lo, hi = len(ngrams[0]), ends[i * ORDER], ends[(i + 1) * ORDER]
            if not n or leave_one_out and words == n:
                scores.append(None)
                continue
            here = sums[at[lo:hi]]
            if leave_one_out:
                _, back, mine = np.unique(at[lo:hi], return_inverse=True, return_counts=True)
                here = here - mine[back]
            cuts = np.cumsum(lengths[i * ORDER : (i + 1) * ORDER])[:-1]
            scores.append(backoff(np.split(here.astype(np.float64), cuts), words - n * leave_one_out))
        return pa.table({"doc_id": block.column("doc_id"), "n_words": pa.array([len(x[0]) for x in each], pa.int64()), "log_score": pa.array(scores, pa.float64())})

    asked = docs.groupBy("block").applyInArrow(ask, "block int, bucket int, hashes binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(count, "block int, bucket int, others binary")
    scored = docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, f"doc_id {kind}, n_words long, log_score double")
    return scored.withColumn("mean_log_score", F.col("log_score") / F.col("n_words"))
