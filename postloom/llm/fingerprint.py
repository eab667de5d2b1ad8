"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A fingerprint is the ascending array of the K smallest distinct 63-bit hashes of a
text's shingles of five words (all of them, if fewer; a text of fewer words is one
shingle).  Sketches of parts merge into the sketch of the whole; two sketches
estimate resemblance and containment, one estimates the number of shingles.

`compare_with_next` orders rows by doc_id without gathering them: the range of ids is
cut at quantiles, each part gets, besides its own rows, a copy of the first row of the
next part (the last part: of the first), and a part is one sorted task.

Defined cases: null text counts as empty; an empty text has an empty fingerprint; two
empty fingerprints resemble each other fully, an empty and another not at all; rows
with a null doc_id come first; equal doc_ids are ordered by text; a single row is its
own next row; rows of one doc_id are one range, so one task's work, however many; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import bounded_batches, map_arrow, ngram_hashes, partitions, spared, word_hashes

K, SHINGLE = 64, 5
_TOP = float(1 << 63)


def sketch(text: str | None, k: int = K) -> np.ndarray:
    words = word_hashes(text)
    if not len(words):
        return np.zeros(0, np.int64)
    hashes = ngram_hashes(words, min(SHINGLE, len(words))) >> np.uint64(1)
    if len(hashes) > 8 * k:  # repeats rarely leave fewer than k among the 4k smallest
        few = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(few) >= k:
            return few[:k].astype(np.int64)
    return np.unique(hashes)[:k].astype(np.int64)


def likeness(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the resemblance of two texts from their sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    union = np.union1d(a, b)[:k]
    return float(np.isin(union, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the texts' union."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union = merge(a, b, k)
    both = F.array_intersect(F.array_intersect(a, b), union)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), ((F.size(a) == 0) & (F.size(b) == 0)).cast("double")).otherwise(F.size(both) / F.size(union))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles; exact below k."""
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * F.lit(_TOP) / F.try_element_at(a, F.lit(k)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b has: resemblance times the union's count over a's."""
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / distinct_count(a, k)))


def as_string(sketch_: Column | str) -> Column:
    """A fingerprint as text: its hashes in decimal, in order, joined by commas."""
    return F.array_join(F.col(sketch_).cast("array<string>") if isinstance(sketch_, str) else sketch_.cast("array<string>"), ",")


def from_string(text: Column) -> Column:
    """The fingerprint of as_string()."""
    return F.when(text == "", F.array().cast("array<bigint>")).otherwise(F.split(text, ",").cast("array<bigint>"))


def fingerprints(documents: DataFrame, k: int = K) -> DataFrame:
    """doc_id and the fingerprint of each row's text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [sketch(t, k) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], ["doc_id", "fingerprint"])

    return map_arrow(documents.select("doc_id", "text"), run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, fingerprint array<bigint>")


def combine(sketches: DataFrame, key: str, k: int = K) -> DataFrame:
    """Merges the sketches of each key's parts; hashes are pre-aggregated, so a frequent key is no single group of rows."""
    from pyspark.sql.window import Window

    hashes = sketches.select(key, F.explode("fingerprint").alias("h")).distinct()
    first = hashes.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("r") <= k)
    return first.groupBy(key).agg(F.array_sort(F.collect_list("h")).alias("fingerprint"))


def _part(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most key, by binary search."""
    if not cuts:
        return F.lit(0)
    found = F.lit(cuts)
    steps = F.lit([1 << b for b in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(found, at + step - 1) <= key, step).otherwise(F.lit(0)))


def compare_with_next(documents: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last quarter of code points (rounded down)
    replaced by as many from the start of the next row's text.
    """
    spark = documents.sparkSession
    bounded_batches(spark)
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = partitions(spark)
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else None
    cuts = sorted(set(cuts or []))
    part = _part(F.col("key"), cuts)
    # one row a part: where its ids begin
    heads = sorted((r["part"], r["head"]) for r in rows.groupBy(part.alias("part")).agg(F.min("key").alias("head")).collect())
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    target = F.try_element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("key")) if before else F.lit(None).cast("int")
    own = rows.withColumn("part", part)
    dealt = own.withColumn("to", F.explode(F.when(target.isNotNull(), F.array(F.struct(F.col("part").alias("p"), F.lit(False).alias("guest")), F.struct(target.alias("p"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("part").alias("p"), F.lit(False).alias("guest"))))))
    dealt = dealt.select(F.col("to.p").alias("p"), F.col("to.guest").alias("guest"), "key", "doc_id", "text").repartitionById(len(cuts) + 1, F.col("p")).sortWithinPartitions("p", "guest", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # a row whose next one is still to come: part, doc_id, text, fingerprint

        def finish(row: tuple, text: str, print_: np.ndarray) -> tuple:
            cut = len(row[2]) // 4
            edited = row[2][: len(row[2]) - cut] + text[:cut]
            changed = sketch(edited, k) if cut else row[3]
            return row[1], len(row[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), row[3], changed, likeness(row[3], changed, k), likeness(row[3], print_, k)

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64(), pa.float64()]

        def batch_of(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names)

        for batch in batches:
            done = []
            for p, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                print_ = sketch(text, k)
                if held and held[0] == p:
                    done.append(finish(held, text, print_))
                held = None if guest else (p, doc_id, text, print_)
                if len(done) >= 2000:
                    yield batch_of(done)
                    done = []
            if done:
                yield batch_of(done)

    return dealt.mapInArrow(spared(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint array<bigint>, edited_fingerprint array<bigint>, near_edited double, near_next double")
