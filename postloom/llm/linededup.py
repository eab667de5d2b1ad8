"""Near-duplicate lines by a deletion-neighbourhood join.

Lines are compared as sequences of words (lower-cased ASCII); an edit inserts, deletes
or replaces one word.  Lines of at least `shortest` words are duplicates within one
edit (by default all of two words or more: of lines of one word, all are one replaced word apart), shorter ones only if equal.  A line that has an earlier duplicate (by doc_id,
then text hash, then position) is dropped, whether or not that one stays; so the
result depends on no order of work.

Variants are a line without its i-th word, as 64-bit hashes.  Lines that share a
variant, its position and their length differ by one replaced word at most, and such
a group is a clique: all but its earliest member have an earlier duplicate.  A line
equal to another's variant differs from it by one word.  So groups are only reduced
to their earliest member, by aggregates that combine before they shuffle, never to
pairs.  Each line is then verified against the witness found, word by word.

Before that, lines that can't have a partner are left out: an edit leaves either the
first or the last half of the shorter line as it is, so two duplicates share the hash
of a half.

Defined cases: null text stays null and has no lines; blank lines stay; repeated
(doc_id, text) rows can't be told apart and keep the same lines; a null doc_id comes
first; empty tables give no rows.  Columns may have any name; of those named like the
two counts that dedup() adds, the counts take the place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from postloom.llm.common import bounded_batches, key_set, located_words, maybe_in, mix, powers, spared, stored, words_of

SHORTEST = 2
#: Lines are sent on in batches of so many.
ROWS = 20_000


def summed(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """S[i]: sum of the first i words' hashes, each times the power of its place in its line; a difference is the polynomial hash of a slice."""
    power, _ = powers(int(sizes.max(initial=0)) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[np.arange(len(words)) - np.repeat(starts, sizes)], out=total[1:])
    return total


def line_keys(words: np.ndarray, sizes: np.ndarray, shortest: int = SHORTEST) -> tuple[np.ndarray, list[np.ndarray]]:
    """Hashes of lines, and for each the hashes of the halves that a duplicate shares (none for short lines)."""
    starts = np.cumsum(sizes) - sizes
    ends = starts + sizes
    total = summed(words, starts, sizes)
    n = sizes.astype(np.uint64)
    whole = mix(total[ends] - total[starts] + n)
    _, inverse = powers(int(sizes.max(initial=0)) + 1)
    halves = np.zeros((len(sizes), 4), np.uint64)
    for i, p in enumerate((sizes // 2, (sizes - 1) // 2)):
        mark = p.astype(np.uint64) << np.uint64(48)
        head = total[starts + p] - total[starts]
        tail = (total[ends] - total[ends - p]) * inverse[sizes - p]
        halves[:, 2 * i] = mix(head * np.uint64(2) + np.uint64(1) ^ mark)
        halves[:, 2 * i + 1] = mix(tail * np.uint64(2) ^ mark)
    # of an odd number of words both halves are the same
    take = np.where(sizes < shortest, 0, np.where(sizes % 2, 2, 4))
    return whole, [h[:k] for h, k in zip(halves, take.tolist(), strict=True)]


def variants(words: np.ndarray) -> np.ndarray:
    """Hash of the line without its i-th word, for each i; equal to line_keys' hash of that line."""
    n = len(words)
    total = summed(words, np.zeros(1, np.int64), np.array([n]))
    inverse = powers(2)[1][1]
    return mix(total[:-1] + (total[-1] - total[1:]) * inverse + np.uint64(n - 1))


def text_lines(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of the text, and for each line with words its place and their number."""
    if not text:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    raw = text.encode("utf-8", "surrogatepass").lower()
    words, starts = located_words(raw)
    line = np.searchsorted(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), starts)
    places, sizes = np.unique(line, return_counts=True)
    return words, places, sizes


def text_hash(text: str | None) -> int:
    return xxhash.xxh3_64_intdigest((text or "").encode("utf-8", "surrogatepass")) >> 1


def line_table(documents: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """key, th, pos, h, n, halves for each line that has words."""
    names = ["key", "th", "pos", "h", "n", "halves"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                keys, texts = (batch.column(i).slice(lo, 500).to_pylist() for i in (0, 1))
                found = [text_lines(t) for t in texts]
                counts = [len(places) for _, places, _ in found]
                sizes = np.concatenate([x for _, _, x in found])
                if not len(sizes):
                    continue
                whole, halves = line_keys(np.concatenate([w for w, _, _ in found]), sizes, shortest)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in halves])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(halves).view(np.int64)))
                arrays = [
                    pa.array(np.repeat(np.array(keys, np.int64), counts)),
                    pa.array(np.repeat(np.array([text_hash(t) for t in texts], np.int64), counts)),
                    pa.array(np.concatenate([places for _, places, _ in found]).astype(np.int32)),
                    pa.array(whole.view(np.int64)),
                    pa.array(sizes.astype(np.int32)),
                    lists,
                ]
                yield pa.RecordBatch.from_arrays(arrays, names)

    bounded_batches(documents.sparkSession)
    return documents.mapInArrow(spared(run), "key long, th long, pos int, h long, n int, halves array<long>")


def word_table(chosen: DataFrame) -> DataFrame:
    """h and words (hashes) for each line named in `wanted` (text, wanted: positions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hs, rows = [], []
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words, places, sizes = text_lines(text)
                ends = np.cumsum(sizes)
                whole, _ = line_keys(words, sizes)
                for i in np.flatnonzero(np.isin(places, wanted)).tolist():
                    hs.append(whole[i])
                    rows.append(words[ends[i] - sizes[i] : ends[i]].view(np.int64))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(hs, np.uint64).view(np.int64)), pa.array(rows, pa.list_(pa.int64()))], ["h", "words"])

    return chosen.select("text", "wanted").mapInArrow(spared(run), "h long, words array<long>")


def variant_table(lines: DataFrame, found: Broadcast[np.ndarray] | None = None) -> DataFrame:
    """v, i, n, h and the place for each line (h, words, key, th, pos): its variants, and with i = -1 itself; with found, only those v that may be in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["v", "i", "n", "h", "key", "th", "pos"]
        for batch in batches:
            lists = batch.column(1)
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            hs = batch.column(0).to_numpy()
            for lo in range(0, batch.num_rows, 500):
                rows = range(lo, min(lo + 500, batch.num_rows))
                v = [x for r in rows for x in (variants(flat[ends[r] : ends[r + 1]]).view(np.int64), hs[r : r + 1])]
                i = [x for r in rows for x in (np.arange(ends[r + 1] - ends[r], dtype=np.int32), np.array([-1], np.int32))]
                sizes = np.diff(ends[lo : lo + len(rows) + 1])
                of = np.repeat(np.arange(lo, lo + len(rows)), sizes + 1)
                v, i, n = np.concatenate(v), np.concatenate(i), np.repeat(sizes, sizes + 1).astype(np.int32)
                if found is not None:
                    held = maybe_in(found.value, v)
                    v, i, n, of = v[held], i[held], n[held], of[held]
                place = [batch.column(k).take(pa.array(of)) for k in (2, 3, 4)]
                yield pa.RecordBatch.from_arrays([pa.array(v), pa.array(i), pa.array(n), pa.array(hs[of]), *place], names)

    return lines.select("h", "words", "key", "th", "pos").mapInArrow(spared(run), "v long, i int, n int, h long, key long, th long, pos int")


def maybe_holding(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """key, th, text of docs (key, text) that may hold one of the keys; th tells rows of one key apart."""
    found = docs.sparkSession.sparkContext.broadcast(key_set(keys, "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(maybe_in(found.value, batch.column(0).to_numpy())))
            th = pa.array([text_hash(t) for t in part.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), th, part.column(1)], ["key", "th", "text"])

    return docs.mapInArrow(spared(run), "key long, th long, text string")


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), "text")


def _shared(lines: DataFrame) -> DataFrame:
    """The variants of the lines that two of them may have; most lines share none with another.

    They are made anew rather than sent from one Python worker to another: each task then has one worker, and an executor keeps half as many.
    """
    several = variant_table(lines).groupBy("v").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("v")
    return variant_table(lines, lines.sparkSession.sparkContext.broadcast(key_set(several, "v")))


def duplicates(documents: DataFrame, max_edits: int = 1, shortest: int = SHORTEST) -> DataFrame:
    """key, th, pos of each line to drop (key: doc_id, or the least integer for null; th: hash of the text)."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    docs = _keyed(documents).where(F.col("text").isNotNull())
    lines = stored(line_table(docs, shortest), "lines")
    place = F.struct("key", "th", "pos")
    first = lines.groupBy("h").agg(F.min(place).alias("at"), F.first("n").alias("n"), F.first("halves").alias("halves"))
    if max_edits:
        first = stored(first, "first")
        halves = first.select("h", F.explode("halves").alias("half"))
        several = halves.groupBy("half").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("half")
        near = halves.join(several, "half").select("h").distinct()
        wanted = first.join(near, "h", "left_semi").select("at.key", "at.th", "at.pos").groupBy("key", "th").agg(F.collect_list("pos").alias("wanted"))
        wanted = stored(wanted, "wanted")
        texts = maybe_holding(docs, wanted).join(wanted, ["key", "th"]).dropDuplicates(["key", "th"])
        words = stored(word_table(texts).join(first.select("h", "at.key", "at.th", "at.pos"), "h"), "words")
        v = stored(_shared(words).select("v", "i", "n", "h", place.alias("at")), "variants")
        one = F.struct("at", "h")
        inside, long = F.col("i") >= 0, (F.col("i") >= 0) & (F.col("n") > shortest)
        # the same variant at the same place, and a line that is another's variant
        same = v.where(inside).groupBy("v", "i", "n").agg(F.min(one).alias("same"))
        whole = v.groupBy("v").agg(F.min(F.when(long, one)).alias("more"), F.min(F.when(~inside, one)).alias("whole"))
        v = v.join(same, ["v", "i", "n"], "left").join(whole, "v")
        earlier = F.least(F.when(inside, F.col("same")), F.when(~inside, F.col("more")), F.when(long, F.col("whole")))
        found = v.withColumn("by", earlier).where(F.col("by.at") < F.col("at")).select("h", F.col("by.h").alias("by"))
        later = verified(found.groupBy("h").agg(F.min("by").alias("by")), words.select("h", "words"))
        dropped = lines.join(first.select("h", "at"), "h").join(later.withColumn("near", F.lit(True)), "h", "left").where(F.col("near") | (F.struct("key", "th", "pos") != F.col("at")))
    else:
        dropped = lines.join(first.select("h", "at"), "h").where(F.struct("key", "th", "pos") != F.col("at"))
    return dropped.select("key", "th", "pos").distinct()


def within_one(a: np.ndarray, b: np.ndarray) -> bool:
    """Edit distance of at most one word."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    apart = np.flatnonzero(a != b[: len(a)])
    i = int(apart[0]) if len(apart) else len(a)
    return np.array_equal(a[i + (len(a) == len(b)) :], b[i + 1 :])


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The h of pairs (h, by) whose lines are within one edit."""
    both = pairs.join(words, "h").join(words.select(F.col("h").alias("by"), F.col("words").alias("other")), "by").select("h", "words", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(i) for i in (1, 2))
            x, y = a.values.to_numpy(zero_copy_only=False), b.values.to_numpy(zero_copy_only=False)
            ends = zip(a.offsets.to_numpy()[:-1], a.offsets.to_numpy()[1:], b.offsets.to_numpy()[:-1], b.offsets.to_numpy()[1:], strict=True)
            yield batch.select([0]).filter(pa.array([within_one(x[i:j], y[k:m]) for i, j, k, m in ends], pa.bool_()))

    return both.mapInArrow(spared(run), "h long").distinct()


def dedup(documents: DataFrame, max_edits: int = 1, shortest: int = SHORTEST, counts: tuple[str, str] = ("n_lines", "n_kept")) -> DataFrame:
    """The rows with all their columns, without the dropped lines in text; two counts, of lines that aren't blank and of those kept, are added by the names given."""
    spark = documents.sparkSession
    bounded_batches(spark)
    documents = documents.drop(*counts)
    gone = stored(duplicates(documents, max_edits, shortest).groupBy("key", "th").agg(F.collect_list("pos").alias("gone")), "gone")
    found = spark.sparkContext.broadcast(key_set(gone, "key"))
    names = documents.columns
    key, th, drop = (("_" * (1 + max(map(len, names)))) + x for x in ("key", "th", "drop"))
    rows = documents.select("*", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias(key))
    at, held = names.index("text"), len(names)
    longs = [T.StructField(c, T.LongType()) for c in (key, th, *counts)]

    def counted(batch: pa.RecordBatch, drops: list[list[int] | None]) -> pa.RecordBatch:
        """The batch's rows without the lines to drop, and the two counts."""
        texts, lines, kept = [], [], []
        for text, gone in zip(batch.column(at).to_pylist(), drops, strict=True):
            there = 0 if text is None else sum(1 for x in text.split("\n") if words_of(x))
            out = set(gone or [])
            lines.append(there)
            kept.append(there - len(out))
            texts.append(text if not out else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in out))
        cols = [batch.column(i) for i in range(held)]
        cols[at] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(kept, pa.int64())], [*names, *counts])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows whose key may have lines to drop, with the hash of their text."""
        for batch in batches:
            batch = batch.filter(pa.array(maybe_in(found.value, batch.column(held).to_numpy())))
            hashes = pa.array([text_hash(t) for t in batch.column(at).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, hashes], [*names, key, th])

    def free(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All other rows; they go through one Python worker, not through two of a task."""
        for batch in batches:
            batch = batch.filter(pa.array(~maybe_in(found.value, batch.column(held).to_numpy())))
            yield counted(batch, [None] * batch.num_rows)

    def hit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield counted(batch, batch.column(held).to_pylist())

    schema = T.StructType([*documents.schema.fields, *longs[2:]])
    # a (key, th) is one text: its positions are no more than its lines
    keyed = rows.mapInArrow(spared(inside), T.StructType([*documents.schema.fields, *longs[:2]]))
    keyed = keyed.join(gone.select(F.col("key").alias(key), F.col("th").alias(th), F.col("gone").alias(drop)), [key, th], "left").select(*names, drop)
    return keyed.mapInArrow(spared(hit), schema).unionByName(rows.mapInArrow(spared(free), schema))
