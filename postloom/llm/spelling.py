"""Spelling variants of the words of a corpus: words within one edit, by an even-partition pigeonhole join.

Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z in lower case.  In a
97th of the pairs of document and word, chosen by crc32, the word loses a code point: slips
planted for the join to find.  Counts are added up within a task before they are shuffled.

A word of length l is indexed by its two halves, cut at l // 2: one edit leaves one of
them as it is, so two near words share the first half at their start or the second at
their end.  Words of the same length probe with their own halves, words one longer with
their substrings at the same start, or shifted by one for the second half.  A key stands
for (length, the part that may differ, all the rest).  Where many words share a key, the
part that may differ is cut evenly again, and each of its halves in turn may differ: the
same argument, so no pair is lost, and a key of a third of all words isn't a third of all
words times themselves.  At a part of one letter a key has no more words than there are
letters, or their square for words one longer.  Candidates are verified by edit distance.

A word's form is its most frequent near word (of equals the first in code-point order),
where that is at least twice as frequent; its root is found by following forms, whose
counts at least double at each step, by pointer jumping: six rounds reach the end.

Defined cases: null and empty texts have no words; a null doc_id is an empty string
before the colon; repeated rows each count; runs of any length are words; empty
tables give no rows; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import bounded_batches, spared, stored

SLIP, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3
#: Different words that a task adds up before it sends them on, and their characters.
HELD, HELD_CHARS = 200_000, 16_000_000
#: Keys of more rows than this are cut again.
BUCKET = 32


def slipped(word: str, h: int) -> str:
    """The word without its code point h % length, where SLIP divides h."""
    if h % SLIP:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n, its occurrences in the whole table after the slips."""
    bounded_batches(documents.sparkSession)
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")

    def sent(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        chars = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if not (text := text.as_py()):
                    continue
                start = zlib.crc32(f"{doc_id.as_py() or ''}:".encode())
                for word, n in Counter(runs.findall(text.encode().lower().decode())).items():
                    word = slipped(word, zlib.crc32(word.encode(), start))
                    if len(word) >= least_length:
                        if word not in held:
                            chars += len(word)
                        held[word] += n
                if len(held) >= HELD or chars >= HELD_CHARS:
                    yield sent(held)
                    held.clear()
                    chars = 0
        if held:
            yield sent(held)

    parts = documents.select(F.col("doc_id").cast("string"), "text").where(F.col("text") != "").mapInArrow(spared(run), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _key(word: Column, length: Column, a: Column, b: Column, longer: Column) -> Column:
    """Of the length of the indexed word, the part [a, b) that may differ, and what stands before and after it."""
    return F.xxhash64(length, a, b, F.substring(word, F.lit(1), a), F.substring(word, b + longer + 1, length - b))


def _halved(rows: DataFrame) -> DataFrame:
    """The rows of keys to be cut, once for each half of the part that may differ."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    part = F.explode(F.array(F.struct("a", middle.alias("b")), F.struct(middle.alias("a"), "b")))
    cut = rows.select("word", "n", "length", "longer", part.alias("part"))
    return cut.select("word", "n", "length", "longer", "part.a", "part.b", _key(F.col("word"), F.col("length"), F.col("part.a"), F.col("part.b"), F.col("longer")).alias("key"))


def candidates(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Rows of (key, word, n, longer), to be joined by key: 0 in longer are indexed and probe, 1 probe only."""
    size = F.char_length("word").cast("int")
    own = words.select("word", "n", size.alias("length"), F.lit(0).alias("longer"))
    rows = own.unionByName(words.select("word", "n", (size - 1).alias("length"), F.lit(1).alias("longer")))
    rows = _halved(rows.withColumn("a", F.lit(0)).withColumn("b", F.col("length")))
    found = []
    while True:
        rows = stored(rows, "keys")
        sizes = rows.groupBy("key").agg(F.count("*").alias("rows"), F.count_if(F.col("longer") == 0).alias("indexed")).where("rows > 1 AND indexed > 0")
        # written, so that the join can split a frequent key
        sizes = stored(sizes, "sizes")
        rows = rows.join(sizes, "key")
        again = (F.col("rows") > bucket) & (F.col("b") - F.col("a") > 1)
        found.append(rows.where(~again).select("key", "word", "n", "longer"))
        # each round halves the parts, so there are as many rounds as the longest word's length has bits, at most
        if sizes.where(F.col("rows") > bucket).isEmpty():
            return reduce(DataFrame.unionByName, found)
        left = rows.where(again)
        if left.isEmpty():
            return reduce(DataFrame.unionByName, found)
        rows = _halved(left)


def near_words(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """word, other and their counts n and m, once for each order of two words that one inserted, deleted or replaced code point parts."""
    rows = stored(candidates(words, bucket), "candidates")
    x = rows.where("longer = 0").select("key", "word", "n")
    y = rows.select("key", F.col("word").alias("other"), F.col("n").alias("m"), "longer")
    pairs = x.join(y, "key").where((F.col("longer") == 1) | (F.col("word") < F.col("other")))
    pairs = pairs.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "m").distinct()
    pairs = stored(pairs, "pairs")
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("m").alias("n"), F.col("word").alias("other"), F.col("n").alias("m")))


def roots(forms: DataFrame) -> DataFrame:
    """word and root, the last of the forms that follow from word (forms: word, form)."""
    found = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        up = found.select(F.col("word").alias("root"), F.col("root").alias("top"))
        if found.join(up, "root", "left_semi").isEmpty():
            return found
        found = stored(found.join(up, "root", "left").select("word", F.coalesce("top", "root").alias("root")), "roots")


def variants(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, bucket: int = BUCKET) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word of the table."""
    words = stored(word_counts(documents, least_length, least_count), "words")
    best = F.min(F.struct((-F.col("m")).alias("less"), "other"))
    near = near_words(words, bucket).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = words.join(near, "word", "left")
    led = -F.col("best.less") >= 2 * F.col("n")
    found = near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(led, F.col("best.other")).alias("form"), F.when(led, -F.col("best.less")).alias("form_n"))
    found = stored(found, "forms")
    root = roots(found.where(F.col("form").isNotNull()))
    return found.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
