"""Token ids in ORC.

Documents are range-partitioned by doc_id, and those of one doc_id by a hash of the text, so
the files in order of their names hold ascending doc_ids and none is one frequent doc_id's.  Ids are ORC lists of integers (run-length encoded), doc_id has a
row index and a Bloom filter: a reader splits files by stripe and skips stripes and
row groups that cannot hold a wanted doc_id.

Defined cases: null and empty texts give only the end id; rows with a null doc_id come
first; equal doc_ids are ordered by a hash of the text, then by text; an empty table gives a file without rows.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom.llm.common import bounded_batches, map_arrow, shared_path, spared, stored

END_ID = 2
#: Words that an encoder remembers as used lately; as many more as used before.
CACHE = 400_000
STRIPE_BYTES, ROW_INDEX_STRIDE = 16 << 20, 1_000
#: White space to Python's split(), but not to the tokenizer.
_ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f")


#: Latin letters that are their own normal form and whose lower case is one letter.
_PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
#: ASCII signs but the apostrophe: the tokenizer parts letters from runs of signs, save those of 's, 't and the like.
_SIGNS = string.punctuation.replace("'", "")
#: A comma or full stop alone after a letter in lower case, before white space or the end: the tokenizer parts it from the letter.
_STOP = re.compile(r"[.,](?<=[a-zß-öø-ÿ].)(?!\S)")
#: What its special tokens begin with; it seeks them before it puts a text in lower case.
_SPECIAL = "<|"


def parted(text: str) -> str:
    """The text in lower case and with such stops apart, so that it has fewer different words; as it is, if it has letters beyond Latin-1 or what may be a special token."""
    if _SPECIAL in text:
        return text
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return _STOP.sub(r" \g<0>", text.lower())


def _byte_level() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others in order for code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(256 + i) for i, b in enumerate(hidden)}


_BYTE_LEVEL = _byte_level()


class WordEncoder(dict):
    """Encodes texts by the tokenizers library.  The tokenizer drops white space and never joins what it parts, so words are encoded once and remembered.

    Words of Latin letters, without the signs after them, go straight to the library's model; all others through its whole chain.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.before: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    @property
    def cores(self) -> dict[str, bytes]:
        """Lower-case letters and runs of signs: words like others, and remembered among them."""
        return self

    def letters(self, low: str) -> bytes:
        shown = low if low.isascii() else low.encode().decode("latin-1").translate(_BYTE_LEVEL)
        return array("i", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.before = dict(self)
            self.clear()
        ids = self.before.get(word)
        if ids is None:
            core = word if word.isalpha() else word.rstrip(_SIGNS)
            if not (core.isascii() and core.isalpha() or _PLAIN.fullmatch(core)):
                ids = self.whole(word)
            elif (low := core.lower()) == word:
                ids = self.letters(word)
            else:
                ids = self.cores[low] + self.cores[word[len(core) :]] if len(core) < len(word) else self.cores[low]
        self[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(self.whole(t) if any(c in t for c in _ODD_SPACE) else b"".join(map(self.__getitem__, parted(t).split())), np.int32) for t in texts]


#: By path; a Python worker keeps its encoders, and the words that they know, from task to task.
_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write(documents: DataFrame, out: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Writes doc_id, part, row and ids; part numbers the ranges of doc_id in ascending order, row the rows of a part."""
    bounded_batches(documents.sparkSession)
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = encoder_of(tokenizer), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                ends = np.cumsum([len(x) + 1 for x in ids], dtype=np.int32)
                flat = np.full(ends[-1], end_id, np.int32)
                for x, end in zip(ids, ends, strict=True):
                    flat[end - 1 - len(x) : end - 1] = x
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat))
                rows = pa.array(np.arange(row, row + part.num_rows, dtype=np.int64))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), rows, lists], ["doc_id", "part", "row", "ids"])

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = documents.select("doc_id", "text").repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order, "text").withColumn("part", F.spark_partition_id())
    (
        ranged.mapInArrow(spared(run), f"doc_id {kind}, part int, row long, ids array<int>")
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("compression", "zstd")
        .orc(out)
    )


def read(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, part, row, ids of the files; with doc_ids, only stripes and row groups whose metadata admit one of them are decoded."""
    rows = spark.read.schema("doc_id long, part int, row long, ids array<int>").orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files' rows."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(3)
        ends = lists.offsets.to_numpy()
        flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), np.dtype("<u4"))
        raw = memoryview(flat.view(np.uint8))
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "part", "row", "n_tokens", "ids_crc32"])

    each = map_arrow(rows.select("doc_id", "part", "row", "ids"), run, f"doc_id {kind}, part int, row long, n_tokens long, ids_crc32 long")
    before = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    each = stored(each, "digests")
    # one row a range of documents: as many as the writer's partitions
    sums = each.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    offsets, total = {}, 0
    for r in sorted(sums, key=lambda r: r["part"]):
        offsets[r["part"]] = total
        total += r["n"]
    if not offsets:
        return each.select("doc_id", F.lit(0).cast("long").alias("start"), "n_tokens", "ids_crc32")
    known = rows.sparkSession.createDataFrame(list(offsets.items()), "part int, offset long")
    start = F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("local")
    return each.select("doc_id", "part", "n_tokens", "ids_crc32", start).join(F.broadcast(known), "part").select("doc_id", (F.col("local") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def roundtrip(documents: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the files in the shared folder and returns the digests of what they hold."""
    spark = documents.sparkSession
    path = shared_path(spark, "tokens.orc")
    write(documents.withColumn("doc_id", F.col("doc_id").cast("long")), path, tokenizer)
    return digests(read(spark, path))
