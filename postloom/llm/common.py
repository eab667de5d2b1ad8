"""Helpers that several of the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens that one Python worker remembers; a full cache is emptied.
WORD_CACHE = 300_000
#: Arrow batches that go to Python hold at most so many bytes, or so many rows where Spark has no byte limit.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 10_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset and Spark runs in one process, as in tests, a new folder that then becomes it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="postloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders that this driver has named in the shared folder.
_NAMED: list[str] = []


def shared_path(spark: SparkSession, name: str) -> str:
    _NAMED.append(f"{shared_dir(spark)}/postloom-{uuid.uuid4().hex}")
    return f"{_NAMED[-1]}/{name}"


def clear_stored(spark: SparkSession) -> int:
    """Deletes the tables that operators have stored in the shared folder, to be called once their results are written: a result that isn't yet reads them."""
    done = 0
    while _NAMED:
        path = spark._jvm.org.apache.hadoop.fs.Path(_NAMED.pop())
        done += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return done


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends here, and every executor can read it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def bounded_batches(spark: SparkSession) -> None:
    """Limits the bytes of the batches sent to Python, where Spark's own setting is still without limit."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    limit = spark.conf.get(key, None)
    if limit is None or not limit.isdigit() or int(limit) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


@lru_cache
def _trim() -> Callable[[int], int] | None:
    """The C library's malloc_trim, where it has one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def _release() -> None:
    """Gives memory that nothing uses back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def spared(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, before and after which a Python worker gives free memory back: Spark keeps workers for later tasks, several on each executor, whatever ran in them before."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _release()
        try:
            yield from run(batches)
        finally:
            _release()

    return out


@contextmanager
def sparing() -> Iterator[None]:
    """For functions of large groups (applyInArrow, applyInPandas, cogroups): after the block free memory is given back."""
    try:
        yield
    finally:
        _release()


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(spared(run), schema)


def tallied(rows: DataFrame, tally: Callable[[pa.RecordBatch], dict[tuple, int] | dict[tuple, tuple]], schema: str, sums: int = 1) -> DataFrame:
    """What tally counts in each batch, keys before counts; the schema's last `sums` columns are the counts (one alone is no tuple)."""
    names = [c.split()[0] for c in schema.split(",")]
    kinds = [pa.string() if c.split()[1] == "string" else pa.int64() for c in schema.split(",")]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = tally(batch)
        counted = found.values() if sums > 1 else zip(found.values())
        keys, counts = ([*zip(*x, strict=True)] or [()] * n for x, n in ((found.keys(), len(names) - sums), (counted, sums)))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*keys, *counts], kinds, strict=True)], names)

    return map_arrow(rows, run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space (20, 09-0D), with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0xD6E8FEB86659FD93
#: Texts are hashed in pieces of about so many bytes, cut between words.
PIECE = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base of the polynomial hashes, and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers


def _hashed(raw: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = powers(len(raw) + 1)
    edges = np.flatnonzero(np.diff(space.view(np.int8), prepend=1, append=1))
    starts, ends = edges[::2], edges[1::2]
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)), starts


def located_words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word."""
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    if len(data) <= PIECE:
        return _hashed(data, space)
    gaps, out, lo = np.flatnonzero(space), [], 0
    while lo < len(data):
        at = np.searchsorted(gaps, lo + PIECE)
        hi = int(gaps[at]) + 1 if at < len(gaps) else len(data)
        h, starts = _hashed(data[lo:hi], space[lo:hi])
        out.append((h, starts + lo))
        lo = hi
    return np.concatenate([h for h, _ in out]), np.concatenate([x for _, x in out])


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each of words_of(text), without making the words."""
    return located_words(text.encode("utf-8", "surrogatepass").lower())[0] if text else np.zeros(0, np.uint64)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash for each run of n words, in order."""
    if len(words) < n:
        return words[:0]
    out = words[: len(words) - n + 1]
    for i in range(1, n):
        out = out * _GOLD + words[i : len(words) - n + 1 + i]
    return mix(out ^ np.uint64(n))


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct shingles of n words; fewer words count as one shingle, none as the empty set."""
    if not len(words):
        return words
    return np.unique(ngram_hashes(words, min(n, len(words))))


def held_out(doc_id: str, mod: int, rest: int):
    """crc32(doc_id as text) mod `mod` = `rest`; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % mod == rest, F.lit(False))


#: Size of the set of keys below: 1 MB, whatever the number of keys.
KEY_BITS = 23


def key_set(keys: DataFrame, key: str) -> np.ndarray:
    """The lowest KEY_BITS bits of the keys, as a bitmap of fixed size; tells most rows without one of the keys from the rest before they are shuffled."""
    low = F.pmod(F.col(key), F.lit(1 << KEY_BITS))
    one = F.expr("shiftleft(1L, cast(low % 64 as int))")
    rows = keys.select(low.alias("low")).groupBy((F.col("low") / 64).cast("int").alias("word")).agg(F.bit_or(one).alias("bits")).collect()
    out = np.zeros((1 << KEY_BITS) // 64, np.uint64)
    for r in rows:
        out[r["word"]] = r["bits"] & 0xFFFFFFFFFFFFFFFF
    return out


def maybe_in(found: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys.astype(np.int64) & ((1 << KEY_BITS) - 1)
    return (found[low >> 6] >> (low & 63).astype(np.uint64)) & np.uint64(1) == 1
