"""Conflict-constrained best-fit packing.

A document of `size` tokens fills bins of CAPACITY tokens.  Full pieces of a longer
document take a bin each; what remains is packed by best fit, largest first: open bins
are held in order of their residual capacity, with bitmaps of the sources and duplicate
clusters inside; the search starts at the tightest bin that holds the piece and goes on
to its successors until one has neither the piece's source nor its cluster.

Pieces are dealt by hash into shards of about SHARD documents, which are packed
independently, so a shard's work is bounded and only its last bins stay open.

Defined cases: null or negative size counts as 0; a piece has 1 token at least (its end); a null source or
cluster conflicts with nothing; repeated rows are counted, dealt out in parts of at most
COPIES and packed each, so a row of any number of copies is no one shard's; ties go to
the bin opened first; empty tables give no rows.  Rows with a null doc_id are packed too.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import bounded_batches, sparing

CAPACITY, SHARD, COPIES = 2048, 2000, 200
NULL_ID = -(1 << 63)  #: stands for a null id within tasks
SCHEMA = "doc_id long, piece int, size int, shard int, bin_id long, bin_pos int"


def best_fit(pieces: list[tuple[int, object, object]], capacity: int) -> list[int]:
    """The bin of each (size, source, cluster), placed in the order given; bins are numbered as they open."""
    open_bins: list[tuple[int, int]] = []  # (residual, bin), ascending
    bits: dict[object, int] = {}
    held: list[int] = []
    out = []
    for size, source, cluster in pieces:
        mine = 0
        for kind, value in (("s", source), ("c", cluster)):
            if value is not None:
                mine |= 1 << bits.setdefault((kind, value), len(bits))
        at = bisect_left(open_bins, (size, -1))
        while at < len(open_bins) and held[open_bins[at][1]] & mine:
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
        else:
            residual, b = capacity, len(held)
            held.append(0)
        held[b] |= mine
        out.append(b)
        if residual > size:
            insort(open_bins, (residual - size, b))
    return out


def word_count(text: Column) -> Column:
    """Words of a text and its end: the size that the query packs by."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), "^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))) + 1


def pack(documents: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Packs rows of doc_id, size, source, cluster: for each piece its bin, and its place there."""
    spark = documents.sparkSession
    bounded_batches(spark)
    n = documents.count()
    shards = max(1, -(-n // shard))
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(1)).cast("long").alias("size"), F.col("source").cast("string").alias("source"), F.col("cluster").cast("string").alias("cluster"))
    columns = ["doc_id", "size", "source", "cluster"]
    parts = rows.groupBy(columns).agg(F.count("*").alias("n")).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))))
    copies = F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES).cast("int")
    dealt = parts.select(*columns, copies.alias("copies"), F.pmod(F.xxhash64(*columns, "part"), F.lit(shards)).cast("int").alias("shard"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.loc[pdf.index.repeat(pdf["copies"])].sort_values(["size", "doc_id", "source", "cluster"], ascending=[False, True, True, True], kind="stable")
        pieces, tail = [], []
        for doc_id, size, source, cluster, k in pdf[["doc_id", "size", "source", "cluster", "shard"]].itertuples(index=False):
            full, rest = divmod(int(size), capacity)
            pieces += [(doc_id, p, capacity, k, None) for p in range(full)]
            if rest:
                tail.append((rest, doc_id, full, None if pd.isna(source) else source, None if pd.isna(cluster) else cluster, k))
        tail.sort(key=lambda x: -x[0])
        bins = best_fit([(x[0], x[3], x[4]) for x in tail], capacity)
        out = [(d, p, s, k, i) for i, (d, p, s, k, _) in enumerate(pieces)]
        out += [(x[1], x[2], x[0], x[5], len(pieces) + b) for x, b in zip(tail, bins, strict=True)]
        got = pd.DataFrame(out, columns=["doc_id", "piece", "size", "shard", "bin"])
        got["bin_id"] = got["shard"].astype("int64") * (1 << 32) + got["bin"]
        got["bin_pos"] = got.groupby("bin").cumcount()
        return got[["doc_id", "piece", "size", "shard", "bin_id", "bin_pos"]]

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        with sparing():
            return run(pdf)

    return dealt.groupBy("shard").applyInPandas(whole, SCHEMA).withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))


def packed_documents(documents: DataFrame, cluster: Column | None = None, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """pack() of a table of documents by their words; cluster: by default the hash of the text, so exact copies never share a bin."""
    same = cluster if cluster is not None else F.when(F.col("text").isNotNull(), F.xxhash64("text"))
    return pack(documents.select("doc_id", word_count(F.col("text")).alias("size"), "source", same.alias("cluster")), capacity, shard)
