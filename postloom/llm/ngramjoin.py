"""Similarity join of documents by the Jaccard index of their word n-grams, with PartEnum signatures.

Sets whose sizes may go together fall into bands; a pair is looked for in the instance
of the larger set's band, so each set takes part in its own band's and the next.  In an
instance two similar sets differ in at most k features.  The feature domain is hashed
into groups of three (or two) partitions each; with k // 2 + 1 groups, one group has at
most one differing partition, so both sets share a signature of its others.  Each group
gives a signature for each partition left out.

A signature of empty partitions says nothing.  More groups are used than needed
(`slack`), so two similar sets share a signature that isn't empty, unless both have
many empty ones: such sets also emit signatures of another partitioning, and if they
have as many there, of the next; after the last they emit empty ones too.

Equal sets are one node, known by a hash of 64 bits: among 10^9 different sets the odds that
any two share one are 1 in 37, and such a pair counts as copies.  Nodes that share a signature form a candidate group; equal
groups collapse.  First each group's members are verified against the member that has
most company in all its groups, then, where components are left, against the one that
has most outside the first's component.  In groups still left in several components all
pairs across components are looked at, in blocks of bounded size, where the counts of
features in each of CELLS cells bound what two sets have in common; pairs within the
bound are verified.  Pairs of the first steps pass such a bound too, by more cells for
larger sets, before their features are moved.  Verification counts common features exactly.  Components are labelled with
their smallest doc_id and, of that, the smallest hash of a set, by passing labels along links and jumping along labels.

Defined cases: null and empty texts, or texts of white space, have an empty set, link
with nothing and are their own component; a text of fewer words than n is one feature;
rows with a null doc_id link with nothing and have a null component; rows of one doc_id
with different texts are nodes of their own; empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from postloom.llm.common import bounded_batches, key_set, maybe_in, mix, partitions, shingle_set, spared, stored, word_hashes

PARTS, SEEDS, SIG_BITS = 3, 4, 52
#: Candidate groups of more members are known by their signature, others by their members.
LARGE = 100_000
ROWS = 50_000
#: Cells of the histograms, a power of 2; members of a group that one task compares with as many others.
CELLS, BLOCK = 256, 2000


class Instances:
    """Bands of sizes and the parameters of their instances, for a threshold of num / den."""

    def __init__(self, num: int, den: int, parts: int = PARTS) -> None:
        self.num, self.den, self.parts = num, den, parts
        self.upper = [0]  # upper[j]: largest size of band j
        self.groups: list[int] = [0]

    def upto(self, size: int) -> None:
        while self.upper[-1] < size:
            r = (self.upper[-1] + 1) * self.den // self.num
            self.upper.append(r)
            k = 2 * r * (self.den - self.num) // (self.den + self.num)
            n = k // 2 + 1
            slack = 0 if k < 16 else 1 + n // (60 if self.parts > 2 else 25)
            self.groups.append(n + slack if k else 0)

    def of(self, size: int) -> list[int]:
        j = bisect_left(self.upper, size)
        if j + 1 >= len(self.upper):
            self.upto(size)
            self.upto(self.upper[-1] + 1)
            j = bisect_left(self.upper, size)
        return [j, j + 1]

    def need(self, size: int, j: int) -> int:
        """Groups, at least, in which a set and any similar one of instance j have no more than one differing partition."""
        most = min(self.upper[j], size * self.den // self.num)
        differing = (self.den - self.num) * (size + most) // (self.den + self.num)
        return self.groups[j] - differing // 2


def signatures(features: np.ndarray, instances: Instances) -> np.ndarray:
    """The set's signatures of both its instances."""
    out = []
    for j in instances.of(len(features)):
        groups, parts = instances.groups[j], instances.parts
        if not groups:  # only equal sets go together
            continue
        need = instances.need(len(features), j)
        for seed in range(SEEDS):
            u = mix(features + np.uint64((seed + 1) * 0x632BE59BD9B4E019 % (1 << 64)))
            cell = ((u >> np.uint64(32)) % np.uint64(groups) * np.uint64(parts) + (u & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int64)
            sums = np.zeros(groups * parts, np.uint64)
            np.add.at(sums, cell, features)
            held = np.bincount(cell, minlength=groups * parts).reshape(groups, parts)
            sums = sums.reshape(groups, parts)
            rest, left = sums.sum(1, dtype=np.uint64)[:, None] - sums, held.sum(1)[:, None] - held
            name = np.arange(groups * parts, dtype=np.uint64).reshape(groups, parts) + np.uint64((j * SEEDS + seed) << 32)
            sig = mix(rest + mix(name))
            bare = int((left == 0).any(1).sum()) >= need
            out.append(sig[left > 0] if not (bare and seed == SEEDS - 1) else sig.ravel())
            if not bare:
                break
    return np.concatenate(out) >> np.uint64(64 - SIG_BITS) if out else np.zeros(0, np.uint64)


def set_id(features: np.ndarray) -> int:
    """Hash of a set, as a signed 64-bit integer."""
    with np.errstate(over="ignore"):
        return int(mix(mix(features).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(features))).view(np.int64)[0])


#: Sets that a task remembers, so as to sign copies once.
SIGNED = 500_000


def _signed(documents: DataFrame, n: int, num: int, den: int, parts: int) -> DataFrame:
    """sig, ref for each signature, those of equal sets once a task; and for each row one with its doc_id and the size of its set, whose sig is a hash of the doc_id, so that copies don't meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        instances = Instances(num, den, parts)
        known: set[int] = set()
        sig, ref, doc, size = [], [], [], []

        def out() -> pa.RecordBatch:
            counts = [len(s) for s in sig]
            arrays = [
                pa.array(np.concatenate(sig).view(np.int64)),
                pa.array(np.repeat(np.array(ref, np.int64), counts)),
                pa.array([d for ds in doc for d in ds], pa.int64()),
                pa.array(np.repeat(np.array(size, np.int32), counts)),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["sig", "ref", "doc_id", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                features = shingle_set(word_hashes(text), n)
                if not len(features):
                    continue
                one = set_id(features)
                found = np.zeros(0, np.uint64)
                if one not in known:
                    if len(known) >= SIGNED:
                        known.clear()
                    known.add(one)
                    found = signatures(features, instances)
                spread = mix(np.array([doc_id], np.int64).view(np.uint64)) >> np.uint64(64 - SIG_BITS)
                sig.append(np.concatenate([spread, found]))
                ref.append(one)
                doc.append([doc_id] + [None] * len(found))
                size.append(len(features))
                if sum(map(len, sig[-64:])) > ROWS or len(sig) >= 200:
                    yield out()
                    sig, ref, doc, size = [], [], [], []
        if sig:
            yield out()

    return documents.mapInArrow(spared(run), "sig long, ref long, doc_id long, n int")


def _grouped(rows: DataFrame) -> DataFrame:
    """gid, ref, n of candidate groups, from rows sorted by sig and ref; rows with a doc_id pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held = [np.zeros(0, np.int64)] * 3  # sig, ref, n of the signature not yet complete
        large: int | None = None

        def table(gid: np.ndarray, ref: np.ndarray, n: np.ndarray, doc=None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(gid), pa.array(ref), pa.nulls(len(ref), pa.int64()) if doc is None else doc, pa.array(n.astype(np.int32))], ["gid", "ref", "doc_id", "n"])

        def groups(sig: np.ndarray, ref: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.diff(sig, prepend=sig[:1] - 1))
            sizes = np.diff([*starts, len(sig)])
            if not (sizes > 1).any():
                return
            gid = np.add.reduceat(mix(ref.view(np.uint64)), starts)
            gid = mix(gid + sizes.astype(np.uint64)).view(np.int64)
            want = sizes > 1
            _, first = np.unique(gid, return_index=True)
            fresh = np.zeros(len(gid), bool)
            fresh[first] = True
            want &= fresh
            for i in np.flatnonzero(want):
                if int(gid[i]) in seen:
                    want[i] = False
            if len(seen) > 500_000:
                seen.clear()
            seen.update(gid[want].tolist())
            if want.any():
                row = np.repeat(want, sizes)
                yield table(np.repeat(gid, sizes)[row], ref[row], n[row])

        for batch in batches:
            doc = batch.column(2)
            ours = doc.is_valid().to_numpy(zero_copy_only=False)
            if ours.any():
                mask = pa.array(ours)
                part = batch.filter(mask)
                yield table(part.column(1).to_numpy(), part.column(1).to_numpy(), part.column(3).to_numpy(), part.column(2))
            sig, ref, n = (np.concatenate([h, batch.column(i).to_numpy()[~ours]]) for h, i in zip(held, (0, 1, 3), strict=True))
            if not len(sig):
                continue
            if len(sig) > 1:
                keep = np.ones(len(sig), bool)
                keep[1:] = (sig[1:] != sig[:-1]) | (ref[1:] != ref[:-1])
                sig, ref, n = sig[keep], ref[keep], n[keep]
            last = int(np.searchsorted(sig, sig[-1]))
            if large is not None:
                end = int(np.searchsorted(sig, large, side="right"))
                rest = end if end < len(sig) else end - 1  # the last row stays, to tell its repeats
                if rest:
                    yield table(np.full(rest, large, np.int64), ref[:rest], n[:rest])
                sig, ref, n, last = sig[rest:], ref[rest:], n[rest:], max(0, last - rest)
                if end - rest == 0:
                    large = None
            if last:
                yield from groups(sig[:last], ref[:last], n[:last])
            if large is None and len(sig) - last > LARGE:
                large = int(sig[-1])
                yield table(np.full(len(sig) - last - 1, large, np.int64), ref[last:-1], n[last:-1])
                last = len(sig) - 1
            held = [sig[last:], ref[last:], n[last:]]
        if len(held[0]):
            if large is not None:
                yield table(np.full(len(held[0]), large, np.int64), held[1], held[2])
            else:
                yield from groups(*held)

    return rows.mapInArrow(spared(run), "gid long, ref long, doc_id long, n int")


def _sets(documents: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """ref, features (sorted, packed) for reps (ref, doc_id)."""
    found = documents.sparkSession.sparkContext.broadcast(key_set(reps, "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(maybe_in(found.value, batch.column(0).to_numpy())))
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for lo in range(0, len(ids), 500):
                sets = [shingle_set(word_hashes(t), n) for t in texts[lo : lo + 500]]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s) for s in sets], pa.int64()), pa.array(ids[lo : lo + 500], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["ref", "doc_id", "features"])

    made = documents.mapInArrow(spared(run), "ref long, doc_id long, features binary")
    # joined by ref alone, of which reps have one row each: so the grouping needs no second shuffle
    chosen = reps.select("ref", F.col("doc_id").alias("rep"))
    return made.join(chosen, "ref").where("doc_id = rep").groupBy("ref").agg(F.first("features").alias("features"))


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are similar enough."""
    both = pairs.join(sets.select(F.col("ref").alias("a"), F.col("features").alias("fa")), "a").join(sets.select(F.col("ref").alias("b"), F.col("features").alias("fb")), "b").select("a", "b", "fa", "fb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for fa, fb in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(fa.as_buffer(), np.uint64), np.frombuffer(fb.as_buffer(), np.uint64)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                common = int((x[at] == y).sum())
                keep.append(den * common >= num * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(spared(run), "a long, b long")


def _counts(features: np.ndarray) -> bytes:
    """Features by cell, the highest bits of their hashes: 4 to 8 a cell, CELLS cells at least; after the size of a number."""
    bits = max(CELLS.bit_length() - 1, (len(features) // 4).bit_length() - 1)
    held = np.bincount((features >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
    size = 1 if held.max(initial=0) < 256 else 4
    return bytes([size]) + held.astype(f"<u{size}").tobytes()


def _folded(raw: bytes, cells: int) -> np.ndarray:
    held = np.frombuffer(raw, f"<u{raw[0]}", offset=1)
    return held.reshape(cells, -1).sum(1, dtype=np.int64) if len(held) > cells else held.astype(np.int64)


def _cells(sets: DataFrame) -> DataFrame:
    """ref, cells: the sets' counts, of a thirtieth of their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_counts(np.frombuffer(f.as_buffer(), np.uint64)) for f in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["ref", "cells"])

    return sets.select("ref", "features").mapInArrow(spared(run), "ref long, cells binary")


def _plausible(pairs: DataFrame, cells: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that the counts don't rule out: two sets have at most the lesser count of each cell in common."""
    both = pairs.join(cells.select(F.col("ref").alias("a"), F.col("cells").alias("ca")), "a").join(cells.select(F.col("ref").alias("b"), F.col("cells").alias("cb")), "b").select("a", "b", "ca", "cb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ca, cb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                cells = min((len(c) - 1) // c[0] for c in (ca, cb))
                x, y = _folded(ca, cells), _folded(cb, cells)
                most = int(np.minimum(x, y).sum())
                keep.append(den * most >= num * (int(x.sum()) + int(y.sum()) - most))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(spared(run), "a long, b long")


def _across(held: DataFrame, counts: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) across components (label) of groups (gid) that the histograms don't rule out."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_folded(c, CELLS) for c in batch.column(1).to_pylist()]
            # a cell of more than the counter holds: counts that rule nothing out
            found = [np.full(CELLS, 65_535) if c.max() > 65_535 else c for c in found]
            found = [c.astype("<u2" if c.max() > 255 else np.uint8).tobytes() for c in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["ref", "cells"])

    cells = counts.join(held.select("ref").distinct(), "ref", "left_semi").select("ref", "cells").mapInArrow(spared(folded), "ref long, cells binary")
    blocks = held.groupBy("gid").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = held.join(blocks, "gid").withColumn("own", F.pmod(F.xxhash64("ref"), F.col("blocks")).cast("int")).join(cells, "ref")
    # a member meets each block of its group once: with it the pair of blocks that its task compares
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("gid", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "ref", "n", "label", "cells")

    def compare(group: pa.Table) -> pa.Table:
        ref, n, label, own = (group.column(c).to_numpy() for c in ("ref", "n", "label", "own"))
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        grid = np.stack([np.frombuffer(c, "<u2" if len(c) > CELLS else np.uint8).astype(np.int32) for c in group.column("cells").to_pylist()])
        a, b = [], []
        right = np.flatnonzero(own == y)
        for i in np.flatnonzero(own == x):
            js = right[(label[right] != label[i]) & (den * np.minimum(n[right], n[i]) >= num * np.maximum(n[right], n[i]))]
            if x == y:
                js = js[ref[js] > ref[i]]
            if len(js):
                most = np.minimum(grid[js], grid[i]).sum(1)
                js = js[den * most >= num * (n[js].astype(np.int64) + n[i] - most)]
                a.append(np.full(len(js), ref[i]))
                b.append(ref[js])
        a, b = (np.concatenate([np.zeros(0, np.int64), *z]) for z in (a, b))
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return met.groupBy("gid", "x", "y").applyInArrow(compare, "a long, b long").distinct()


def components(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """ref, label for the nodes (ref, doc_id) that have links (a, b): the smallest (doc_id, ref) of each one's component; several components may have one smallest doc_id."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).toDF("u", "v").distinct(), "edges")
    labels = stored(nodes.join(edges.select(F.col("u").alias("ref")), "ref", "left_semi").select("ref", F.struct("doc_id", "ref").alias("label")), "labels")
    while True:
        sent = edges.join(labels.select(F.col("ref").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("near"))
        lower = labels.join(sent.withColumnRenamed("v", "ref"), "ref", "left").select("ref", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        roots = labels.select(F.col("ref").alias("root"), F.col("label").alias("further"))
        new = lower.withColumn("root", F.col("label.ref")).join(roots, "root", "left").select("ref", "old", F.least("label", F.coalesce("further", "label")).alias("label"))
        new = stored(new, "labels")
        labels = new.select("ref", "label")
        if new.where("old <> label").isEmpty():
            return labels


def labelled(documents: DataFrame, n: int, num: int, den: int, parts: int) -> DataFrame:
    """doc_id, ref (its set), n (the set's size) and label for every row that has a doc_id and a set; label: the smallest (doc_id, ref) of its component."""
    spark = documents.sparkSession
    bounded_batches(spark)
    known = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    rows = _signed(known, n, num, den, parts).repartition(partitions(spark), "sig").sortWithinPartitions("sig", "ref")
    table = stored(_grouped(rows), "groups")
    docs = table.where("doc_id is not null").select("doc_id", "ref", "n")
    groups = stored(table.where("doc_id is null").select("gid", "ref", "n").distinct(), "members")
    reps = stored(docs.join(groups.select("ref").distinct(), "ref", "left_semi").groupBy("ref").agg(F.min("doc_id").alias("doc_id")), "nodes")
    sets = stored(_sets(known, reps, n), "sets")
    cells = stored(_cells(sets), "cells")
    close = f"{den} * least(na, nb) >= {num} * greatest(na, nb)"
    company = groups.join(groups.groupBy("gid").agg(F.count("*").alias("size")), "gid").groupBy("ref").agg(F.sum("size").alias("company"))
    held = stored(groups.join(company, "ref").withColumn("label", F.col("ref")), "held")
    most = F.max(F.struct("company", "ref", "n", "label"))
    links = labels = None
    for turn in range(2):
        centres = held.groupBy("gid").agg(most.alias("c"))
        if turn:
            beside = held.join(centres, "gid").where("label <> c.label").drop("c")
            centres = beside.groupBy("gid").agg(most.alias("c"))
        pairs = held.join(centres, "gid").where("label <> c.label").select(F.col("c.ref").alias("a"), F.col("c.n").alias("na"), F.col("ref").alias("b"), F.col("n").alias("nb"))
        pairs = pairs.where(close).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = stored(_plausible(pairs, cells, num, den), "pairs")
        new = stored(_links(pairs, sets, num, den), "links")
        links = new if links is None else links.union(new)
        if turn and new.isEmpty():
            break
        labels = components(links, reps)
        held = held.drop("label").join(labels.select("ref", F.col("label.ref").alias("label")), "ref", "left").withColumn("label", F.coalesce("label", "ref"))
        open_ = held.groupBy("gid").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("gid")
        held = stored(held.join(open_, "gid", "left_semi"), "held")
    more = stored(_links(stored(_across(held, cells, num, den), "pairs"), sets, num, den), "links")
    if not more.isEmpty():
        labels = components(links.union(more), reps)
    node = docs.groupBy("ref").agg(F.min("doc_id").alias("rep")).join(labels, "ref", "left").select("ref", F.coalesce("label", F.struct(F.col("rep").alias("doc_id"), "ref")).alias("label"))
    return docs.join(node, "ref").select("doc_id", "ref", "n", "label")


def _bare(documents: DataFrame) -> DataFrame:
    """Rows with a doc_id and an empty set."""
    return documents.where(F.col("doc_id").isNotNull()).where(~F.coalesce(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), F.lit(False)))


def join(documents: DataFrame, n: int = 4, num: int = 85, den: int = 100, parts: int = PARTS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row: linked are rows whose sets of n-word shingles have a Jaccard index of num / den at least.

    parts: partitions of a group; with two there are a third fewer signatures than with three, each of fewer features.
    """
    linked = labelled(documents, n, num, den, parts).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("label.doc_id").alias("component_id"))
    empty = _bare(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").cast("long").alias("component_id"))
    lost = documents.where(F.col("doc_id").isNull()).select(F.lit(None).cast("long").alias("doc_id"), _null_size(n).alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return linked.unionByName(empty).unionByName(lost)


def _null_size(n: int):
    """Size of the set of a row that takes no part."""
    @F.pandas_udf("long")
    def size(text: pd.Series) -> pd.Series:
        return text.map(lambda t: len(shingle_set(word_hashes(t), n))).astype("int64")

    return size(F.col("text"))


def keep_one(documents: DataFrame, n: int = 5, num: int = 80, den: int = 100, parts: int = PARTS) -> DataFrame:
    """The rows, with all their columns, of one row for each component: that of its smallest (doc_id, set), and of several such the one whose columns hash lowest.

    Rows with an empty set are near copies of those alone that equal them in doc_id and text.  Rows with a null doc_id stay.
    """
    own = (F.col("doc_id") == F.col("label.doc_id")) & (F.col("ref") == F.col("label.ref"))
    rows = labelled(documents, n, num, den, parts).groupBy("ref", "doc_id").agg(F.count("*").alias("rows"), F.first(own).alias("stays"))
    bare = _bare(documents).groupBy(F.xxhash64("text").alias("ref"), F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("rows"), F.lit(True).alias("stays"))
    found = stored(rows.unionByName(bare).where("rows > 1 or not stays").select("doc_id", "ref", "stays"), "gone")
    out = _drop(documents, found, n)
    again = found.where("stays")
    return out if again.isEmpty() else out.unionByName(_first(documents, again, n))


def _among(documents: DataFrame, found: DataFrame, n: int) -> tuple[DataFrame, DataFrame, str]:
    """Rows whose doc_id may be in found, with the hash of their set; all other rows; the name of the hash's column."""
    at, text = documents.columns.index("doc_id"), documents.columns.index("text")
    keys = documents.sparkSession.sparkContext.broadcast(key_set(found, "doc_id"))
    name = "_" * (1 + max(map(len, documents.columns))) + "ref"

    def part(inside: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                mask = maybe_in(keys.value, batch.column(at).fill_null(-1).to_numpy()) & batch.column(at).is_valid().to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(mask if inside else ~mask))
                if inside:
                    sets = (shingle_set(word_hashes(t), n) for t in batch.column(text).to_pylist())
                    refs = pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())
                    batch = pa.RecordBatch.from_arrays([*batch.columns, refs], [*batch.schema.names, name])
                yield batch

        schema = StructType([*documents.schema.fields, StructField(name, LongType())]) if inside else documents.schema
        made = documents.mapInArrow(spared(run), schema)
        return made.withColumn(name, F.coalesce(name, F.xxhash64("text"))) if inside else made

    return part(True), part(False), name


def _drop(documents: DataFrame, found: DataFrame, n: int) -> DataFrame:
    """documents without the rows whose (doc_id, ref) is in found; only rows that may be among them are shuffled."""
    inside, outside, ref = _among(documents, found, n)
    gone = found.select("doc_id", F.col("ref").alias(ref))
    return inside.join(gone, ["doc_id", ref], "left_anti").select(documents.columns).unionByName(outside)


def _first(documents: DataFrame, again: DataFrame, n: int) -> DataFrame:
    """One row of documents for each (doc_id, ref) of again: repeats are left out before the shuffle."""
    inside, _, ref = _among(documents, again, n)
    row = F.struct(*documents.columns)
    one = inside.groupBy("doc_id", ref).agg(F.min_by(row, F.xxhash64(*documents.columns)).alias("row"))
    return one.join(again.select("doc_id", F.col("ref").alias(ref)), ["doc_id", ref], "left_semi").select("row.*")
