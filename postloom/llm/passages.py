"""Removal of passages that an earlier document has: suffix automata and matching statistics.

Words are runs of anything but ASCII white space, unchanged.  A window is `window`
consecutive words of one document; each word covered by a window whose words also start
in a document with a smaller doc_id goes.

Reference shards can't be broadcast whole: the reference is the corpus itself.  So windows
are dealt by anchor, the least hash among their runs of `gram` words; equal windows have
equal anchors.  Consecutive windows of one anchor form a piece.  Only anchors of two
documents count further, equal pieces collapse into one with its first document, and of
the different pieces of an anchor only runs of windows that occur in two of them are left:
what a frequent line has around it is gone by then, and a frequent passage is one run.

These runs are the reference.  A shard of at most `shard_words` words of them becomes a
generalised suffix automaton whose states know the first document of their words; the
runs of the same anchors are streamed through it for their matching statistics, and a
window that matches in full takes the first document of its state.  An anchor with
more runs than a shard holds has several shards, and its runs meet each.  No shard, run or
verdict passes through the driver.

Words are known by 64-bit hashes, pieces and runs by 64-bit hashes of those.

Defined cases: null, empty and blank texts have no words, and nothing is removed; a null
doc_id is smaller than all others; rows of one doc_id remove nothing from each other, as
neither is smaller, and keep a row each; empty tables give no rows.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import bounded_batches, located_words, mix, powers, spared, stored
from postloom.llm.linededup import text_hash

WINDOW, GRAM = 50, 25
#: Words of the reference runs that one automaton holds.
SHARD_WORDS = 60_000
_NULL = -(1 << 63)
_LOW = np.uint64(0xFFFFFFFF)


def hashes_of(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word of the text, as it is written."""
    return located_words(text.encode("utf-8", "surrogatepass"))[0] if text else np.zeros(0, np.uint64)


def sums(words: np.ndarray) -> np.ndarray:
    """S[i]: polynomial hash of the first i words."""
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(len(words) + 1)[0][: len(words)], out=total[1:])
    return total


def slices(total: np.ndarray, starts: np.ndarray, sizes: np.ndarray | int) -> np.ndarray:
    """Hashes of the words from starts on, so many as sizes says, wherever they stand."""
    return mix((total[starts + sizes] - total[starts]) * powers(len(total))[1][starts] + np.asarray(sizes).astype(np.uint64))


def pieces(words: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each piece the anchor's hash, the hash of its words, its first word and its number of windows."""
    if len(words) < window:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    total = sums(words)
    grams = slices(total, np.arange(len(words) - gram + 1), gram)
    # the leftmost of the least: high bits of the hash, then the place
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    width, span = 1, window - gram + 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    at = (least & _LOW).astype(np.int64)
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    n = np.diff(starts, append=len(at))
    return grams[at[starts]], slices(total, starts, n + window - 1), starts, n


class Automaton:
    """Generalised suffix automaton of runs of symbols; each state knows the least key among the runs that hold its words."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.key = [-1], [0], [1 << 63]

    def add(self, run: list[int], key: int) -> None:
        nxt, link, length, keys = self.next, self.link, self.length, self.key
        last = 0
        for c in run:
            there = nxt[last].get(c)
            if there is not None and length[there] == length[last] + 1:
                last = there
                if key < keys[last]:
                    keys[last] = key
                continue
            clone_of = there
            if there is None:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                keys.append(key)
                p = last
                while p != -1 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p == -1:
                    last = cur
                    continue
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                    last = cur
                    continue
                clone_of = q
            else:
                p, cur = last, -1
            q = clone_of
            clone = len(nxt)
            nxt.append(dict(nxt[q]))
            link.append(link[q])
            length.append(length[p] + 1)
            keys.append(keys[q])
            while p != -1 and nxt[p].get(c) == q:
                nxt[p][c] = clone
                p = link[p]
            link[q] = clone
            if cur == -1:
                last = clone
                if key < keys[clone]:
                    keys[clone] = key
            else:
                link[cur] = clone
                last = cur

    def close(self) -> None:
        """Passes the least keys on to the shorter words of each state."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if up > 0 and self.key[s] < self.key[up]:
                self.key[up] = self.key[s]

    def first(self, run: list[int], window: int) -> list[int]:
        """For each window of the run the least key of the runs that hold it, or 2^63."""
        nxt, link, length, keys = self.next, self.link, self.length, self.key
        state, matched, out = 0, 0, []
        for i, c in enumerate(run):
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            if matched > window:
                matched = window
            while state and length[link[state]] >= window:
                state = link[state]
            if i >= window - 1:
                out.append(keys[state] if matched >= window else 1 << 63)
        return out


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("key"), "text")


def piece_table(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """anchor, piece, key, th, pos, n for each piece of docs (key, text); th tells rows of one key apart."""
    names = ["anchor", "piece", "key", "th", "pos", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                keys, texts = (batch.column(i).slice(lo, 1000).to_pylist() for i in (0, 1))
                found = [pieces(hashes_of(t), window, gram) for t in texts]
                counts = [len(x[0]) for x in found]
                if not any(counts):
                    continue
                th = np.array([text_hash(t) if n else 0 for t, n in zip(texts, counts, strict=True)], np.int64)
                anchor, piece, pos, n = (np.concatenate(x) for x in zip(*found, strict=True))
                arrays = [anchor.view(np.int64), piece.view(np.int64), np.repeat(np.array(keys, np.int64), counts), np.repeat(th, counts), pos.astype(np.int32), n.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names)

    bounded_batches(docs.sparkSession)
    return docs.where(F.col("text").isNotNull()).mapInArrow(spared(run), "anchor long, piece long, key long, th long, pos int, n int")


def content_table(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """anchor, piece, key and words (hashes) of the wanted pieces (anchor, piece, key, th, pos, n)."""
    places = wanted.groupBy("key", "th").agg(F.collect_list(F.struct("anchor", "piece", "pos", "n")).alias("wanted"))
    rows = docs.where(F.col("text").isNotNull()).withColumn("th", _text_hash(docs)).join(places, ["key", "th"]).dropDuplicates(["key", "th"]).select("key", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, wanted_ in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = hashes_of(text.as_py()).view(np.int64)
                parts = wanted_.as_py()
                lists = pa.array([words[w["pos"] : w["pos"] + w["n"] + window - 1] for w in parts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([w["anchor"] for w in parts], pa.int64()), pa.array([w["piece"] for w in parts], pa.int64()), pa.array([key] * len(parts), pa.int64()), lists], ["anchor", "piece", "key", "words"])

    return rows.mapInArrow(spared(run), "anchor long, piece long, key long, words array<long>")


def _text_hash(docs: DataFrame):
    @F.pandas_udf("long")
    def th(texts):
        return texts.map(text_hash)

    return th("text")


def window_table(content: DataFrame, window: int) -> DataFrame:
    """h, piece and i for each window of the pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                sizes = np.diff(part.column(1).offsets.to_numpy()) - window + 1
                flat = [slices(sums(x := w.values.to_numpy().view(np.uint64)), np.arange(len(x) - window + 1), window) for w in part.column(1)]
                h = np.concatenate(flat).view(np.int64)
                i = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(i)], ["h", "piece", "i"])

    return content.select("piece", "words").mapInArrow(spared(run), "h long, piece long, i int")


def run_table(content: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """anchor, piece, key, at, run (hash) and words of each run of consecutive shared windows (piece, windows: their places)."""
    rows = content.join(shared, "piece").select("anchor", "piece", "key", "words", "windows")
    names = ["anchor", "piece", "key", "at", "run", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, at, lists = [], [], []
            for r in range(batch.num_rows):
                places = np.sort(batch.column(4)[r].values.to_numpy())
                words = batch.column(3)[r].values.to_numpy()
                for part in np.split(places, np.flatnonzero(np.diff(places) > 1) + 1):
                    of.append(r)
                    at.append(int(part[0]))
                    lists.append(words[part[0] : part[-1] + window])
            hashes = [slices(sums(w.view(np.uint64)), np.zeros(1, np.int64), len(w))[0] for w in lists]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pa.array(of, pa.int64())) for k in (0, 1, 2)], pa.array(at, pa.int32()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(lists, pa.list_(pa.int64()))], names)

    return rows.mapInArrow(spared(run), "anchor long, piece long, key long, at int, run long, words array<long>")


def firsts(runs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """run and the first document of each of its windows, from runs (anchor, run, key, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, list[int]]] = []  # run, key, words; of whole anchors
        size, now, whole = 0, None, 0

        def done(rows: list[tuple[int, int, list[int]]]) -> pa.RecordBatch:
            best = [[1 << 63] * (len(w) - window + 1) for _, _, w in rows]
            lo = 0
            while lo < len(rows):
                shard, hi, n = Automaton(), lo, 0
                while hi < len(rows) and (hi == lo or n + len(rows[hi][2]) <= shard_words):
                    shard.add(rows[hi][2], rows[hi][1])
                    n += len(rows[hi][2])
                    hi += 1
                shard.close()
                for k, (_, _, words) in enumerate(rows):
                    best[k] = list(map(min, best[k], shard.first(words, window)))
                lo = hi
            return pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in rows], pa.int64()), pa.array(best, pa.list_(pa.int64()))], ["run", "firsts"])

        for batch in batches:
            for anchor, id_, key, words in zip(*(batch.column(i) for i in range(4)), strict=True):
                anchor, words = anchor.as_py(), words.values.to_pylist()
                if anchor != now:
                    whole, now = len(held), anchor
                    if size >= shard_words:
                        yield done(held)
                        held, size, whole = [], 0, 0
                elif whole and size >= shard_words:  # the anchors before this one are complete
                    yield done(held[:whole])
                    held = held[whole:]
                    size, whole = sum(len(w) for _, _, w in held), 0
                held.append((id_.as_py(), key.as_py(), words))
                size += len(words)
        if held:
            yield done(held)

    dealt = runs.select("anchor", "run", "key", "words").repartition("anchor").sortWithinPartitions("anchor", "key", "run")
    return dealt.mapInArrow(spared(run), "run long, firsts array<long>")


def removed(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """key, th and gone (pos, size): the stretches of words to remove from each row that has some."""
    docs = _keyed(documents)
    all_ = stored(piece_table(docs, window, gram), "pieces")
    # anchors of two documents
    shared = all_.groupBy("anchor").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least < most").select("anchor")
    found = stored(all_.join(stored(shared, "anchors"), "anchor"), "shared")
    place = F.struct("key", "th", "pos")
    piece = stored(found.groupBy("anchor", "piece", "n").agg(F.min(place).alias("first")), "distinct")
    several = piece.groupBy("anchor").agg(F.count("*").alias("pieces")).where("pieces > 1").select("anchor")
    wanted = piece.join(stored(several, "several"), "anchor").select("anchor", "piece", "first.key", "first.th", "first.pos", "n")
    content = stored(content_table(docs, wanted, window), "content")
    windows = stored(window_table(content, window), "windows")
    both = windows.groupBy("h").agg(F.min("piece").alias("a"), F.max("piece").alias("b")).where("a <> b").select("h")
    inside = windows.join(stored(both, "both"), "h").groupBy("piece").agg(F.collect_list("i").alias("windows"))
    runs = stored(run_table(content, inside, window), "runs")
    reference = runs.groupBy("anchor", "run").agg(F.min("key").alias("key"), F.first("words").alias("words"))
    first = stored(firsts(reference, window, shard_words), "firsts")
    # windows of a piece's first document that an earlier one has in another piece
    each = runs.select("run", "piece", "key", "at").join(first, "run").select("piece", "key", "at", F.posexplode("firsts").alias("i", "by")).where("by < key")
    early = stored(each.groupBy("piece").agg(F.collect_list(F.col("at") + F.col("i")).alias("early")), "early")
    held = found.join(piece.select("piece", "n", F.col("first.key").alias("owner")), ["piece", "n"])
    later = held.where("key > owner").select("key", "th", "pos", (F.col("n") + window - 1).alias("size"))
    own = held.where("key = owner").join(early, "piece").select("key", "th", "pos", F.explode("early").alias("i")).select("key", "th", (F.col("pos") + F.col("i")).alias("pos"), F.lit(window).alias("size"))
    return later.unionByName(own).groupBy("key", "th").agg(F.collect_list(F.struct("pos", "size")).alias("gone"))


def kept(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, n_removed and kept, the words that stay, joined by one space, for each row."""
    docs = _keyed(documents)
    gone = stored(removed(documents, window, gram, shard_words), "gone")
    rows = docs.withColumn("th", F.when(F.col("text").isNotNull(), _text_hash(docs))).join(gone, ["key", "th"], "left").select("key", "text", "gone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, cut, out = [], [], []
            for text, gone_ in zip(batch.column(1), batch.column(2), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                edges = np.zeros(len(words) + 1, np.int64)
                if gone_.is_valid:
                    pos, size = (gone_.values.field(k).to_numpy() for k in (0, 1))
                    np.add.at(edges, pos, 1)
                    np.add.at(edges, pos + size, -1)
                stays = np.cumsum(edges[:-1]) == 0
                n.append(len(words))
                cut.append(int((~stays).sum()))
                out.append((b" ".join(words) if not cut[-1] else b" ".join(w for w, s in zip(words, stays.tolist(), strict=True) if s)).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array(out, pa.string())], ["key", "n_words", "n_removed", "kept"])

    found = rows.mapInArrow(spared(run), "key long, n_words long, n_removed long, kept string")
    return found.select(F.when(F.col("key") != _NULL, F.col("key")).alias("doc_id"), "n_words", "n_removed", "kept")


def digest(text: str) -> str:
    """Lower-case hex SHA-256 of the text in UTF-8."""
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
