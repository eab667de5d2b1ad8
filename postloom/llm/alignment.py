"""Alignment of two tokenizers' tokens by a dangling-suffix transducer.

A (byte-level BPE) encodes a space and the text, B (pieces with byte fallback) the text, to
which it adds the space itself.  The transducer reads both token sequences side by side.
Its state is the dangling suffix: which side leads, and the bytes that it has ahead.  The
next token is the other side's; it eats some of the suffix, all of it, or goes beyond and
leads itself.  Transitions are memoised by suffix and token.  An empty suffix closes a
group: a place where tokens of both sides end.  Bytes that differ end the document.

Both tokenizers part a text before a space or line feed that stands between two characters
that aren't white space: A by its pattern, B as no piece has one of these but at its
start (checked when it is loaded; else texts are taken whole).  The transducer's state is empty
there, so units between such places are aligned once and remembered.

A and B tokens whose byte ranges share a group are linked.  How many documents hold a pair
linked is counted over the whole table: the rows that a task reads form blocks, a block sends each
of its pairs once with its number of documents, and gets back the count in all and
whether it is the A id's highest.  Links of a row are stored as distinct pairs and
how often they occur.

Defined cases: null and empty texts, and texts whose joined A or B bytes aren't a space and the text
(as with U+2581), have no tokens: zeros and an empty groups_sha256; they hold no pairs.
Repeated rows each count as a document; a null doc_id is a row like any other; empty
tables give no rows.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import bounded_batches, spared, sparing, stored

#: Units that a worker remembers as met lately; as many more as met before.  Longer units aren't remembered.
CACHE, CACHE_CHARS = 260_000, 64
#: Transitions that are remembered; a full memory is emptied.
TRANSITIONS = 500_000
#: A block ends with the row that brings its links (distinct by row) to so many.
BLOCK_LINKS = 2_000_000
#: White space but for spaces and line feeds.
_ODD_SPACE = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n"]
_SPLIT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_MARK = "▁"


class Transducer:
    """Aligns token sequences given as ids, by the bytes of each side's ids."""

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]) -> None:
        self.bytes = (bytes_a, bytes_b)
        #: (side that leads, its bytes ahead, the other side's next id) to the state after it; None where bytes differ.
        self.moves: dict[tuple[int, bytes, int], tuple[int, bytes] | None] = {}

    def move(self, state: tuple[int, bytes], token: int) -> tuple[int, bytes] | None:
        """After the lagging side's next token: an empty suffix closes the group."""
        side, ahead = state
        key = (side, ahead, token)
        if key not in self.moves:
            if len(self.moves) >= TRANSITIONS:
                self.moves.clear()
            new = self.bytes[1 - side][token]
            if ahead.startswith(new):
                self.moves[key] = side, ahead[len(new) :]
            else:
                self.moves[key] = (1 - side, new[len(ahead) :]) if new.startswith(ahead) else None
        return self.moves[key]

    def ends(self, a: list[int], b: list[int]) -> list[tuple[int, int]] | None:
        """How many A and B tokens there are up to the end of each group; None where the bytes of both sides differ."""
        out: list[tuple[int, int]] = []
        known, first, x, y, n_a, n_b = self.moves, self.bytes[0], 0, 0, len(a), len(b)
        while x < n_a:
            # A's next token leads; then whoever lags reads on
            state: tuple[int, bytes] | None = (0, first[a[x]])
            x += 1
            while state[1]:
                if state[0]:
                    if x == n_a:
                        return None
                    token, x = a[x], x + 1
                else:
                    if y == n_b:
                        return None
                    token, y = b[y], y + 1
                key = (*state, token)
                state = known[key] if key in known else self.move(state, token)
                if state is None:
                    return None
            out.append((x, y))
        return out if y == n_b else None

    def groups(self, a: list[int], b: list[int]) -> list[tuple[list[int], list[int]]] | None:
        """The groups of ids; None where the bytes of both sides differ."""
        ends = self.ends(a, b)
        return ends if ends is None else [(a[i:x], b[j:y]) for (i, j), (x, y) in zip([(0, 0), *ends], ends, strict=False)]


def _byte_level() -> dict[str, int]:
    """The byte of each character of the byte-level alphabet: printable bytes stand for themselves, the others in order for code points from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


#: Of a unit: n_a, n_b, n_groups, n_links, the groups as text and the links as 4-byte codes.
Unit = tuple[int, int, int, int, str, bytes]


class Aligner:
    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet, vocab = _byte_level(), self.a.get_vocab(with_added_tokens=False)
        bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            bytes_a[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
        self.n_b = self.b.get_piece_size()
        if len(bytes_a) * self.n_b > 1 << 32:
            raise ValueError("pairs of ids are known by 32 bits")
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(pieces)]
        self.transducer = Transducer(bytes_a, bytes_b)
        self.bytes_a = bytes_a
        #: The id of the added space alone, which a unit that starts with a line feed hasn't.
        self.space = self.b.piece_to_id(_MARK)
        free = not any(_MARK in p.lstrip(_MARK) or "\n" in p for p in pieces)
        self.free = free and self.b.id_to_piece(self.space) == _MARK
        self.lately: dict[str, Unit | None] = {}
        self.before: dict[str, Unit | None] = {}

    def units(self, text: str) -> list[str]:
        """The text with its space, cut where both tokenizers part it; the space of a unit that begins with no other white space is left out."""
        if not self.free:
            return [" " + text]
        if not any(c in text for c in _ODD_SPACE):
            units = text.replace("\n", " \n").split(" ")
            if "" not in units and "\n" not in units:
                return units
        return _SPLIT.split(" " + text)

    def encoded(self, raws: list[str]) -> list[tuple[list[int], list[int]]]:
        """Both sides' ids of units with their space."""
        a = [e.ids for e in self.a.encode_batch_fast(raws, add_special_tokens=False)]
        b = self.b.encode([r.removeprefix(" ") for r in raws], num_threads=1)
        return [(x, y if r[0] == " " else y[1:] if y[:1] == [self.space] else [-1]) for r, x, y in zip(raws, a, b, strict=True)]

    def aligned(self, unit: str, a: list[int], b: list[int]) -> Unit | None:
        """None where the unit's tokens don't give its bytes."""
        # where A's bytes are the unit's, the transducer finds whether B's are
        if -1 in b or b"".join([self.bytes_a[x] for x in a]) != unit.encode():
            return None
        ends = self.transducer.ends(a, b)
        if ends is None:
            return None
        texts, links, size, i, j = [], array("I"), self.n_b, 0, 0
        for x, y in ends:
            if x - i == 1 and y - j == 1:
                texts.append(f"{a[i]}|{b[j]}")
                links.append(a[i] * size + b[j])
            else:
                texts.append(f"{','.join(map(str, a[i:x]))}|{','.join(map(str, b[j:y]))}")
                links.extend([p * size + q for p in a[i:x] for q in b[j:y]])
            i, j = x, y
        return len(a), len(b), len(ends), len(links), ";".join(texts), links.tobytes()

    def learn(self, units: set[str]) -> None:
        """Adds the alignments of units to those met lately."""
        wanted = []
        for u in units:
            if u in self.before:
                self.lately[u] = self.before[u]
            else:
                wanted.append(u)
        raws = [u if u[0] in " \n" else " " + u for u in wanted]
        for u, raw, (a, b) in zip(wanted, raws, self.encoded(raws), strict=True):
            self.lately[u] = self.aligned(raw, a, b)

    def rows(self, texts: list[str | None]) -> list[list[Unit] | None]:
        """The units' alignments of each text; None for texts without tokens."""
        cut = [self.units(t) if t else [] for t in texts]
        all_ = set().union(*cut)
        new = all_.difference(self.lately)
        if new and self.lately and len(self.lately) + len(new) > CACHE:
            self.before, self.lately = self.lately, {}
            new = all_
        self.learn(new)
        known, out = self.lately, []
        for units in cut:
            found = list(map(known.__getitem__, units)) if units else [None]
            out.append(None if None in found else found)
        for u in new:
            if len(u) > CACHE_CHARS:
                del known[u]
        return out


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner_of(path_a: str, path_b: str) -> Aligner:
    """A Python worker keeps its aligners, and what they know, from task to task."""
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def planes(x: np.ndarray) -> bytes:
    """32-bit integers as byte planes, of which the high ones compress well."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def joined(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def packed(codes: np.ndarray) -> bytes:
    """Ascending 32-bit integers by their differences."""
    return planes(np.diff(codes, prepend=np.uint32(0)))


def unpacked(raw: bytes) -> np.ndarray:
    return np.cumsum(joined(raw), dtype=np.uint32)


def alignments(documents: DataFrame, path_a: str, path_b: str, block_links: int = BLOCK_LINKS) -> DataFrame:
    """block, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (packed distinct codes, A id times B's ids plus B id) and times (how often each is linked)."""
    bounded_batches(documents.sparkSession)
    names = ["block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    kinds = [pa.int64(), pa.int64(), *[pa.int64()] * 4, pa.string(), pa.binary(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner_of(path_a, path_b)
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                ids, texts = (batch.column(i).slice(lo, 200).to_pylist() for i in (0, 1))
                out = []
                for doc_id, units in zip(ids, own.rows(texts), strict=True):
                    if units is None:
                        out.append((block, doc_id, 0, 0, 0, 0, "", b"", b""))
                        continue
                    n_a, n_b, n_groups, n_links, groups, links = zip(*units, strict=True)
                    codes, times = np.unique(np.frombuffer(b"".join(links), np.uint32), return_counts=True)
                    digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
                    out.append((block, doc_id, sum(n_a), sum(n_b), sum(n_groups), sum(n_links), digest, packed(codes), planes(times)))
                    held += len(codes)
                    if held >= block_links:
                        block, held = block + 1, 0
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(spared(run), "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary")


def block_pairs(rows: DataFrame) -> DataFrame:
    """block, code and n: how many of the block's rows hold the pair linked (rows: block, pairs; rows of a block mostly stand together)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, now = 0, None

        def sent(block: int) -> pa.RecordBatch:
            codes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), block, np.int64)), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["block", "code", "n"])

        for batch in batches:
            for block, pairs in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if held and (block != now or size >= 2 * BLOCK_LINKS):
                    yield sent(now)
                    held, size = [], 0
                now = block
                codes = unpacked(pairs.as_py())
                if len(codes):
                    held.append(codes)
                    size += len(codes)
        if held:
            yield sent(now)

    return rows.select("block", "pairs").mapInArrow(spared(run), "block long, code long, n long")


def scored(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows with n_best and count_sum, from found (block, code, count, best) of all pairs that a block holds."""

    def run(key: tuple[pa.Scalar, ...], parts: Iterator[pa.RecordBatch], known: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = [(b.column("code").to_numpy(), b.column("count").to_numpy(), b.column("best").to_numpy(zero_copy_only=False)) for b in known]
        codes, counts, bests = (np.concatenate(x) for x in zip(*there, strict=True)) if there else (np.zeros(0, np.int64),) * 3
        order = np.argsort(codes, kind="stable")
        codes, counts, bests = codes[order], counts[order], bests[order]
        for batch in parts:
            best, total = [], []
            for pairs, times in zip(batch.column("pairs"), batch.column("times"), strict=True):
                own = unpacked(pairs.as_py()).astype(np.int64)
                n = joined(times.as_py()).astype(np.int64)
                at = np.searchsorted(codes, own)
                best.append(int(n[bests[at].astype(bool)].sum()))
                total.append(int((n * counts[at]).sum()))
            names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(best, pa.int64()), pa.array(total, pa.int64()), batch.column("groups_sha256")], [*names, "n_best", "count_sum", "groups_sha256"])

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def whole(key: tuple[pa.Scalar, ...], a: pa.Table, b: pa.Table) -> pa.Table:
        with sparing():
            return _table(run(key, a.to_batches(), b.to_batches()), schema)

    return rows.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(whole, schema)


def _table(batches: Iterator[pa.RecordBatch], schema: str) -> pa.Table:
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = [pa.string() if part.endswith("string") else pa.int64() for part in schema.split(", ")]
    return pa.Table.from_batches(batches, pa.schema(list(zip(names, kinds, strict=True))))


def align(documents: DataFrame, path_a: str, path_b: str, block_links: int = BLOCK_LINKS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row."""
    rows = stored(alignments(documents, path_a, path_b, block_links), "alignments")
    held = stored(block_pairs(rows).groupBy("block", "code").agg(F.sum("n").alias("n")), "held")
    a = F.floor(F.col("code") / _pieces(path_b)).alias("a")
    counts = stored(held.groupBy("code").agg(F.sum("n").alias("count")).withColumn("a", a), "counts")
    # a row for each id of A's vocabulary at most
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    counts = counts.join(F.broadcast(most), "a").select("code", "count", (F.col("count") == F.col("most")).alias("best"))
    return scored(rows, held.select("block", "code").join(counts, "code"))


def _pieces(path_b: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
