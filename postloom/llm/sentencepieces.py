"""SentencePiece encoding with sampled segmentations, and decoding.

A text (white space as U+2581, one put in front) is a lattice of vocabulary pieces; a
character without a piece is spelled with byte pieces.  Forward filtering sums, for each
position, the weights of all segmentations up to it; backward sampling then draws the
pieces from the end, so a segmentation comes up in proportion to the product of its
pieces' weights.  Draws are hashes of the seed, the row key, the unit and the step, so
a row's segmentation depends on nothing else.

The vocabulary's scores are ranks of merges, not probabilities; by Zipf's law a piece of
rank r weighs (1 / (r + 2)) ** alpha.

No piece reaches over the start of a word or a new line, so the lattice falls apart into
units that are filtered once and remembered; many units are sampled at a time.

Decoding joins the pieces, reads runs of byte pieces as UTF-8, turns U+2581 into spaces
and drops the one in front.  It gives back every text: U+2581 itself is encoded as bytes.

Defined cases: null stays null (no ids, no text); an empty text has no ids; rows with a null key
are keyed by their text; equal rows are encoded alike; empty tables give no rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import map_arrow, mix, powers

ALPHA, SEED = 0.5, 20
SPACE = "▁"
#: Units whose lattices one Python worker keeps.
UNITS = 200_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Vocabulary:
    pieces: list[str]  #: by id; a byte piece as one character of U+DC00..U+DCFF, others without text are empty
    weights: dict[str, tuple[int, float]]  #: id and weight of each ordinary piece
    bytes_: list[int]  #: ids of the byte pieces
    longest: int
    unit: re.Pattern[str]
    byte_weight: float


def vocabulary(path: str, alpha: float = ALPHA) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    pieces, weights, bytes_ = [""] * size, {}, [0] * 256
    for i in range(size):
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            b = int(piece[3:5], 16)
            bytes_[b], pieces[i] = i, chr(0xDC00 + b)
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            pieces[i] = piece
            if "\n" in piece[:-1] or "\n" in piece[1:] or re.search(f"[^{SPACE}]{SPACE}", piece):
                continue  # would reach over a unit's end
            weights[piece] = (i, (1 / (max(0.0, -sp.get_score(i)) + 2)) ** alpha)
    return Vocabulary(pieces, weights, bytes_, max(map(len, weights), default=1), re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+"), (1 / (size + 2)) ** alpha)


#: A space of the text is SPACE; U+2581 of the text is this code point, which no text from a table holds.
SPACE_IN_TEXT = "\ud800"
#: Characters whose lattices are filtered at a time.
CHARS = 100_000


def _utf8(c: str) -> bytes:
    return (SPACE if c == SPACE_IN_TEXT else c).encode("utf-8", "surrogatepass")


class Lattices:
    """Forward filtering of many units at once."""

    def __init__(self, vocab: Vocabulary) -> None:
        self.vocab = vocab
        items = sorted(vocab.weights.items())
        hashes = np.array([self._one(p) for p, _ in items], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.ids = np.array([i for _, (i, _) in items], np.int64)[order]
        self.weights = np.array([w for _, (_, w) in items])[order]
        self.there = np.zeros(1 << 20, bool)  # by the top bits of a hash: whether a piece may have it
        self.there[(self.hashes >> np.uint64(44)).astype(np.int64)] = True
        self.spelled: dict[str, int] = {}

    @staticmethod
    def _prefix(points: np.ndarray) -> np.ndarray:
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(len(points) + 1)[0][: len(points)], out=total[1:])
        return total

    def _one(self, piece: str) -> int:
        points = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        return int(mix(self._prefix(points)[-1:] + np.uint64(len(points)))[0])

    def forward(self, units: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows are the units' positions from 0, unit by unit.  For each edge, by the row where it ends and from the longest: that row, its share of the row's weight, its length, and its id, or below 0 the character that it spells."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        n, most = len(points), self.vocab.longest
        starts = np.cumsum(sizes) - sizes
        unit = np.repeat(np.arange(len(units)), sizes)
        pos = np.arange(n) - starts[unit] + 1
        total, inverse = self._prefix(points), powers(n + 1)[1]
        found = []  # last character, length, weight, id
        at = np.arange(n)
        for size in range(1, most + 1):
            at = at[pos[at] >= size]
            if not len(at):
                break
            h = mix((total[at + 1] - total[at + 1 - size]) * inverse[at + 1 - size] + np.uint64(size))
            maybe = self.there[(h >> np.uint64(44)).astype(np.int64)]
            here, h = at[maybe], h[maybe]
            k = np.searchsorted(self.hashes, h)
            k[k == len(self.hashes)] = 0
            hit = self.hashes[k] == h
            here, k = here[hit], k[hit]
            found.append((here, np.full(len(here), size), self.weights[k], self.ids[k]))
            if size == 1:
                bare = np.ones(n, bool)
                bare[here] = False
                for i in np.flatnonzero(bare):
                    c = chr(points[i])
                    found.append(([i], [1], [self.vocab.byte_weight ** len(_utf8(c))], [-1 - self.spelled.setdefault(c, len(self.spelled))]))
        last, size, share, code = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(last * (most + 1) - size, kind="stable")  # by size they are sorted already
        last, size, share, code = last[order], size[order], share[order], code[order]
        row = last + unit[last] + 1
        weight = np.zeros(n + len(units))
        weight[starts + np.arange(len(units))] = 1.0
        # all units' first positions, then all second ones, and so on
        spot = pos[last].astype(np.int16 if sizes.max(initial=0) < 1 << 15 else np.int64)  # small integers are sorted in one pass
        step = np.argsort(spot, kind="stable")
        cuts = np.searchsorted(spot[step], np.arange(1, sizes.max(initial=0) + 2))
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            e = step[lo:hi]
            part = share[e] * weight[row[e] - size[e]]
            first = np.flatnonzero(np.diff(row[e], prepend=-1))
            here = np.add.reduceat(part, first)
            share[e] = part / np.repeat(here, np.diff(first, append=len(e)))
            rows = row[e[first]]
            weight[rows] = here
            low = np.flatnonzero(here < 1e-200)  # only ratios matter: scale what later positions still reach
            for r, p in zip(rows[low].tolist(), pos[last[e[first[low]]]].tolist(), strict=True):
                weight[max(r - p, r - most) : r + 1] *= 1e200
        return row, share, size, code


def _appended(held: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """held with `more` after its first `used` values; room doubles where it runs out, so what is known is rarely copied."""
    if used + len(more) > len(held):
        held, old = np.zeros(max(2 * len(held), used + len(more)), held.dtype), held
        held[:used] = old[:used]
    held[used : used + len(more)] = more
    return held


class Encoder:
    """Samples segmentations of many texts at once."""

    def __init__(self, vocab: Vocabulary, seed: int = SEED) -> None:
        self.vocab, self.seed, self.lattices = vocab, seed, Lattices(vocab)
        self.reset()

    def reset(self) -> None:
        self.end: dict[str, int] = {}  #: row of a unit's last position
        self.rows = self.edges = 0
        #: by row: whether a unit begins there, and its first edge; by edge: cumulated share, row where it begins, id (below 0: the character spelled)
        self.known = np.zeros(0, bool), np.zeros(0, np.int32), np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def add(self, units: list[str]) -> None:
        some, chars = [], 0
        for i, unit in enumerate(units):
            some.append(unit)
            chars += len(unit)
            if chars < CHARS and i + 1 < len(units):
                continue
            row, share, size, code = self.lattices.forward(some)
            sizes = np.fromiter(map(len, some), np.int64, len(some)) + 1
            begins = np.zeros(int(sizes.sum()), bool)
            begins[np.cumsum(sizes) - sizes] = True
            start = np.flatnonzero(np.diff(row, prepend=-1))
            first = np.zeros(len(begins), np.int64)
            first[row[start]] = start + self.edges
            # each row on its own: no sum depends on the units that came along
            upto, edges, k = share.copy(), np.diff(start, append=len(row)), 1
            more = np.flatnonzero(edges > 1)
            while len(more):
                at = start[more] + k
                upto[at] += upto[at - 1]
                k += 1
                more = more[edges[more] > k]
            upto[np.append(start[1:], len(row)) - 1] = 2.0  # no draw goes beyond a row's last edge
            made = begins, first.astype(np.int32), upto, (self.rows + row - size).astype(np.int32), code.astype(np.int32)
            self.known = tuple(_appended(a, self.rows if k < 2 else self.edges, x) for k, (a, x) in enumerate(zip(self.known, made, strict=True)))
            self.edges += len(row)
            self.end.update(zip(some, (self.rows + np.cumsum(sizes) - 1).tolist(), strict=True))
            self.rows += len(begins)
            some, chars = [], 0

    def units(self, text: str) -> list[str]:
        if not text:
            return []
        return self.vocab.unit.findall(SPACE + text.replace(SPACE, SPACE_IN_TEXT).replace(" ", SPACE))

    def encode(self, texts: list[str], keys: np.ndarray) -> list[np.ndarray]:
        units = [self.units(t) for t in texts]
        new = {u for us in units for u in us if u not in self.end}
        if new and self.end and len(self.end) + len(new) > UNITS:
            self.reset()
            new = {u for us in units for u in us}
        if new:
            self.add(sorted(new))
        begins, first, upto, to, code = self.known
        counts = np.array([len(us) for us in units])
        flat = [u for us in units for u in us]
        at = np.fromiter(map(self.end.__getitem__, flat), np.int32, len(flat))
        nth = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        draw = mix(np.repeat(mix(keys.astype(np.int64).view(np.uint64) + np.uint64(self.seed)), counts) + nth.astype(np.uint64) * _GOLD)
        live = np.arange(len(flat))
        owners, codes, steps = [], [], np.zeros(len(flat), np.int64)
        while len(live):
            u = (mix(draw[live] + np.uint64(len(owners) + 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            e = first[at]
            beyond = np.flatnonzero(upto[e] <= u)
            while len(beyond):
                e[beyond] += 1
                beyond = beyond[upto[e[beyond]] <= u[beyond]]
            owners.append(live)
            codes.append(code[e])
            steps[live] += 1
            at = to[e]
            more = ~begins[at]
            at, live = at[more], live[more]
        ends = np.cumsum(steps)
        out = np.zeros(ends[-1] if len(ends) else 0, np.int64)
        for k, (own, c) in enumerate(zip(owners, codes, strict=True)):
            out[ends[own] - 1 - k] = c
        spots = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        if (out < 0).any():
            spell = [np.array([self.vocab.bytes_[b] for b in _utf8(c)]) for c in self.lattices.spelled]
            width = np.ones(len(out), np.int64)
            odd = np.flatnonzero(out < 0)
            lens = np.array([len(s) for s in spell])
            width[odd] = lens[-1 - out[odd]]
            start = np.concatenate([[0], np.cumsum(width)])
            wide = np.repeat(out, width)
            for k in np.unique(out[odd]):
                s = spell[-1 - k]
                places = start[:-1][out == k]
                for d, b in enumerate(s):
                    wide[places + d] = b
            out, spots = wide, start[spots]
        return [out[a:b].astype(np.int32) for a, b in zip(spots[:-1], spots[1:], strict=True)]


_BYTES = re.compile("[\udc00-\udcff]+")


def decode(ids: np.ndarray | list[int] | None, vocab: Vocabulary) -> str | None:
    if ids is None:
        return None
    text = "".join(map(vocab.pieces.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).replace(SPACE, " ")
    if _BYTES.search(text):
        text = _BYTES.sub(lambda m: bytes(ord(c) - 0xDC00 for c in m[0]).decode("utf-8", "replace"), text)
    return text[1:] if text[:1] == " " else text


def row_keys(keys: list[int | None], texts: list[str | None]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest((t or "").encode("utf-8", "surrogatepass")) >> 1 if k is None else k for k, t in zip(keys, texts, strict=True)], np.int64)


#: Texts that are sampled at a time.
TEXTS = 400


def _chunks(batch: pa.RecordBatch, encoder: Encoder):
    for lo in range(0, batch.num_rows, TEXTS):
        keys, texts = (batch.column(i).slice(lo, TEXTS).to_pylist() for i in (0, 1))
        yield from zip(texts, encoder.encode([t or "" for t in texts], row_keys(keys, texts)), strict=True)


#: A Python worker keeps its encoder, and the units that it knows, from task to task.
_ENCODERS: dict[tuple, Encoder] = {}


def _per_worker(vocab, path: str, alpha: float, seed: int):
    def get() -> Encoder:
        key = (path, alpha, seed)
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = Encoder(vocab.value, seed)
        return _ENCODERS[key]

    return get


def encode(documents: DataFrame, path: str, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id and ids, an array of piece ids, of each row's text."""
    get = _per_worker(documents.sparkSession.sparkContext.broadcast(vocabulary(path, alpha)), path, alpha, seed)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = [None if t is None else x for t, x in _chunks(batch, get())]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_arrow(documents.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids array<int>")


def decoded(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows of ids."""
    vocab = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x, vocab.value) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select(F.col("doc_id").cast("long"), "ids"), run, "doc_id long, text string")


def digests(documents: DataFrame, path: str, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256 of the text decoded from them, lossless."""
    import hashlib

    get = _per_worker(documents.sparkSession.sparkContext.broadcast(vocabulary(path, alpha)), path, alpha, seed)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, ids in _chunks(batch, get()):
            if text is None:
                rows.append((None,) * 4)
                continue
            back = decode(ids, get().vocab)
            rows.append((len(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text))
        cols = zip(*rows, strict=True)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "lossless"])

    return map_arrow(documents.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, lossless boolean")
