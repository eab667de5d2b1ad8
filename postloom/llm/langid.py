"""Language identification by cross-parsing entropy.

All labelled rows teach: their words are counted by language on the executors, and a
suffix automaton is built over each language's most frequent words.  A text is cut
greedily into the longest phrases that occur in these; phrases * log2(length of the words)
/ length estimates the cross entropy in bits a character, and the language with the fewest
bits wins.  How many bits texts of a language need is the median over all its labelled
texts, each parsed by the words of the half of the rows that it isn't in.

Every labelled language is learned, and every letter of its words is a symbol of its
own, whatever its script.  The transitions of all automata lie in one table: a state's
row is displaced so that no two transitions meet, and each place names the state that it
belongs to, so a step is one look-up.  Texts are parsed in blocks of BLOCK characters
(each starts a phrase), many blocks and all languages at once.

Letters are the Unicode categories L*; marks (M*) are symbols as well, but a text of marks
alone has no letter.

Defined cases: null text or text without a letter -> `und`, score 0; nothing learned
-> `und`, score 0; equal entropies -> the language that sorts first; equal rows give equal results;
a null doc_id is never held out and never learned from.  Empty tables give no rows.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postloom.llm.common import bounded_batches, held_out, map_arrow, spared, stored

#: Size of a language's automaton: the words that its labelled rows hold most often, about so many characters of them.
CHARS_PER_LANG = 60_000
#: Longer runs of letters (scripts without spaces, junk) are counted in pieces of so many.
LONGEST_WORD, PIECE = 24, 8
BLOCK = 1024
#: A worker gives its counts on once it holds so many words, whatever the batches; it makes so many rows' strings at a time.
MOST_WORDS, ROWS = 200_000, 250
SPACE, OTHER = 0, 1
HELD_OUT = (5, 0)


@lru_cache
def symbols() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a symbol (L*, M*), and whether a letter (L*)."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    letter = np.array([k == "L" for k in kinds])
    return letter | np.array([k == "M" for k in kinds]), letter


def code_points(text: str) -> np.ndarray:
    """The lower-cased text with each run of other characters than symbols as one 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(symbols()[0][points], points, 0)
    if len(points) > 1:
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != 0) | (points[:-1] != 0)
        points = points[keep]
    return points


def has_letter(text: str | None) -> bool:
    return bool(text) and bool(symbols()[1][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


@dataclass
class LangModel:
    langs: list[str]
    points: np.ndarray  #: symbols of the samples, ascending; the code of the kth is k + 2
    base: np.ndarray  #: by state: where its row of the table begins
    owner: np.ndarray  #: by place of the table: the state whose transition it holds
    target: np.ndarray  #: and the state that it leads to
    roots: np.ndarray  #: by language
    first: np.ndarray  #: by language and code: the state after that code at the root, or the root
    bits: np.ndarray  #: of a phrase, by language
    limits: np.ndarray = field(default_factory=lambda: np.zeros(0))  #: bits a character that texts of the language hardly need

    def encode(self, text: str) -> np.ndarray:
        points = code_points(text)
        at = np.searchsorted(self.points, points)
        at[at == len(self.points)] = 0
        known = self.points[at] == points if len(self.points) else np.zeros(len(points), bool)
        return np.where(points == 0, SPACE, np.where(known, at + 2, OTHER)).astype(self.kind)

    @property
    def kind(self) -> type:
        return np.uint16 if len(self.points) < 65_000 else np.int32


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def displaced(rows: list[dict[int, int]], codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, owner and target of the rows' transitions; row 0, the root, is left out."""
    size = 3 * sum(map(len, rows[1:])) + 2 * codes + 1
    taken = bytearray(size)
    base, owner, target = np.zeros(len(rows), np.int64), np.full(size, -1, np.int64), np.zeros(size, np.int64)
    span, at = size - codes, 0
    for s in sorted(range(1, len(rows)), key=lambda s: -len(rows[s])):
        moves = rows[s]
        if not moves:
            continue
        keys = list(moves)
        while any(taken[at + c] for c in keys):
            at = (at + 1) % span
        base[s] = at
        for c, to in moves.items():
            taken[at + c] = 1
            owner[at + c], target[at + c] = s, to
        at = (at + 7919) % span
    return base, owner, target


def build_model(samples: dict[str, list[str]]) -> LangModel:
    """The model of all of the samples' texts."""
    langs = sorted(lang for lang, texts in samples.items() if any(map(has_letter, texts)))
    refs = [np.concatenate([code_points(t + " ") for t in samples[lang]]) for lang in langs]
    points = np.unique(np.concatenate([np.zeros(0, np.uint32), *refs]))
    points = points[points > 0]
    codes = len(points) + 2
    parts: list[tuple[np.ndarray, ...]] = []
    roots, bits, first, states, places = [], [], [], 0, 0
    for ref in refs:
        code = np.where(ref == 0, SPACE, np.searchsorted(points, ref) + 2)
        nxt = suffix_automaton(code.tolist())
        base, owner, target = displaced(nxt, codes)
        parts.append((base + places, np.where(owner < 0, -1, owner + states), target + states))
        roots.append(states)
        first.append([states + nxt[0].get(c, 0) for c in range(codes)])
        bits.append(math.log2(len(ref) + 1))
        states += len(nxt)
        places += len(owner)
    base, owner, target = (np.concatenate(x).astype(np.int32) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int32),) * 3
    return LangModel(langs, points, base, owner, target, np.array(roots, np.int32), np.array(first, np.int32), np.array(bits), np.full(len(langs), np.inf))


def phrases(texts: list[str], model: LangModel, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Phrases by text and language (with own, the numbers of the texts' languages, of that language alone), and the length of each text in codes."""
    blocks, owner = [], []
    sizes = np.zeros(len(texts))
    for k, text in enumerate(texts):
        codes = model.encode(text)
        sizes[k] = len(codes)
        for i in range(0, len(codes), BLOCK):
            blocks.append(codes[i : i + BLOCK])
            owner.append(k)
    width = len(model.langs) if own is None else 1
    out = np.zeros((len(texts), width))
    lanes = max(256, 16_384 // max(1, len(model.langs)))
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    first = model.first.ravel()
    for lo in range(0, len(order), lanes):
        ids = order[lo : lo + lanes]
        langs = np.arange(width)[:, None] if own is None else own[np.array(owner)[ids]][None]
        root, row = (np.broadcast_to(x, (width, len(ids))) for x in (model.roots[langs], langs * model.first.shape[1]))
        lengths = np.array([len(blocks[i]) for i in ids])
        grid = np.zeros((lengths[0], len(ids)), model.kind)
        for j, i in enumerate(ids):
            grid[: len(blocks[i]), j] = blocks[i]
        active = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")  # blocks longer than t
        state = root.copy()
        count = np.zeros((width, len(ids)), np.int32)
        for t in range(lengths[0]):
            n = active[t]
            now, code, roots = state[:, :n], grid[t, :n], root[:, :n]
            place = model.base[now] + code
            hit = (model.owner[place] == now) & (now != roots)
            fresh = first[row[:, :n] + code]
            # a miss ends the phrase, if there is one; a character that the sample lacks is one by itself
            count[:, :n] += ~hit & (now != roots)
            count[:, :n] += ~hit & (fresh == roots)
            state[:, :n] = np.where(hit, model.target[place], fresh)
        count += state != root
        np.add.at(out, np.array(owner)[ids], count.T)
    return out, sizes


#: A text of so many symbols at least may need so many times the bits a character that most texts of its language need.
LEAST_SYMBOLS, MOST_BITS = 200, 2.0


def with_limits(model: LangModel, checks: dict[str, list[str]]) -> LangModel:
    """The model with limits, learned from other texts of each language than those of its automaton."""
    for k, lang in enumerate(model.langs):
        count, sizes = phrases([t for t in checks.get(lang, []) if has_letter(t)], model)
        if len(sizes) > 2:
            model.limits[k] = MOST_BITS * np.median(count[:, k] * model.bits[k] / sizes)
    return model


def classify(texts: list[str | None], model: LangModel) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, its share of the languages' likelihoods, and whether the text needs no more bits a character than texts of the language do."""
    langs, scores, fits = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    some = [i for i, t in enumerate(texts) if has_letter(t)] if model.langs else []
    if some:
        count, sizes = phrases([texts[i] for i in some], model)
        bits = count * model.bits
        best = np.argmin(bits, 1)
        share = np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000))
        known = (sizes < LEAST_SYMBOLS) | (bits.min(1) <= model.limits[best] * sizes)
        if len(again := np.flatnonzero(~known)):  # what repeats itself is judged by its different words
            count, sizes = phrases([" ".join(dict.fromkeys(texts[some[i]].split())) for i in again], model)
            known[again] = (sizes < LEAST_SYMBOLS) | ((count * model.bits)[np.arange(len(again)), best[again]] <= model.limits[best[again]] * sizes)
        for i, b, s, fit in zip(some, best, 1 / share.sum(1), known, strict=True):
            langs[i], scores[i], fits[i] = model.langs[b], s, fit
    return langs, scores, fits


def words(text: str) -> list[str]:
    """Runs of symbols of the lower-cased text; long ones in pieces."""
    points = code_points(text)
    points[points == 0] = 32
    found = points.tobytes().decode("utf-32-le", "surrogatepass").split(" ")
    if max(map(len, found)) > LONGEST_WORD:
        found = [x for w in found for x in ([w] if len(w) <= LONGEST_WORD else [w[i : i + PIECE] for i in range(0, len(w), PIECE)])]
    return found


def _given(found: dict[str, tuple[Counter[str], Counter[str]]]) -> Iterator[pa.RecordBatch]:
    """The counts, one language after the other; found is empty then."""
    while found:
        lang, (a, b) = found.popitem()
        held = [w for w in a.keys() | b.keys() if w]
        counts = (pa.array([c[w] for w in held], pa.int64()) for c in (a, b))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(held), pa.string()), pa.array(held, pa.string()), *counts], ["lang", "word", "a", "b"])


def _tally(batches: Iterator[pa.RecordBatch], most: int = MOST_WORDS) -> Iterator[pa.RecordBatch]:
    """By language and word: how often rows of each half hold it; a word comes again after each `most` words."""
    found: dict[str, tuple[Counter[str], Counter[str]]] = {}
    for part in (batch.slice(lo, ROWS) for batch in batches for lo in range(0, batch.num_rows, ROWS)):
        for lang, half, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
            found.setdefault(lang, (Counter(), Counter()))[half].update(words(text))
        if sum(map(len, chain.from_iterable(found.values()))) >= most:
            yield from _given(found)
    yield from _given(found)


def frequent(counts: DataFrame, chars: int) -> dict[tuple[int, str], str]:
    """By part (a half of the rows, or 2 for all) and language: the most frequent words, about `chars` characters; of equally frequent ones at the end a hash tells which.

    counts: lang, word, and how often rows of each half hold it (a, b).
    """
    each = counts.select("lang", "word", F.posexplode(F.array("a", "b", F.col("a") + F.col("b"))).alias("part", "n")).where("n > 0")
    sizes = each.groupBy("part", "lang", "n").agg(F.sum(F.length("word") + 1).alias("size"))
    # one row for each different count
    left = chars + F.col("size") - F.sum("size").over(Window.partitionBy("part", "lang").orderBy(F.desc("n")))
    rates = sizes.withColumn("left", left).where("left > 0").select("part", "lang", "n", (F.col("left") / F.col("size")).alias("rate"))
    place = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) / float(1 << 30)
    taken = each.join(F.broadcast(rates), ["part", "lang", "n"]).where(place < F.col("rate")).select("part", "lang", "n", "word").collect()
    out: dict[tuple[int, str], list[str]] = {}
    for r in sorted(taken, key=lambda r: (-r["n"], r["word"])):
        out.setdefault((r["part"], r["lang"]), []).append(r["word"])
    return {k: " ".join(found) for k, found in out.items()}


#: Bits a character are counted in steps of one of so many.
STEPS = 1024


def needed(known: DataFrame, halves: LangModel) -> dict[str, float]:
    """Median bits a character of the different texts of each language with more than two, each parsed by the other half's words; halves has a language `<half><lang>` for each.

    known: lang, half, text.
    """
    shared = known.sparkSession.sparkContext.broadcast(halves)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        model, place = shared.value, {lang: k for k, lang in enumerate(shared.value.langs)}
        some = [(lang, row, k, text) for lang, half, text, row in zip(*(c.to_pylist() for c in batch.columns), strict=True) if (k := place.get(f"{1 - half}{lang}")) is not None and has_letter(text)]
        langs, rows, own, texts = zip(*some, strict=True) if some else ((),) * 4
        own = np.array(own, np.int64)
        count, sizes = phrases(list(texts), model, own)
        bits = np.rint(STEPS * count[:, 0] * model.bits[own] / sizes).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(rows, pa.int64()), pa.array(bits)], ["lang", "row", "bits"])

    each = map_arrow(known.select("lang", "half", "text", F.xxhash64("text").alias("row")), run, "lang string, row long, bits long")
    # one row for each different number of bits
    counts = each.groupBy("lang", "row").agg(F.max("bits").alias("bits")).groupBy("lang", "bits").count().collect()
    out = {}
    for lang in {r["lang"] for r in counts}:
        bits, n = np.array(sorted((r["bits"], r["count"]) for r in counts if r["lang"] == lang)).T
        upto, total = np.cumsum(n), n.sum()
        if total > 2:
            out[lang] = bits[np.searchsorted(upto, [(total - 1) // 2, total // 2], side="right")].mean() / STEPS
    return out


def train(documents: DataFrame, chars: int = CHARS_PER_LANG) -> LangModel:
    """Fits the model on all labelled rows that are not held out: the words of the automata and the limits are counted over all of them."""
    known = documents.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", *HELD_OUT))
    known = known.select("lang", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int").alias("half"), "text")
    bounded_batches(documents.sparkSession)
    each = known.mapInArrow(spared(_tally), "lang string, word string, a long, b long")
    found = frequent(stored(each.groupBy("lang", "word").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "words"), chars)
    model = build_model({lang: [text] for (part, lang), text in found.items() if part == 2})
    halves = build_model({f"{part}{lang}": [text] for (part, lang), text in found.items() if part < 2})
    if halves.langs:
        limits = needed(known, halves)
        model.limits = np.array([MOST_BITS * limits.get(lang, np.inf) for lang in model.langs])
    return model


def predict(documents: DataFrame, model: LangModel) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, scores, _ = classify(batch.column(1).to_pylist(), shared.value)
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = documents.select("doc_id", "text", held_out("doc_id", *HELD_OUT).alias("held_out"))
    return map_arrow(rows, run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep_identified(documents: DataFrame, model: LangModel) -> DataFrame:
    """The rows, with all their columns, whose text has a letter and, if it isn't short, needs no more bits a character than its language's limit: a short text stays, whatever the languages that share it, and a long one of no learned language goes.

    Null and empty texts go; repeated rows stay or go together; an empty table gives no rows.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, _, fits = classify(batch.column(at).to_pylist(), shared.value)
            yield batch.filter(pa.array(fits))

    bounded_batches(documents.sparkSession)
    return documents.mapInArrow(spared(run), documents.schema)


__all__ = ["LangModel", "build_model", "classify", "keep_identified", "phrases", "predict", "suffix_automaton", "train"]
