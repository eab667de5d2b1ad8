"""Toxicity with noisy-channel restoration.

A token that is not plain letters, or has a letter twice in a row (leetspeak, symbols,
letters drawn out, letters spaced apart), becomes a lattice of runs; Viterbi decoding
under a character language model picks the restored word.  Plain numbers stay.  Restored tokens are matched with the learned words
and stems; a text's score is the noisy-OR of the precisions of those it holds.

The words and stems are chosen from toxic rows of which no two are near copies.  A
feature is taken if its precision is high and it is in so many toxic rows that chance
would hardly put any feature there; after those, by greedy covering: again and again
the one that covers most toxic rows not yet covered, LEAST_ROWS at least.

All labelled rows teach.  Their texts stay on the executors, which count words, the runs
of characters in them and the features of the rows; the driver gets the counts of runs,
those of features that are precise enough to be chosen, and how many rows hold which of
these together.

Defined cases: null and empty texts get the base score (the share of toxic rows that
no feature covers); rows without label teach nothing; a doc_id with both labels
counts as toxic, one with several texts teaches one of them; without any toxic row every
score is 0.  Equal texts score equally; repeated rows are scored each; an empty table
gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.common import WORD_CACHE, bounded_batches, held_out, map_arrow, spared, stored, tallied
from postloom.llm.fingerprint import sketch

HELD_OUT = (4, 2)
THRESHOLD = 0.3
LEAST_ROWS, LEAST_PRECISION = 3, 0.6
SKETCH = 32  #: hashes of a text that near copies are told by
STEMS = (8, 7, 6, 5, 4)

#: What a character of leetspeak may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou", "€": "e", "(": "c"}
#: Costs, in natural logarithms, of the channel's errors.
COST_LEET, COST_REPEAT, COST_GAP = 1.0, 1.5, 0.5
ORDER = 3  #: characters of context

_EDGE = ".,;:?\"'`’“”«»()[]{}<>_-~#%&=/\\^"
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
_LETTER = re.compile(r"[^\W\d_]")
_RUN = re.compile(r"(.)\1*", re.S)
_DOUBLE = re.compile(r"([^\W\d_])\1")
_SIGN = re.compile("[" + re.escape("".join(c for c in LEET if not c.isdigit())) + "]")
# letters apart, after and before anything but a letter, a digit or an apostrophe within a word; a star is a letter or a gap
_SPACED = re.compile(r"(?<![^\W_])(?<!\w['’])(?:[^\W_]|[@$€])(?:[ .\-_]{1,2}\*(?!\*)|[ .\-_*]{1,2}(?:[^\W_]|[@$€!|+])){2,}(?![^\W_])(?!['’]\w)")
_NOISE = re.compile(r"^([^\w\s])\1{2,}|([^\w\s])\2{2,}$")


#: Counts of characters are held as integers, so many to one.
UNIT = 1024


def runs_of(word: str, n: int) -> Iterator[tuple[str, str, int]]:
    """Each character of a word of frequency n with the up to ORDER characters before it, and its weight."""
    text, weight = "^" * ORDER + word + "$", round(UNIT * (1 + math.log(n)))
    for i in range(ORDER, len(text)):
        for k in range(ORDER + 1):
            yield text[i - k : i], text[i], weight


class CharModel:
    """Character n-gram model with interpolated back-off; each word counts with the logarithm of its frequency."""

    def __init__(self, words: Counter[str], runs: Iterable[tuple[str, str, int]] = ()) -> None:
        self.counts: list[defaultdict[str, Counter[str]]] = [defaultdict(Counter) for _ in range(ORDER + 1)]
        for context, c, weight in chain((r for word, n in words.items() for r in runs_of(word, n)), runs):
            self.counts[len(context)][context][c] += weight / UNIT
        self.size = len(self.counts[0][""]) + 1
        self.totals = [{c: sum(v.values()) for c, v in level.items()} for level in self.counts]
        self.known = LogP(self)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self.known = LogP(self)

    def logp(self, context: str, c: str) -> float:
        return self.known[context + c]


class LogP(dict):
    """Logarithms of the probabilities of runs' last characters, given those before; filled on demand."""

    def __init__(self, model: CharModel) -> None:
        self.model = model

    def __missing__(self, run: str) -> float:
        context, c, model = run[:-1], run[-1], self.model
        p = 1 / model.size / 10
        for k in range(ORDER + 1):
            part = context[len(context) - k :]
            total = model.totals[k].get(part, 0)
            if total:
                kinds = len(model.counts[k][part])
                p = (model.counts[k][part].get(c, 0) + kinds * p) / (total + kinds)
        got = self[run] = math.log(p)
        return got


@lru_cache(4096)
def options(c: str, n: int) -> list[tuple[str, float]]:
    """What a run of n times c may stand for, with the channel's cost."""
    if _LETTER.match(c):
        out = [(c * n, 0.0 if n < 3 else COST_REPEAT * n)]
        if n > 1:
            out.append((c, COST_REPEAT))
        if n > 2:
            out.append((c * 2, COST_REPEAT))
        return out
    return [(x * k, COST_LEET * k) for x in LEET.get(c, "") for k in {1, min(n, 2)}] + [("", COST_GAP if c not in LEET else 2 * COST_LEET)]


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """The options of each run of a character."""
    return (options(m[1], len(m[0])) for m in _RUN.finditer(token))


def viterbi(token: str, model: CharModel) -> str:
    """The likeliest word behind the token."""
    beams, known = {"^" * ORDER: (0.0, "")}, model.known
    for some in lattice(token):
        new: dict[str, tuple[float, str]] = {}
        for context, (score, text) in beams.items():
            for piece, cost in some:
                s, ctx = score - cost, context
                for c in piece:
                    run = ctx + c
                    s += known[run]
                    ctx = run[1:]
                if ctx not in new or s > new[ctx][0]:
                    new[ctx] = (s, text + piece)
        beams = new
    return max(((s + known[ctx + "$"], t) for ctx, (s, t) in beams.items()), key=lambda x: (x[0], x[1]))[1]


def restore_token(token: str, model: CharModel, may: Callable[[str], bool] | None = None) -> str:
    """The token's restored form; a noisy one for which may is false isn't restored, and gives an empty one."""
    word = token.strip(_EDGE).rstrip(_EDGE + "!")
    if word.isalpha():
        if not _DOUBLE.search(word):
            return word
        return viterbi(word, model) if may is None or may(word) else ""
    if not _LETTER.search(word) and not _SIGN.search(word):
        return word
    word = _NOISE.sub("", word).strip(_EDGE)
    if word.isalpha() and not _DOUBLE.search(word) or not _LETTER.search(word) and not _SIGN.search(word):
        return word
    return viterbi(word, model) if may is None or may(word) else ""


def spaced(text: str) -> list[str]:
    """Words spelled with their letters apart, closed up."""
    return [re.sub(r"[ .\-_]", "", m) for m in _SPACED.findall(text)]


@dataclass
class ToxicModel:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    base: float = 0.0
    chars: CharModel = field(default_factory=lambda: CharModel(Counter()))


class Features(dict):
    """Token to the learned feature that its restored form holds, or None; filled on demand."""

    def __init__(self, model: ToxicModel) -> None:
        self.model = model
        self.heads = {s[: min(STEMS)] for s in model.stems}
        self.prefixes = {f[:n] for f in chain(model.words, model.stems) for n in range(len(f) + 1)}

    def may(self, token: str) -> bool:
        """Whether any reading of the token holds a feature; most have none, and needn't be restored."""
        words, stems, prefixes = self.model.words, self.model.stems, self.prefixes
        read = {""}
        for some in lattice(token):
            new = set()
            for text in read:
                for piece, _ in some:
                    longer = text
                    for c in piece:
                        longer += c
                        if longer in stems:
                            return True
                        if longer not in prefixes:
                            break
                    else:
                        new.add(longer)
            if not new:
                return False
            read = new
        return not read.isdisjoint(words)

    def of_word(self, word: str) -> str | None:
        if word in self.model.words:
            return word
        if word[: min(STEMS)] not in self.heads:
            return None
        return max((word[:n] + "~" for n in STEMS if word[:n] in self.model.stems), key=lambda f: (self.model.stems[f[:-1]], len(f)), default=None)

    def __missing__(self, token: str) -> str | None:
        if len(self) >= WORD_CACHE:
            self.clear()
        got = self[token] = self.of_word(restore_token(token, self.model.chars, self.may))
        return got


def hits(text: str | None, features: Features) -> list[str]:
    """Learned features in the restored text."""
    if not text:
        return []
    low = text.lower()
    found = set(map(features.__getitem__, low.split()))
    for run in spaced(low):  # a run may hold neighbouring words of one letter
        closed = viterbi(run, features.model.chars)
        found.update(w for w in features.model.words if w in closed)
        found.update(s + "~" for s in features.model.stems if s in closed)
    found.discard(None)
    return sorted(found)


def score(found: list[str], model: ToxicModel) -> float:
    if not found:
        return model.base
    miss = 1.0
    for f in found:
        miss *= 1 - (model.stems[f[:-1]] if f[-1] == "~" else model.words[f])
    return max(model.base, 1 - miss)


def lower_bound(toxic: float, clean: float) -> float:
    """Wilson's lower bound, at one standard error, of the precision."""
    n = toxic + clean
    p = toxic / n
    return (p + 0.5 / n - math.sqrt(p * (1 - p) / n + 0.25 / n / n)) / (1 + 1 / n)


def least_support(df: Counter[int], toxic: int, rows: int) -> int:
    """So many rows that, were labels dealt by chance, a tenth of a feature would be in as many toxic and no clean ones."""
    sizes, share = Counter(df.values()), toxic / max(1, rows)
    k = LEAST_ROWS
    while k < toxic and sum(m for n, m in sizes.items() if k <= n < 2 * k) * share**k > 0.1:
        k += 1
    return k


def choose(counts: dict[str, tuple[int, int]], sizes: Counter[int], toxic: list[tuple[set[str], int]], clean: list[tuple[set[str], int]]) -> tuple[dict[str, float], float]:
    """Features and their precisions, and the share of rows without any that are toxic.

    counts: toxic and clean rows of the features that may be chosen, sizes: how many features of all are in so many rows,
    toxic and clean: which of the features rows hold together, and how many rows.
    """
    value = {f: x for f, (t, c) in counts.items() if t >= LEAST_ROWS and (x := lower_bound(t, c)) >= LEAST_PRECISION}
    rows: dict[str, set[int]] = {f: set() for f in value}
    for k, (found, _) in enumerate(toxic):
        for f in found & value.keys():
            rows[f].add(k)
    size = lambda r: sum(toxic[k][1] for k in r)
    of = {1: size(range(len(toxic))), 0: sum(n for _, n in clean)}
    enough = least_support(sizes, of[1], of[1] + of[0])
    left = set(range(len(toxic)))
    chosen: dict[str, float] = {}
    # surest first; a feature must add to the surer ones that extend or shorten it
    for f in sorted((f for f in rows if counts[f][0] >= enough), key=lambda f: (-value[f], len(f), f)):
        stem = f.rstrip("~")
        if any(stem[:n] + "~" in chosen for n in range(min(STEMS), len(stem) + 1)):
            continue
        own = size(rows[f].difference(*(rows[g] for g in chosen if g.startswith(stem))))
        if own >= LEAST_ROWS and lower_bound(own, counts[f][1]) >= LEAST_PRECISION:
            chosen[f] = value[f]
            left -= rows[f]
    while rows:
        gain = {f: size(r & left) for f, r in rows.items()}
        rows = {f: rows[f] & left for f, n in gain.items() if n >= LEAST_ROWS}
        if not rows:
            break
        f = max(rows, key=lambda f: (gain[f] * value[f], f[-1] != "~", len(f), f))
        chosen[f] = value[f]
        left -= rows[f]
    silent = sum(n for found, n in clean if not found & chosen.keys())
    return chosen, size(left) / max(1, size(left) + silent)


def apart(prints: DataFrame) -> DataFrame:
    """The rows (row, print) that are near copies of earlier ones: a quarter of their sketch's hashes, and two at least, are first in one of these."""
    each = prints.select("row", F.size("print").alias("size"), F.explode(F.array_distinct("print")).alias("h"))
    first = each.groupBy("h").agg(F.min("row").alias("owner"))
    shared = each.join(first, "h").where("owner < row").groupBy("row", "owner").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    return shared.where(F.col("n") >= F.greatest(F.lit(2), F.col("size") / 4)).select("row").distinct()


def _counted(rows: DataFrame, tally: Callable[[pa.RecordBatch], Counter[tuple]], schema: str) -> DataFrame:
    """Sums of the counts that tally makes of each batch; the schema's last column is the count."""
    names = [c.split()[0] for c in schema.split(",")]
    return tallied(rows, tally, schema).groupBy(names[:-1]).agg(F.sum(names[-1]).alias(names[-1]))


def _words(batch: pa.RecordBatch) -> Counter[tuple[str]]:
    tokens: Counter[str] = Counter()
    for t in batch.column(0).to_pylist():
        tokens.update(t.lower().split())
    found: Counter[tuple[str]] = Counter()
    for x, n in tokens.items():
        if (w := x.strip(_EDGE)).isalpha() and not _TRIPLE.search(w):
            found[(w,)] += n
    return found


def _runs(batch: pa.RecordBatch) -> Counter[tuple[str, str]]:
    found: Counter[tuple[str, str]] = Counter()
    for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        for context, c, weight in runs_of(word, n):
            found[context, c] += weight
    return found


class Restored(dict):
    """Token to its restored form; filled on demand."""

    def __init__(self, model: CharModel) -> None:
        self.model = model

    def __missing__(self, token: str) -> str:
        if len(self) >= WORD_CACHE:
            self.clear()
        got = self[token] = restore_token(token, self.model)
        return got


class Stems(dict):
    """Word to itself and its stems, of these only those among names if any are given; filled on demand."""

    def __init__(self, names: frozenset[str] | None = None) -> None:
        self.names = names

    def __missing__(self, word: str) -> list[str]:
        if len(self) >= WORD_CACHE:
            self.clear()
        got = [word, *(word[:n] + "~" for n in STEMS if len(word) > n)] if word else []
        got = self[word] = got if self.names is None else [f for f in got if f in self.names]
        return got


def fit(sample: DataFrame) -> ToxicModel:
    """Learns from all rows of toxic and text, none of them null."""
    one = sample.groupBy(F.xxhash64("text").alias("row")).agg(F.max(F.expr("if(toxic = 1, 1, 0)")).alias("toxic"), F.first("text").alias("text"))
    return _fit(stored(one, "taught"))


def _fit(rows: DataFrame) -> ToxicModel:
    """Learns from rows (row, toxic, text) of different texts."""
    spark = rows.sparkSession

    def sketches(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [sketch(t, SKETCH) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], ["row", "print"])

    prints = stored(map_arrow(rows.where("toxic = 1").select("row", "text"), sketches, "row long, print array<long>"), "prints")
    if prints.isEmpty():
        return ToxicModel()
    words = stored(_counted(rows.select("text"), _words, "word string, n long"), "words")
    common = words.where("n > 1")
    runs = _counted(words if common.isEmpty() else common, _runs, "context string, c string, weight long").collect()
    chars = CharModel(Counter(), sorted((r["context"], r["c"], r["weight"]) for r in runs))
    shared = spark.sparkContext.broadcast(chars)
    made: list[Restored] = []

    def restored(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Restored(shared.value))
        found = [" ".join(set(map(made[0].__getitem__, set(t.lower().split())))) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string())], ["row", "toxic", "words"])

    each = stored(map_arrow(rows.select("row", "toxic", "text"), restored, "row long, toxic int, words string"), "restored")
    # of toxic rows no two are near copies
    each = each.where("toxic = 0").unionByName(each.where("toxic = 1").join(apart(prints), "row", "left_anti")).select("toxic", "words")

    stems = Stems()

    def features(batch: pa.RecordBatch) -> Counter[tuple[str, int]]:
        found: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
        for toxic, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found[toxic].update(set(chain.from_iterable(map(stems.__getitem__, held.split()))))
        return Counter({(f, toxic): n for toxic, by in found.items() for f, n in by.items()})

    by_label = _counted(each, features, "feature string, toxic long, n long")
    counts = stored(by_label.groupBy("feature").agg(*[F.coalesce(F.sum(F.when(F.col("toxic") == k, F.col("n"))), F.lit(0)).alias(c) for k, c in ((1, "t"), (0, "c"))]), "features")
    sizes = Counter({r["size"]: r["count"] for r in counts.groupBy((F.col("t") + F.col("c")).alias("size")).count().collect()})
    # the lower bound of a precision above a half is below it
    sure = counts.where((F.col("t") >= LEAST_ROWS) & (F.col("t") >= LEAST_PRECISION * (F.col("t") + F.col("c"))))
    known = {r["feature"]: (r["t"], r["c"]) for r in sure.collect()}
    names = spark.sparkContext.broadcast(frozenset(known))

    precise: list[Stems] = []

    def together(batch: pa.RecordBatch) -> Counter[tuple[str, int]]:
        if not precise:
            precise.append(Stems(names.value))
        return Counter((" ".join(sorted(set(chain.from_iterable(map(precise[0].__getitem__, held.split()))))), toxic) for toxic, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))

    held = _counted(each, together, "found string, toxic long, n long").collect()
    by = {k: sorted(((set(r["found"].split(" ")) - {""}, r["n"]) for r in held if r["toxic"] == k), key=lambda x: sorted(x[0])) for k in (1, 0)}
    chosen, base = choose(known, sizes, by[1], by[0])
    return ToxicModel({f: p for f, p in chosen.items() if f[-1] != "~"}, {f[:-1]: p for f, p in chosen.items() if f[-1] == "~"}, base, chars)


def train(documents: DataFrame, labels: DataFrame) -> ToxicModel:
    """Fits on all labelled rows that are not held out: one whole text of each doc_id, equal texts once.

    Hashes tell which rows teach before any text is moved.
    """
    known = (
        labels.select("doc_id", "toxic")
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id", *HELD_OUT))
        .groupBy("doc_id")
        .agg(F.max(F.expr("if(toxic = 1, 1, 0)")).alias("toxic"))
    )
    if known.where("toxic = 1").isEmpty():
        return ToxicModel()
    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull() & ~held_out("doc_id", *HELD_OUT)).withColumn("row", F.xxhash64("text"))
    one = texts.select("doc_id", "row").join(known, "doc_id").groupBy("doc_id").agg(F.min("row").alias("row"), F.max("toxic").alias("toxic"))
    taught = one.groupBy("row").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    rows = texts.join(taught, ["doc_id", "row"]).groupBy("doc_id", "row").agg(F.first("toxic").alias("toxic"), F.first("text").alias("text"))
    return _fit(stored(rows.select("row", "toxic", "text"), "taught"))


def predict(documents: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, held_out, score, predicted and the features found, for every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    made: list[Features] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(Features(shared.value))
        found = [hits(t, made[0]) for t in batch.column(1).to_pylist()]
        scores = np.array([score(f, shared.value) for f in found])
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(found, pa.list_(pa.string()))], ["doc_id", "held_out", "score", "predicted", "hits"])

    rows = documents.select("doc_id", "text", held_out("doc_id", *HELD_OUT).alias("held_out"))
    return map_arrow(rows, run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int, hits array<string>")


def keep_clean(documents: DataFrame, model: ToxicModel, threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, that score below the threshold."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([score(hits(t, features), shared.value) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    bounded_batches(documents.sparkSession)
    return documents.mapInArrow(spared(run), documents.schema)
