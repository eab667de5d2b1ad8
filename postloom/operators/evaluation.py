"""How well features of the text tell posts of high importance: precision and recall, in one pass each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import AMOUNT_UNIT, TIME_UNIT, collapse, has_ticker, number_tokens


#: Keywords whose precision is measured, as signs of high and of low importance.
HIGH_WORDS = [
    "sec", "cftc", "fomc", "cpi", "pce", "etf", "blackrock", "grayscale", "监管", "合规", "加息", "降息", "利率", "稳定币", "hack", "exploit", "漏洞", "攻击", "被盗", "暂停", "修复",
    "融资", "funding", "round", "series", "估值", "并购", "acquisition", "回购", "buyback", "解锁", "unlock", "销毁", "burn", "主网", "mainnet", "升级", "hard fork", "testnet",
]
LOW_WORDS = ["涨", "跌", "突破", "新高", "24h", "24小时", "上币", "上线", "交易对", "listing", "airdrop", "空投", "快照", "snapshot", "喊单", "爆仓"]


def prepared(posts: DataFrame, high: int = 4) -> DataFrame:
    """Adds t (collapsed text), low (in lower case), len, nums, ratio (of digits) and high; a null text counts as empty."""
    t = F.coalesce(collapse(F.col("text")), F.lit(""))
    out = posts.withColumn("t", t).withColumns({"low": F.lower("t"), "len": F.length("t"), "nums": number_tokens(F.col("t")), "digits": F.length("t") - F.length(F.translate("t", "0123456789", ""))})
    return out.withColumns({"ratio": F.coalesce(F.try_divide("digits", "len"), F.lit(0.0)), "high": F.coalesce(F.col("importance") >= high, F.lit(False))})


def _any(words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains("low", F.lit(w)) for w in words])


def features() -> dict[str, Column]:
    """The features' names and edges."""
    n, nums, ratio, t = F.col("len"), F.col("nums"), F.col("ratio"), F.col("t")
    out = {f"len>={k}": n >= k for k in (40, 80, 120)} | {f"numberTokens>={k}": nums >= k for k in (1, 2)} | {f"digitRatio>={k}%": ratio >= k / 100 for k in (1, 3, 6)}
    return out | {
        "hasAmountUnit": t.rlike(AMOUNT_UNIT),
        "hasTimeUnit": t.rlike(TIME_UNIT),
        "hasAddress": t.rlike("0x[a-fA-F0-9]{40,64}"),
        "hasUrl": t.rlike(r"(?i)https?://|www\."),
        "hasTicker": has_ticker(t),
        "hasHighSignalKeyword": _any(HIGH_WORDS),
        "hasLowSignalKeyword": _any(LOW_WORDS),
    }


def buckets() -> dict[str, Column]:
    def parts(x: Column, edges: list[float], labels: list[str]) -> dict[str, Column]:
        lows, tops = [None, *edges], [*edges, None]
        return {name: (F.lit(True) if lo is None else x >= lo) & (F.lit(True) if hi is None else x < hi) for name, lo, hi in zip(labels, lows, tops, strict=True)}

    return (
        parts(F.col("len"), [40, 80, 120, 160], ["<40", "40-79", "80-119", "120-159", ">=160"])
        | parts(F.col("ratio"), [0.01, 0.03, 0.06], ["<1%", "1-3%", "3-6%", ">=6%"])
        | parts(F.col("nums"), [1, 2, 3], ["0", "1", "2", ">=3"])
    )


def _rates(total_high: Column) -> list[Column]:
    return [F.round(F.col("high") / F.greatest(F.col("total"), F.lit(1)), 6).alias("precision"), F.round(F.col("high") / F.greatest(total_high, F.lit(1)), 6).alias("recall")]


def evaluate(rows: DataFrame, flags: dict[str, Column], name: str) -> DataFrame:
    """A row for each flag: total, high, precision, recall.  Each flag is tried once a row, and all are counted in one scan, which sends one row a task."""
    high = F.col("high")
    marked = rows.select("high", *[c.alias(f"f{i}") for i, c in enumerate(flags.values())])
    counts = F.array(*[F.struct(F.lit(k).alias(name), F.count_if(f"f{i}").alias("total"), F.count_if(F.col(f"f{i}") & high).alias("high")) for i, k in enumerate(flags)])
    found = marked.agg(counts.alias("r"), F.count_if(high).alias("all_high")).select("all_high", F.inline("r"))
    return found.select(name, "total", "high", *_rates(F.col("all_high")))


def feature_eval(posts: DataFrame) -> DataFrame:
    """Features that some post has."""
    return evaluate(prepared(posts), features(), "feature").where("total > 0")


def feature_buckets(posts: DataFrame) -> DataFrame:
    """Every bucket of length, ratio of digits and number of numbers, empty ones included."""
    return evaluate(prepared(posts), buckets(), "bucket")


def keyword_eval(posts: DataFrame, keywords: list[str], least: int = 10, top: int = 25) -> DataFrame:
    """The `top` keywords by precision, then recall, of those that `least` posts hold."""
    rows = prepared(posts).select("high", "low")
    found = evaluate(rows, {k: F.contains("low", F.lit(k.lower())) for k in keywords}, "keyword")
    return found.where(F.col("total") >= least).orderBy(F.desc("precision"), F.desc("recall"), "keyword").limit(top)


def lang_eval(posts: DataFrame) -> DataFrame:
    """Posts and precision by language; null and empty are unknown."""
    lang = F.coalesce(F.nullif("lang", F.lit("")), F.lit("unknown")).alias("lang")
    return prepared(posts).groupBy(lang).agg(F.count("*").alias("total"), F.count_if("high").alias("high")).select("lang", "total", "high", _rates(F.lit(1))[0])
