"""Exact order statistics of groups of any size, by counts; no group is ever gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts that a group's distinct values are cut into at a time, and how many times.  Another round costs about as much as the first, and leaves a part 1,024 times smaller.
PARTS, ROUNDS = 1024, 1


def _place(cuts: Column, v: Column) -> Column:
    """How many of the ascending cuts are below v, by binary search."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(PARTS.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(cuts, at + step - 1) < v, step).otherwise(F.lit(0)))


def _before(rows: DataFrame, *cols: str) -> DataFrame:
    """rows with `before`: what n adds up to in the rows of cols[:-1] that come before by cols[-1]."""
    order = Window.partitionBy(*cols[:-1]).orderBy(cols[-1]).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))


def elements(rows: DataFrame, key: str, value: str, qs: list[float], places: dict[str, Callable[[Column], Column]], rounds: int = ROUNDS) -> DataFrame:
    """key, q, at, and in `value` the element at places[at]((n - 1) q) of the key's sorted values, nulls left out.

    Equal values are counted before anything is ordered.  A mergeable sketch of the distinct values gives cuts, so that parts are even however the
    values lie; counts by part tell which hold the elements, and these alone are cut again, `rounds` times in all: what is ordered
    in one place at last is a PARTS ** rounds-th of the key's distinct values.
    """
    v = F.col(value).cast("double")
    counts = rows.where(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(key, v.alias("v")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(key).agg(F.sum("n").alias("total"))
    wants = F.array(*[F.struct(F.lit(q).alias("q"), F.lit(name).alias("at"), place((F.col("total") - 1) * q).cast("long").alias("want")) for q in qs for name, place in places.items()])
    wanted = totals.select(key, F.lit(0).cast("long").alias("part"), F.inline(wants))
    inside = counts.select(key, F.lit(0).cast("long").alias("part"), "v", "n")
    for _ in range(rounds):
        cuts = inside.groupBy(key, "part").agg(F.percentile_approx("v", [i / PARTS for i in range(1, PARTS)], 10_000).alias("cuts"))
        parted = inside.join(cuts, [key, "part"]).select(key, "part", (F.col("part") * PARTS + _place(F.col("cuts"), F.col("v"))).alias("sub"), "v", "n")
        sizes = _before(parted.groupBy(key, "part", "sub").agg(F.sum("n").alias("n")), key, "part", "sub")
        hits = sizes.join(wanted, [key, "part"]).where((F.col("before") <= F.col("want")) & (F.col("want") < F.col("before") + F.col("n")))
        # a row for each key and place wanted
        wanted = hits.select(key, F.col("sub").alias("part"), "q", "at", (F.col("want") - F.col("before")).alias("want"))
        held = wanted.select(key, F.col("part").alias("sub")).distinct()
        inside = parted.join(held, [key, "sub"], "left_semi").select(key, F.col("sub").alias("part"), "v", "n")
    ordered = _before(inside, key, "part", "v").join(wanted, [key, "part"])
    return ordered.where((F.col("before") <= F.col("want")) & (F.col("want") < F.col("before") + F.col("n"))).select(key, "q", "at", F.col("v").alias("value"))


def floor_quantiles(rows: DataFrame, key: str, value: str, qs: list[float]) -> DataFrame:
    """key, q, value: the elements at floor((n - 1) q)."""
    return elements(rows, key, value, qs, {"floor": F.floor}).drop("at")


def interpolated(rows: DataFrame, value: str, qs: dict[str, float]) -> DataFrame:
    """One row with a column for each quantile of all rows, on the line between the elements beside (n - 1) q; null without values.

    No buffer holds the distinct values, however many there are.
    """
    keyed = rows.select(F.lit(0).alias("all"), value)
    found = elements(keyed, "all", value, list(set(qs.values())), {"lo": F.floor, "hi": F.ceil})
    beside = lambda q, at: F.max(F.when((F.col("q") == q) & (F.col("at") == at), F.col("value")))
    sides = found.agg(*[beside(q, at).alias(f"{name}_{at}") for name, q in qs.items() for at in ("lo", "hi")])
    both = sides.crossJoin(keyed.agg(F.count(value).alias("n")))  # one row each
    part = {name: q * (F.col("n") - 1) - F.floor(q * (F.col("n") - 1)) for name, q in qs.items()}
    return both.select(*[(F.col(f"{name}_lo") + (F.col(f"{name}_hi") - F.col(f"{name}_lo")) * part[name]).alias(name) for name in qs])


def floor_quantile_columns(rows: DataFrame, key: str, value: str, qs: dict[str, float]) -> DataFrame:
    """key and a column for each quantile."""
    found = floor_quantiles(rows, key, value, list(qs.values()))
    return found.groupBy(key).agg(*[F.max(F.when(F.col("q") == q, F.col("value"))).alias(name) for name, q in qs.items()])
