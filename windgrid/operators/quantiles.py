"""Exact quantiles of groups of any size: no group's values ever stand in one task.

A bounded sketch of each group gives PARTS splitters; values between two splitters are a part. Counts per
part say which parts hold the wanted ranks, and only those are ordered, each by itself. The splitters
decide the cost, never the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

PARTS, ACCURACY = 256, 10_000


def _parts(df: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """keys, v, __n (weight of the value), __part: one row per distinct value."""
    cells = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.sum(weight).alias("__n"))
    marks = cells.groupBy(*keys).agg(F.percentile_approx("v", [k / PARTS for k in range(1, PARTS)], ACCURACY).alias("__marks"))
    below = F.size(F.filter("__marks", lambda m: m < F.col("v")))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    rule = same[0] if same else F.lit(True)
    for s in same[1:]:
        rule = rule & s
    return cells.alias("c").join(marks.alias("m"), rule).select(*[F.col(f"c.{k}").alias(k) for k in keys], "v", "__n", below.alias("__part"))


def _placed(cells: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Per part: weight before it, its weight, the group's weight."""
    sizes = cells.groupBy(*keys, "__part").agg(F.sum("__n").alias("__size"))
    w = Window.partitionBy(*keys).orderBy("__part")  # PARTS rows a group
    before = F.coalesce(F.sum("__size").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return cells, sizes.withColumns({"__before": before, "__all": F.sum("__size").over(Window.partitionBy(*keys))})


def _join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    rule = F.col("a.__part") == F.col("b.__part")
    for k in keys:
        rule = rule & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    own = [F.col(f"a.{c}").alias(c) for c in a.columns]
    return a.alias("a").join(b.alias("b"), rule).select(*own, *[F.col(f"b.{c}").alias(c) for c in b.columns if c not in {*keys, "__part"}])


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], kind: str = "linear") -> DataFrame:
    """keys and one column per wanted quantile of the values that are not null.

    kind: "linear" between the two ranks around (n - 1) q, or "nearest" (halves away from zero). Groups without
    a value have no row.
    """
    cells, sizes = _placed(_parts(df, keys, value, F.lit(1)), keys)
    at = {n: (F.col("__all") - 1) * F.lit(float(q)) for n, q in wanted.items()}
    low = {n: F.floor(p + 1e-9) if kind == "linear" else F.round(p) for n, p in at.items()}
    high = {n: F.ceil(p - 1e-9) if kind == "linear" else F.round(p) for n, p in at.items()}
    end = F.col("__before") + F.col("__size")
    hit = F.lit(False)
    for n in wanted:
        hit = hit | ((low[n] < end) & (high[n] >= F.col("__before")))
    inside = _join(cells, sizes.where(hit), keys)
    w = Window.partitionBy(*keys, "__part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("__to", F.col("__before") + F.sum("__n").over(w)).withColumn("__from", F.col("__to") - F.col("__n"))
    pick = lambda rank: F.max(F.when((rank >= F.col("__from")) & (rank < F.col("__to")), F.col("v")))
    got = inside.groupBy(*keys).agg(F.max("__all").alias("__all"), *[pick(low[n]).alias(f"__l_{n}") for n in wanted], *[pick(high[n]).alias(f"__h_{n}") for n in wanted])
    share = {n: F.when(low[n] == high[n], 0.0).otherwise(at[n] - low[n]) for n in wanted}
    return got.select(*keys, *[(F.col(f"__l_{n}") + share[n] * (F.col(f"__h_{n}") - F.col(f"__l_{n}"))).alias(n) for n in wanted])


def weighted_median(df: DataFrame, keys: list[str], value: str, weight: str, name: str) -> DataFrame:
    """The first value, in order, at which the running weight reaches half the total."""
    cells, sizes = _placed(_parts(df, keys, value, F.col(weight)), keys)
    half = F.col("__all") / 2 - 1e-9
    # the part in which half is reached; the values before it weigh less
    inside = _join(cells, sizes.where((F.col("__before") < half) & (F.col("__before") + F.col("__size") >= half)), keys)
    w = Window.partitionBy(*keys, "__part").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    inside = inside.withColumn("__to", F.col("__before") + F.sum("__n").over(w)).where(F.col("__to") >= half)
    return inside.groupBy(*keys).agg(F.min("v").alias(name))


def with_quantiles(df: DataFrame, keys: list[str], aggregates: list[Column], value: Column, wanted: dict[str, float]) -> DataFrame:
    """One row per group with plain aggregates and exact quantiles of an expression."""
    rows = df.withColumn("__value", value)
    plain, more = rows.groupBy(*keys).agg(*aggregates), quantiles(rows, keys, "__value", wanted)
    rule = F.lit(True)
    for k in keys:
        rule = rule & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return plain.alias("a").join(more.alias("b"), rule, "left").select(*[F.col(f"a.{c}").alias(c) for c in plain.columns], *[F.col(f"b.{n}").alias(n) for n in wanted])
