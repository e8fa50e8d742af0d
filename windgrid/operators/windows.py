"""Window operators: neighbours, gaps and islands, caps, anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def neighbours(df: DataFrame, keys: list[str], order: list, columns: list[str]) -> DataFrame:
    """prev_ and next_ of the columns, in order within keys."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"prev_{c}": F.lag(c).over(w) for c in columns} | {f"next_{c}": F.lead(c).over(w) for c in columns})


def islands(df: DataFrame, keys: list[str], order: list, starts: Column, name: str = "leg") -> DataFrame:
    """1-based numbers of runs: a row for which `starts` is true or null begins one, as does a group's first row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    flagged = df.withColumn("__s", F.when(first | F.coalesce(starts, F.lit(True)), 1).otherwise(0))
    return flagged.withColumn(name, F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


def changed(column: str, keys: list[str], order: list) -> Column:
    """Whether the value differs from the row before; two nulls are equal."""
    return ~F.col(column).eqNullSafe(F.lag(column).over(Window.partitionBy(*keys).orderBy(*order)))


def longest_run(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    """Share of the longest run of consecutive indices among a group's distinct indices."""
    d = df.select(*keys, index).distinct()
    w = Window.partitionBy(*keys).orderBy(index)
    runs = d.withColumn("__b", F.col(index) - F.row_number().over(w)).groupBy(*keys, "__b").agg(F.count("*").alias("__n"))
    return runs.groupBy(*keys).agg((F.max("__n") / F.sum("__n")).alias("longest_share"))


def softmax(df: DataFrame, keys: list[str], cost: str, name: str, temperature: float | None = None) -> DataFrame:
    """exp((least cost - cost) / T) over the group; T is the group's standard deviation, 0.05 at least, if not given."""
    w = Window.partitionBy(*keys)
    t = F.lit(temperature) if temperature else F.greatest(F.lit(0.05), F.stddev_pop(cost).over(w))
    e = df.withColumn("__t", t).withColumn("__e", F.exp((F.min(cost).over(w) - F.col(cost)) / F.col("__t")))
    return e.withColumn(name, F.col("__e") / F.sum("__e").over(w)).drop("__t", "__e")


def weight_caps(df: DataFrame, weight: str, caps: list[tuple[list[str], float]], share: tuple[list[str], list[str], float] | None = None, each: float | None = None) -> DataFrame:
    """Scales weights so that the sum over each key set is within its cap, one cap after the other.

    each: no row weighs more than this, before all caps. share (outer, inner, r): at last no inner group has more
    than r of the outer group's total, so at most r / (1 - r) of what the others weigh; a group without others is
    left as it is. With no inner columns every row is a group.
    """
    if each is not None:
        df = df.withColumn(weight, F.least(F.col(weight), F.lit(each)))
    for keys, cap in caps:
        total = F.sum(weight).over(Window.partitionBy(*keys))
        df = df.withColumn(weight, F.col(weight) * F.when(total > cap, cap / total).otherwise(1.0))
    if share:
        outer, inner, r = share
        own = F.sum(weight).over(Window.partitionBy(*outer, *inner)) if inner else F.col(weight)
        rest = F.sum(weight).over(Window.partitionBy(*outer)) - own
        bound = rest * (r / (1 - r))
        df = df.withColumn(weight, F.col(weight) * F.when((rest > 1e-12) & (own > bound), bound / own).otherwise(1.0))
    return df


#: Speeds that no aircraft and that any may have (m/s), neighbours and close neighbours (s), and heights off and of agreeing neighbours (m).
FAST, CALM, NEAR_S, CLOSE_S, OFF_M, AGREE_M = 420.0, 340.0, 600.0, 30.0, 3000.0, 1800.0


def triple_point(dt: Column, next_dt: Column, speed: Column, next_speed: Column, skip_speed: Column, alt: Column, prev_alt: Column, next_alt: Column, fast: float = FAST, calm: float = CALM, near_s: float = NEAR_S, close_s: float = CLOSE_S) -> dict[str, Column]:
    """Rules on a point between two others, the first that holds names it: a spike in place or height, or a biased time.

    A position spike is left and reached too fast while its neighbours are in reach of each other; a biased time makes
    one side too fast though that side is close, and the other is not.
    """
    def close(a: Column) -> Column:
        return (a > 0) & (a <= near_s)

    def one_side(a: Column, b: Column, t: Column) -> Column:
        return (a > fast) & (b <= calm) & (t <= close_s)

    spike = close(dt) & close(next_dt) & (speed > fast) & (next_speed > fast) & (skip_speed <= calm)
    height = (F.abs(alt - (prev_alt + next_alt) / 2) > OFF_M) & (F.abs(prev_alt - next_alt) < AGREE_M)
    bias = one_side(speed, next_speed, dt) | one_side(next_speed, speed, next_dt)
    return {"position_spike": spike, "altitude_spike": height, "time_bias": bias}
