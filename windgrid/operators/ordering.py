"""Order: global row numbers, top-k, deterministic samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def global_row_number(df: DataFrame, order: list, name: str, coarse: Column | None = None) -> DataFrame:
    """0-based row numbers over the whole table, without a window over all rows.

    coarse: a value that never falls along `order` (a date of a time); rows are numbered within it, and
    offsets of the coarse values are added, of which there is one row each.
    """
    coarse = F.to_date(F.col(order[0])) if coarse is None else coarse
    df = df.withColumn("__c", coarse)
    within = F.row_number().over(Window.partitionBy("__c").orderBy(*order)) - 1
    sizes = df.groupBy("__c").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__c", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    return df.withColumn("__r", within).join(offsets, df["__c"].eqNullSafe(offsets["__c"])).withColumn(name, F.col("__r") + F.col("__o")).drop("__c", "__r", "__o")


def top_k(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; the order must be complete for a defined result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")


def tiered_selection(df: DataFrame, keys: list[str], eligible: Column, usable: Column, count: str, confidence: str, tie: str, cap: int, fallback: int) -> DataFrame:
    """Up to `cap` rows of each group, with origin: eligible ones by count, then usable ones by confidence to fill up.

    A group with neither gets its `fallback` best by confidence.
    """
    tier = F.when(eligible, 1).when(usable, 2).otherwise(3)
    w = Window.partitionBy(*keys)
    t = df.withColumn("__t", tier).withColumn("__some", F.count_if(F.col("__t") < 3).over(w) > 0)
    order = [F.when(F.col("__some"), F.col("__t")).otherwise(0), F.when(F.col("__some") & (F.col("__t") == 1), -F.col(count)).otherwise(0), F.col(confidence).desc(), F.col(tie)]
    r = t.withColumn("__r", F.row_number().over(w.orderBy(*order)))
    origin = F.when(~F.col("__some"), "fallback").when(F.col("__t") == 1, "eligible").otherwise("backfill")
    kept = r.where(F.when(F.col("__some"), (F.col("__t") < 3) & (F.col("__r") <= cap)).otherwise(F.col("__r") <= fallback))
    return kept.withColumn("origin", origin).drop("__t", "__some", "__r")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return top_k(df, keys, order, 1)


def hash_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """n rows by an order of arithmetic hashes: the same rows on every run, engine and partitioning."""
    return df.withColumn("__h", F.pmod(key * 2654435761, F.lit(4294967296))).orderBy("__h", key).limit(n).drop("__h")


def hash_slice(key: Column, slices: int) -> Column:
    return F.pmod(F.pmod(key * 2654435761, F.lit(4294967296)).cast("long"), F.lit(slices))


def stratified(df: DataFrame, strata: list[str], order: list, n: int, quota: int) -> DataFrame:
    """Up to `quota` of each stratum first, then the rest in round-robin order, n rows in all."""
    w = Window.partitionBy(*strata).orderBy(*order)
    ranked = df.withColumn("__r", F.row_number().over(w)).withColumn("__late", F.col("__r") > quota)
    return ranked.orderBy("__late", "__r", *strata, *order).limit(n).drop("__r", "__late")


def every_kth(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """Rows at positions k-1, 2k-1, ... of each group."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w) - 1).where(F.col("__r") % k == k - 1).drop("__r")


def spread_holdout(df: DataFrame, keys: list[str], order: list, fraction: float) -> DataFrame:
    """held: max(1, ceil(n f)) rows of each group at evenly spaced positions, rounded half to even."""
    w = Window.partitionBy(*keys)
    df = df.withColumn("__i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("__n", F.count("*").over(w))
    df = df.withColumn("__h", F.least(F.col("__n"), F.greatest(F.lit(1), F.ceil(F.col("__n") * fraction))).cast("long"))
    places = F.when(F.col("__h") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.expr("transform(sequence(0L, __h - 1), i -> cast(bround(i * (__n - 1) / cast(__h - 1 as double)) as long))"))
    return df.withColumn("held", F.array_contains(places, F.col("__i").cast("long"))).drop("__i", "__n", "__h")


def chronological_split(df: DataFrame, time: str, train: float, validation: float) -> DataFrame:
    """split by distinct times in order: the first round(n train) train, the next round(n validation) validate."""
    times = df.select(time).distinct()
    n = times.count()
    numbered = global_row_number(times, [time], "__t")
    a, b = F.bround(F.lit(n * train)), F.bround(F.lit(n * train)) + F.bround(F.lit(n * validation))
    split = F.when(F.col("__t") < a, "train").when(F.col("__t") < b, "validation").otherwise("test")
    return df.join(numbered.withColumn("split", split).drop("__t"), time)
