"""Joins Spark has no operator for: as-of, brackets, tiers, offsets, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _timeline(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str) -> DataFrame:
    """Both sides as one table: left rows in __l, right rows in __r, in __t."""
    a = left.where(" and ".join(f"{c} is not null" for c in [*keys, time])).select(*keys, F.col(time).alias("__t"), F.struct(*left.columns).alias("__l"))
    b = right.where(" and ".join(f"{c} is not null" for c in [*keys, right_time])).select(*keys, F.col(right_time).alias("__t"), F.struct(*right.columns).alias("__r"))
    return a.unionByName(b, allowMissingColumns=True)


def asof_nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, tie: str, tolerance: float | None = None) -> DataFrame:
    """Every left row with the right row nearest in time within keys (struct `match`, null if none is near enough).

    One shuffle and two windows, whatever the sizes; no row pairs are formed. With a tolerance the windows are over
    keys and time buckets of its width, under whose neighbours right rows are listed as well; so a key with much
    of all rows is many windows. Of equal distances the earlier right row wins; of equal times the one with the
    smallest `tie`.
    """
    if tolerance:
        k = lambda c: F.floor(F.col(c) / tolerance)
        near = right.withColumn("__k", F.explode(F.array(*[k(right_time) + i for i in (-1, 0, 1)])))
        found = _nearest(left.withColumn("__k", k(time)), near, [*keys, "__k"], time, right_time, tie, tolerance)
        match = F.when(F.col("match").isNotNull(), F.struct(*[F.col(f"match.{c}").alias(c) for c in right.columns]))
        return found.select(*left.columns, match.alias("match"))
    return _nearest(left, right, keys, time, right_time, tie, tolerance)


def _nearest(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, tie: str, tolerance: float | None) -> DataFrame:
    both = _timeline(left, right, keys, time, right_time)
    w = Window.partitionBy(*keys)
    # among equal times: right rows first going forward and backward alike, so both directions see them
    back = w.orderBy("__t", F.col("__l").isNotNull(), F.col("__r")[tie].desc()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.orderBy(F.col("__t").desc(), F.col("__l").isNotNull(), F.col("__r")[tie].desc()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"__b": F.last("__r", True).over(back), "__a": F.last("__r", True).over(ahead)}).where("__l is not null")
    before, after = F.col("__t") - F.col("__b")[right_time], F.col("__a")[right_time] - F.col("__t")
    pick = F.when(F.col("__a").isNull() | (before <= after), F.col("__b")).otherwise(F.col("__a"))
    pick = F.when(F.col("__b").isNull(), F.col("__a")).otherwise(pick)
    both = both.withColumn("match", pick)
    if tolerance is not None:
        both = both.withColumn("match", F.when(F.abs(F.col("match")[right_time] - F.col("__t")) <= tolerance, F.col("match")))
    found = both.select("__l.*", "match")
    lost = left.where(" or ".join(f"{c} is null" for c in [*keys, time]))
    return found.unionByName(lost.withColumn("match", F.lit(None).cast(found.schema["match"].dataType)))


def bracket(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_time: str, value: str, width: int | None = None) -> DataFrame:
    """Latest right value at or before and earliest at or after: t0, v0, t1, v1 and alpha in [0, 1].

    width: the windows are over keys and time buckets of that width, into which the last right row before and the
    first one after are carried; what is ordered by key alone is a row per bucket.
    """
    names, left_names = list(right.columns), list(left.columns)
    if width:
        k = lambda c: F.floor(F.col(c) / width)
        left, right = left.withColumn("__k", k(time)), right.withColumn("__k", k(right_time))
        row = F.struct(*names)
        own = right.where(F.col(right_time).isNotNull()).groupBy(*keys, "__k").agg(F.min_by(row, right_time).alias("__first"), F.max_by(row, right_time).alias("__last"))
        buckets = left.select(*keys, "__k").distinct().join(own, [*keys, "__k"], "full")
        w = Window.partitionBy(*keys).orderBy("__k")
        before, after = F.last("__last", True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first("__first", True).over(w.rowsBetween(1, Window.unboundedFollowing))
        carried = buckets.withColumns({"__p": before, "__q": after}).select(*keys, "__k", F.explode(F.array_compact(F.array("__p", "__q"))).alias("__c"))
        right = right.unionByName(carried.select(*[F.col(f"__c.{c}").alias(c) for c in names], "__k"))
        keys = [*keys, "__k"]
    both = _timeline(left, right, keys, time, right_time)
    w = Window.partitionBy(*keys)
    back = w.orderBy("__t", F.col("__l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = w.orderBy(F.col("__t").desc(), F.col("__l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"__b": F.last("__r", True).over(back), "__a": F.last("__r", True).over(ahead)}).where("__l is not null")
    t0, t1 = F.col("__b")[right_time], F.col("__a")[right_time]
    alpha = F.when(t0 == t1, 0.0).otherwise((F.col("__t") - t0) / (t1 - t0))
    return both.select(*[F.col(f"__l.{c}").alias(c) for c in left_names], t0.alias("t0"), F.col("__b")[value].alias("v0"), t1.alias("t1"), F.col("__a")[value].alias("v1"), alpha.alias("alpha"))


def tiered(left: DataFrame, right: DataFrame, tiers: list[list[str]], left_key: list[str]) -> DataFrame:
    """Right rows by the first tier of key columns that finds any: tier is its number, from 1.

    One equi-join per tier; the least tier of each left row stays.
    """
    extra = [c for c in right.columns if c not in {k for t in tiers for k in t}]
    parts = [left.join(right.select(*t, *extra), t).select(*left.columns, *extra, F.lit(n).alias("tier")) for n, t in enumerate(tiers, 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("__m", F.min("tier").over(Window.partitionBy(*left_key))).where("tier = __m").drop("__m")


def interval_join(left: DataFrame, right: DataFrame, keys: list[str], at: str, low: str, high: str, width: int, residual: Column | None = None) -> DataFrame:
    """Left rows whose `at` lies in [low, high] of a right row of the same keys.

    Right intervals are listed under every bucket of `width` they touch, so the join is on equal keys and
    buckets; width should be near the usual length of an interval.
    """
    a = left.withColumn("__k", F.floor(F.col(at) / width))
    b = right.withColumn("__k", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    out = a.join(b, [*keys, "__k"]).where((F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high)))
    return (out.where(residual) if residual is not None else out).drop("__k")


def offset_join(cells: DataFrame, values: DataFrame, keys: list[str], offsets: list[tuple[int, int, int]]) -> DataFrame:
    """cells with the values at (z, y, x) + offset, as n_* columns: an equi-join over a small table of offsets."""
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx")) for a, b, c in offsets]))
    aimed = cells.withColumn("o", moves).withColumns({"__z": F.col("z") + F.col("o.dz"), "__y": F.col("y") + F.col("o.dy"), "__x": F.col("x") + F.col("o.dx")})
    named = values.select(*keys, F.col("z").alias("__z"), F.col("y").alias("__y"), F.col("x").alias("__x"), *[F.col(c).alias(f"n_{c}") for c in values.columns if c not in {*keys, "z", "y", "x"}])
    return aimed.join(named, [*keys, "__z", "__y", "__x"]).drop("__z", "__y", "__x")


def box(rz: int, ry: int, rx: int, own: bool = False) -> list[tuple[int, int, int]]:
    return [(a, b, c) for a in range(-rz, rz + 1) for b in range(-ry, ry + 1) for c in range(-rx, rx + 1) if own or (a, b, c) != (0, 0, 0)]


def successors(df: DataFrame, keys: list[str], order: list, columns: list[str], lags: int, most_gap: float, start: str, end: str) -> DataFrame:
    """Every row with its 1st to `lags`-th next in the group, where the gap from end to start is in [1, most_gap]."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = None
    for k in range(1, lags + 1):
        part = df.withColumns({f"to_{c}": F.lead(c, k).over(w) for c in columns}).withColumn("hop", F.lit(k)).withColumn("gap", F.col(f"to_{start}") - F.col(end))
        part = part.where((F.col("gap") >= 1) & (F.col("gap") <= most_gap))
        out = part if out is None else out.unionByName(part)
    return out


def merge_keys(left: DataFrame, right: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Inner merge where of rows with equal keys the last counts on either side; right columns get _b."""
    from windgrid.operators.ordering import keep_first

    b = keep_first(right, keys, order)
    b = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys])
    return keep_first(left, keys, order).join(b, keys)


def identity_seeds(batches: DataFrame, legs: DataFrame, tail: str = "tail", flight: str = "flight") -> tuple[DataFrame, DataFrame]:
    """batches and legs with `seed`, the key under which a batch's candidates stand.

    Both names if legs have them, else the tail if legs have it, else the flight; null if none has. Null names match nothing.
    """
    text = lambda c: F.col(c).cast("string")
    forms = {"i": F.concat(F.lit("i:"), text(tail), F.lit(":"), text(flight)), "t": F.concat(F.lit("t:"), text(tail)), "f": F.concat(F.lit("f:"), text(flight))}
    listed = legs.withColumn("seed", F.explode(F.array_compact(F.array(*forms.values()))))
    known = listed.select("seed").distinct()
    asked = batches
    for k, form in forms.items():
        asked = asked.withColumn(f"__{k}", form).join(known.withColumnRenamed("seed", f"__{k}").withColumn(f"__has_{k}", F.lit(True)), f"__{k}", "left")
    return asked.withColumn("seed", F.coalesce(*[F.when(F.col(f"__has_{k}"), F.col(f"__{k}")) for k in forms])).drop(*[f"__{k}" for k in forms], *[f"__has_{k}" for k in forms]), listed


#: Seconds a leg may begin after a batch's end, end before it, and end before the previous batch; kilometres and metres around.
TOLERANCE_S, PADDING_S, LOWER_S, ENVELOPE_KM, HEIGHT_M = 60, 7200, 7200, 80.0, 1500.0


def leg_candidates(batches: DataFrame, legs: DataFrame, bucket_s: int = 6 * 3600, envelope_km: float = ENVELOPE_KM, height_m: float = HEIGHT_M, tolerance_s: int = TOLERANCE_S, padding_s: int = PADDING_S, lower_s: int = LOWER_S) -> tuple[DataFrame, DataFrame]:
    """Pairs of batches and legs that can belong together, and how many pairs each rule is the first to reject.

    batches: batch, tail, flight, end_s, previous_s, n, lat, lon, low_m, high_m, phase. legs: leg_id, tail, flight, start_s,
    stop_s, and least and largest lat, lon, alt (lat_a, lat_b, ...), leg_phase. Rules in order: identity (another tail),
    time (three of them), centre distance, height, phase. Pairs that the time rejects are counted per identity, not formed.
    """
    from windgrid.functions import geo

    asked, listed = identity_seeds(batches, legs)
    there = asked.where("seed is not null").withColumnsRenamed({"tail": "b_tail", "flight": "b_flight"})
    conflict = F.col("b_tail").isNotNull() & ~F.col("b_tail").eqNullSafe(F.col("tail"))
    spans = listed.withColumns({"__low": F.col("start_s") - tolerance_s, "__high": F.col("stop_s") + padding_s})
    met = interval_join(there, spans, ["seed"], "end_s", "__low", "__high", bucket_s)
    middle = lambda c: (F.col(f"{c}_a") + F.col(f"{c}_b")) / 2
    km = geo.haversine_km(F.col("lat"), F.col("lon"), middle("lat"), middle("lon"))
    turned = F.col("phase").isin("ASC", "DES") & F.col("leg_phase").isin("ASC", "DES") & (F.col("phase") != F.col("leg_phase"))
    rules = {
        "identity_conflict": conflict, "time_failed": F.col("stop_s") < F.col("previous_s") - lower_s, "geometry_failed": km > envelope_km + F.greatest(F.lit(5.0), F.col("n") * 4.0),
        "altitude_failed": (F.col("high_m") + height_m < F.col("alt_a")) | (F.col("low_m") - height_m > F.col("alt_b")), "phase_failed": turned,
    }
    verdict = F.coalesce(*[F.when(r, F.lit(n)) for n, r in rules.items()], F.lit("candidate"))
    same_flight = F.col("b_flight").eqNullSafe(F.col("flight"))
    grade = F.when(F.col("b_tail").isNull(), "ID-D").when(same_flight, "ID-A").when(F.col("b_flight").isNull(), "ID-C").otherwise("ID-B")
    penalty = F.when(grade == "ID-A", 0.0).when(grade == "ID-B", 2.0).when(grade == "ID-C", 5.0).otherwise(8.0)
    met = met.withColumns({"verdict": verdict, "km": km, "grade": grade}).withColumn("score", F.col("km") + penalty)
    # how many pairs there are in all, and how many of those a conflict of tails rejects before the time is looked at
    legs_of = listed.groupBy("seed", "tail").agg(F.count("*").alias("l"))
    batches_of = there.groupBy("seed", "b_tail").agg(F.count("*").alias("b"))
    every = legs_of.join(batches_of, "seed").select(conflict.alias("c"), (F.col("l") * F.col("b")).alias("pairs")).groupBy().agg(F.coalesce(F.sum(F.when(F.col("c"), F.col("pairs"))), F.lit(0)).alias("conflicts"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
    inside = met.groupBy("verdict").agg(F.count("*").alias("n"))
    totals = inside.groupBy().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("met"), F.coalesce(F.sum(F.when(F.col("verdict") == "identity_conflict", F.col("n"))), F.lit(0)).alias("met_conflicts"))
    never = every.join(totals).select(F.explode(F.array(F.struct(F.lit("identity_conflict").alias("verdict"), (F.col("conflicts") - F.col("met_conflicts")).alias("n")), F.struct(F.lit("time_failed").alias("verdict"), (F.col("pairs") - F.col("met") - (F.col("conflicts") - F.col("met_conflicts"))).alias("n")))).alias("x")).select("x.*")
    none = asked.where("seed is null").groupBy().agg(F.lit("no_identity_candidate").alias("verdict"), F.count("*").alias("n"))
    counts = inside.unionByName(never).unionByName(none).groupBy("verdict").agg(F.sum("n").alias("n")).where("n > 0")
    return met.where("verdict = 'candidate'"), counts
