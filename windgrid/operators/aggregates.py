"""Aggregates Spark has no function for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windgrid.operators.quantiles import with_quantiles


def weighted_mean(x: Column, w: Column, guard: float | None = 1e-12) -> Column:
    """sum(x w) / max(sum(w), guard); without a guard null where nothing weighs."""
    total = F.sum(w)
    return F.sum(x * w) / F.greatest(total, F.lit(guard)) if guard else F.try_divide(F.sum(x * w), total)


def weighted_variance(x: Column, w: Column) -> Column:
    return F.greatest(F.lit(0.0), weighted_mean(x * x, w) - F.pow(weighted_mean(x, w), 2))


def effective_count(w: Column) -> Column:
    return F.try_divide(F.pow(F.sum(w), 2), F.sum(w * w))


def mode(x: Column) -> Column:
    """The most frequent value, the smallest of several."""
    return F.mode(x, True)


def robust_centre(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Median of fewer than 5 values, else half the median and half the mean between p10 and p90."""
    stats = df.groupBy(*keys).agg(F.count(value).alias("__n"), F.median(value).alias("__m"), F.percentile(value, 0.1).alias("__lo"), F.percentile(value, 0.9).alias("__hi"))
    inner = df.join(stats, keys).where(F.col(value).between(F.col("__lo"), F.col("__hi"))).groupBy(*keys, "__n", "__m").agg(F.avg(value).alias("__a"))
    return inner.select(*keys, F.when(F.col("__n") < 5, F.col("__m")).otherwise(0.5 * F.col("__m") + 0.5 * F.col("__a")).alias(name))


def error_metrics(eu: Column, ev: Column) -> dict[str, Column]:
    """RMSE, MAE, bias, largest and 95th percentile of vector errors; 0 where there are none."""
    e = F.hypot(eu, ev)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return {"rmse": zero(F.sqrt(F.avg(eu * eu + ev * ev))), "mae": zero(F.avg(e)), "bias_u": zero(F.avg(eu)), "bias_v": zero(F.avg(ev)), "worst": zero(F.max(e)), "p95": zero(F.percentile(e, 0.95))}


def pooled_rmse(rmse: Column, n: Column, skip_empty: bool) -> Column:
    """Weighted by hold-out counts: those without count are skipped, or weigh as one."""
    w = F.when(n > 0, n) if skip_empty else F.when(n > 0, n).otherwise(1)
    return F.sqrt(F.sum(F.when(w.isNotNull(), rmse * rmse * w)) / F.sum(w))


def calibration_error(df: DataFrame, keys: list[str], p: str, y: str, bins: int) -> DataFrame:
    """Expected calibration error over equal-width bins, of which the last is closed."""
    b = df.groupBy(*keys, F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("__b")).agg(F.count("*").alias("__n"), F.avg(p).alias("__p"), F.avg(y).alias("__y"))
    return b.groupBy(*keys).agg((F.sum(F.col("__n") * F.abs(F.col("__p") - F.col("__y"))) / F.sum("__n")).alias("ece"))


def count_map(df: DataFrame, column: str) -> DataFrame:
    """value, n: null counts as the word null."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("value")).agg(F.count("*").alias("n"))


def distinct_with_null(x: Column) -> Column:
    return F.count_distinct(x) + F.max(F.when(x.isNull(), 1).otherwise(0))


def strata(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that holds: rows may fall in several strata."""
    return df.withColumn("stratum", F.explode(F.array_compact(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()]))))


def _rounded(name: str, digits: int = 6) -> Column:
    return F.round(name, digits).alias(name)


def robust_sigmas(df: DataFrame, keys: list[str], x: str, floor: float, cap: float, least: int) -> DataFrame:
    """keys, n, sigma: half the root mean square and half the 75th percentile of |x|, within [floor, cap]; null of fewer than `least` values."""
    m = with_quantiles(df, keys, [F.count("*").alias("n"), F.sqrt(F.avg(F.col(x) * F.col(x))).alias("__rms")], F.abs(x), {"__p75": 0.75})
    sigma = F.least(F.lit(cap), F.greatest(F.lit(floor), 0.5 * F.col("__rms") + 0.5 * F.col("__p75")))
    return m.select(*keys, "n", F.when(F.col("n") >= least, sigma).alias("sigma"))


def super_observation(rows: DataFrame, keys: list[str], weight: str, means: list[str], flight: str, order: str, time: str, doubtful: Column) -> DataFrame:
    """One row per group of reports: weighted means (among them u, v, lat, lon, alt), spread, effective count, spans, first and most frequent flight."""
    w, c = F.col(weight), F.col
    span = lambda x: F.max(x) - F.min(x)
    one = rows.groupBy(*keys).agg(
        *[weighted_mean(c(m), w).alias(m) for m in means], weighted_mean(c("u") * c("u"), w).alias("__u2"), weighted_mean(c("v") * c("v"), w).alias("__v2"), F.sum(w).alias("weight"),
        (F.pow(F.sum(w), 2) / F.greatest(F.sum(w * w), F.lit(1e-12))).alias("eff_n"), F.count("*").alias("n"), F.hypot(span("lat") * 111, span("lon") * 111).alias("hspan_km"), span("alt").alias("vspan_m"),
        F.min_by(flight, order).alias(f"first_{flight}"), F.mode(c(flight), True).alias(f"mode_{flight}"), span(time).alias("span_us"), F.count_if(doubtful).alias("doubtful"),
    )
    beyond = lambda a, b: F.greatest(F.lit(0.0), c(a) - c(b) * c(b))
    spread = F.sqrt(beyond("__u2", "u") + beyond("__v2", "v"))
    return one.select(*keys, *[_rounded(m, 4) for m in means], F.round(spread, 4).alias("spread"), _rounded("weight", 2), _rounded("eff_n", 4), "n", _rounded("hspan_km", 4), "vspan_m", f"first_{flight}", f"mode_{flight}", "span_us", "doubtful")


def by_height(alt: Column, steps) -> Column:
    """The value of the first step (top, value) whose top lies above; the last one's beyond."""
    out = F.when(alt < steps[0][0], float(steps[0][1]))
    for top, value in steps[1:-1]:
        out = out.when(alt < top, float(value))
    return out.otherwise(float(steps[-1][1]))


def component_summary(df: DataFrame, keys: list[str], eu: str, ev: str, alt: str, sigma_a, sigma_b) -> DataFrame:
    """Errors by component and as vectors, and how they compare with two tables of standard deviations by height."""
    u, v, a, b = F.col(eu), F.col(ev), by_height(F.col(alt), sigma_a), by_height(F.col(alt), sigma_b)
    sq, vec = 0.5 * (u * u + v * v), F.sqrt(u * u + v * v)
    rms = F.sqrt(F.avg(sq))
    parts = {
        "u_bias": F.avg(u), "v_bias": F.avg(v), "u_mae": F.avg(F.abs(u)), "v_mae": F.avg(F.abs(v)), "u_rmse": F.sqrt(F.avg(u * u)), "v_rmse": F.sqrt(F.avg(v * v)), "component_rmse": rms,
        "vector_rmse": F.sqrt(F.avg(vec * vec)), "vector_mae": F.avg(vec), "sigma_a": F.avg(a), "sigma_b": F.avg(b), "over_a": rms / F.avg(a), "over_b": rms / F.avg(b), "chi2_a": F.avg(sq / (a * a)), "chi2_b": F.avg(sq / (b * b)), "worst": F.max(vec),
    }
    m = with_quantiles(df, keys, [F.count("*").alias("points"), *[F.round(x, 6).alias(n) for n, x in parts.items()]], vec, {"p95": 0.95})
    return m.withColumn("p95", F.round("p95", 6))


def frame_strata(frames: DataFrame, config: str, rules: dict[str, tuple[str, bool]]) -> DataFrame:
    """Every configuration in every stratum, empty ones too. frames: holdout, rmse, mae, bias_u, bias_v per frame.

    rules: stratum -> (condition, official); error metrics are given for official strata only.
    """
    named = strata(frames, {n: F.expr(r) for n, (r, _) in rules.items()})
    n = F.col("holdout")
    pooled = lambda c, x: F.try_divide(F.sum(x * n), F.sum(F.when(F.col(c).isNotNull(), n)))
    parts = {"mean_rmse": F.avg("rmse"), "mean_mae": F.avg("mae"), "worst": F.max("rmse"), "bias_u": F.avg("bias_u"), "bias_v": F.avg("bias_v"), "weighted_rmse": F.sqrt(pooled("rmse", F.col("rmse") * F.col("rmse"))), "weighted_mae": pooled("mae", F.col("mae"))}
    wanted = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    m = with_quantiles(named, [config, "stratum"], [F.count("*").alias("frames"), F.sum("holdout").alias("points"), *[x.alias(c) for c, x in parts.items()]], F.col("rmse"), wanted)
    every = F.explode(F.array(*[F.struct(F.lit(s).alias("stratum"), F.lit(o).alias("official")) for s, (_, o) in rules.items()]))
    full = frames.select(config).distinct().select(config, every.alias("s")).select(config, "s.stratum", "s.official").join(m, [config, "stratum"], "left")
    metrics = ["mean_rmse", "mean_mae", "p50", "p90", "p95", "p99", "worst", "bias_u", "bias_v", "weighted_rmse", "weighted_mae"]
    return full.select(config, "stratum", "official", F.coalesce("frames", F.lit(0)).alias("frames"), F.coalesce("points", F.lit(0)).alias("points"), *[F.when(F.col("official"), F.round(c, 6)).alias(c) for c in metrics])


def by_configuration(frames: DataFrame, settings: list[str], rmse: str, holdout: str, support: str) -> DataFrame:
    """Frames by all settings of their configuration; only frames with a hold-out are official. Ordered by the mean error."""
    has = F.col(holdout) > 0
    held = F.when(has, F.col(rmse))
    g = frames.groupBy(*settings).agg(
        F.count("*").alias("frames"), F.count_if(has).alias("official"), F.sum(holdout).alias("points"), F.round(F.avg(held), 6).alias("mean_rmse"), F.round(F.max(held), 6).alias("worst"),
        F.round(F.sqrt(F.try_divide(F.sum(F.col(rmse) * F.col(rmse) * F.col(holdout)), F.sum(holdout))), 6).alias("weighted_rmse"), F.round(F.avg(support), 6).alias("support"),
    )
    return g.orderBy(F.col("mean_rmse").asc_nulls_last(), *settings)


def tail_metrics(points: DataFrame, frame: str, eu: str, ev: str, rules: dict[str, Column], means: dict[str, tuple[str, int]]) -> DataFrame:
    """Per stratum: counts, errors, quantiles of them and the share of all squared error; rows may fall in several strata."""
    sized = points.withColumn("__e", F.sqrt(F.col(eu) * F.col(eu) + F.col(ev) * F.col(ev)))
    total = sized.agg(F.sum(F.col("__e") * F.col("__e")).alias("__sse"))  # one row
    named = strata(sized, rules)
    e = F.col("__e")
    plain = [F.count("*").alias("points"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mae"), F.max(e).alias("worst"), F.sum(e * e).alias("__part"), *[F.round(F.avg(c), k).alias(n) for n, (c, k) in means.items()]]
    m = with_quantiles(named, ["stratum"], plain, e, {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99})
    seen = named.select("stratum", frame).distinct().groupBy("stratum").agg(F.count("*").alias("frames"))
    out = m.join(seen, "stratum").join(F.broadcast(total)).withColumn("sse_share", F.try_divide("__part", "__sse"))
    return out.select("stratum", "points", "frames", *[_rounded(c) for c in ("rmse", "mae", "p50", "p90", "p95", "p99", "worst", "sse_share")], *means)


def score_buckets(df: DataFrame, bucket: str, error: str, high: float) -> DataFrame:
    """Errors by bucket of a score, and what the buckets from each upward hold: rows, high errors, squared error."""
    e = F.col(error)
    m = with_quantiles(df, [bucket], [F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("mae"), F.count_if(e >= high).alias("high"), F.sum(e * e).alias("__sse")], e, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    down, all_ = Window.orderBy(F.col(bucket).desc()).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()  # a row per bucket
    share = lambda c, w: F.round(F.try_divide(F.sum(c).over(w), F.sum(c).over(all_)), 6)
    own = lambda c: F.round(F.try_divide(F.col(c), F.sum(c).over(all_)), 6)
    return m.select(
        bucket, "n", own("n").alias("share"), *[_rounded(c) for c in ("rmse", "mae", "p50", "p95", "p99")], "high", F.round(F.col("high") / F.col("n"), 6).alias("high_rate"), own("high").alias("high_recall"), own("__sse").alias("sse_share"),
        F.sum("n").over(down).alias("n_above"), share("high", down).alias("recall_above"), share("__sse", down).alias("sse_above"),
    )


def correlations(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """keys, a, b, r for all ordered pairs of columns, in one pass; null where one of them does not vary."""
    pairs = [(a, b) for k, a in enumerate(columns) for b in columns[k:]]
    varies = lambda c: F.max(c) > F.min(c)
    r = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    wide = df.groupBy(*keys).agg(*[F.when(varies(a) & varies(b), F.round(r(a, b), 6)).alias(f"__{a}__{b}") for a, b in pairs])
    both = [(a, b, f"__{a}__{b}") for a, b in pairs] + [(b, a, f"__{a}__{b}") for a, b in pairs if a != b]
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(c).alias("r")) for a, b, c in both])).alias("x")).select(*keys, "x.*")


def baseline_chances(km: str, climb: str, gap: str, ahead: str, back: str, high: str, chance: str) -> dict[str, Column]:
    """Chances that a bridge is right, by six models from none to a calibrated one."""
    c = F.col
    near = (c(km) <= 3) & (c(climb) <= 1000) & (c(gap) <= 900)
    return {
        "none": F.lit(0.0), "physical": F.when(near, 1.0).otherwise(0.0), "forward": F.exp(-0.5 * c(ahead)), "both_ways": F.exp(-0.25 * (c(ahead) + c(back))),
        "covariance": F.exp(-0.20 * (c(ahead) + c(back) + c(high))), "calibrated": c(chance),
    }


def brier_scores(df: DataFrame, models: dict[str, Column], y: str, bins: int) -> DataFrame:
    """model, brier, ece: each row meets every model inside one pass, and only bins are shuffled."""
    long = df.select(F.col(y).alias("y"), F.explode(F.array(*[F.struct(F.lit(n).alias("model"), p.cast("double").alias("p")) for n, p in models.items()])).alias("x")).select("y", "x.*")
    b = long.groupBy("model", F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("p"), F.avg("y").alias("y"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("s"))
    return b.groupBy("model").agg(F.round(F.sum("s") / F.sum("n"), 6).alias("brier"), F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("y"))) / F.sum("n"), 6).alias("ece"))


def mean_in_order(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """keys and the mean `value` of each group, its floats added one after the other in `order`.

    So the last digit does not hang on how rows are dealt to tasks, which matters where means are held against a bound.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("__u", F.avg(value).over(w)).groupBy(*keys).agg(F.max_by("__u", F.struct(*order)).alias(value))
