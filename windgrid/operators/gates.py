"""Choices under constraints: thresholds, policies, promotion of a candidate over a baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windgrid.operators.quantiles import quantiles

#: The grid of policies, the least stability and the most wrong.
PENALTIES, MATCHED, CONTIGUOUS, POSTERIOR = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0), (0.50, 0.60, 0.70), (0.40, 0.50, 0.60), (0.90, 0.95, 0.98, 0.99)
STABLE, MOST_WRONG = 0.60, 0.01


def threshold(cases: DataFrame, score: str, label: str, hard: str, kind: str, limits: dict[str, float], grid: tuple[float, float, int]) -> DataFrame:
    """threshold, hits, false_accepts, accepted: the least threshold with the most true accepts within all limits.

    Candidates are an even grid and all scores, which should be rounded: cases are counted per distinct score
    first, and what is ordered as a whole is a row per candidate. limits: overall, accepted, kind, and the
    values of `hard` that have one.
    """
    spark = cases.sparkSession
    hits, false = F.col(label) == 1, F.col(label) == 0
    kinds = [r[0] for r in cases.select(kind).distinct().collect()]  # kinds of corruption: a fixed few
    named = [h for h in limits if h not in ("overall", "accepted", "kind")]
    counted = {"n": F.lit(True), "hits": hits, "false": false} | {f"hard_{h}": false & (F.col(hard) == h) for h in named} | {f"kind_{i}": false & F.col(kind).eqNullSafe(F.lit(k)) for i, k in enumerate(kinds)}
    cells = cases.groupBy(F.col(score).alias("t")).agg(*[F.count_if(c).alias(n) for n, c in counted.items()])
    low, high, steps = grid
    even = spark.createDataFrame([(round(low + (high - low) * i / (steps - 1), 6),) for i in range(steps)], "t double")
    cells = cells.unionByName(even.select("t", *[F.lit(0).cast("long").alias(n) for n in counted])).groupBy("t").agg(*[F.sum(n).alias(n) for n in counted])
    down, all_ = Window.orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    above = cells.select("t", *[F.sum(n).over(down).alias(n) for n in counted], *[F.sum(n).over(all_).alias(f"all_{n}") for n in counted])
    share = lambda n, of: F.col(n) / F.greatest(F.lit(1), F.col(of))
    ok = (share("false", "all_false") <= limits["overall"]) & (share("false", "n") <= limits["accepted"])
    for h in named:
        ok &= share(f"hard_{h}", f"all_hard_{h}") <= limits[h]
    for i in range(len(kinds)):
        ok &= share(f"kind_{i}", f"all_kind_{i}") <= limits["kind"]
    best = above.where(ok).orderBy(F.col("hits").desc(), "t").limit(1)
    return best.select(F.col("t").alias("threshold"), "hits", F.col("false").alias("false_accepts"), F.col("n").alias("accepted"))


def policies(cases: DataFrame) -> DataFrame:
    """Every policy of the grid with what it accepts, and the chosen one.

    cases: penalty, matched, contiguous, stable, posterior, wrong, clean. Of the policies within MOST_WRONG that
    accept anything the one that keeps most clean cases is chosen, then the one that accepts most, then the one
    of the least posterior; without any, the one least wrong, then the one that accepts most. Cases are read
    once, with one conditional count per policy.
    """
    inner = [(m, c, p) for m in MATCHED for c in CONTIGUOUS for p in POSTERIOR]
    ok = [(F.col("matched") >= m) & (F.col("contiguous") >= c) & (F.col("stable") >= STABLE) & (F.col("posterior") >= p) for m, c, p in inner]
    per = [F.struct(F.count_if(t).alias("accepted"), F.count_if(t & F.col("wrong")).alias("bad"), F.count_if(t & F.col("clean")).alias("kept")).alias(f"g{i}") for i, t in enumerate(ok)]
    wide = cases.groupBy("penalty").agg(F.count_if("clean").alias("cleans"), *per)
    every = cases.sparkSession.createDataFrame([(p,) for p in PENALTIES], "pen double")
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("cov"), F.lit(c).alias("run"), F.lit(p).alias("post"), F.col(f"g{i}").alias("g")) for i, (m, c, p) in enumerate(inner)]))
    long = every.join(wide, F.col("pen") == F.col("penalty"), "left").select("pen", "cleans", rows.alias("r")).select("pen", F.coalesce("cleans", F.lit(0)).alias("cleans"), "r.cov", "r.run", "r.post", *[F.coalesce(F.col(f"r.g.{c}"), F.lit(0)).alias(c) for c in ("accepted", "bad", "kept")])
    long = long.withColumns({"wrong_rate": F.col("bad") / F.greatest(F.lit(1), F.col("accepted")), "retention": F.col("kept") / F.greatest(F.lit(1), F.col("cleans"))})
    fit = (F.col("wrong_rate") <= MOST_WRONG) & (F.col("accepted") > 0)
    rank = [F.when(fit, 0).otherwise(1), F.when(fit, -F.col("retention")).otherwise(F.col("wrong_rate")), F.col("accepted").desc(), F.when(fit, F.col("post")).otherwise(0.0)]
    place = F.row_number().over(Window.orderBy(*rank, "pen", "cov", "run", "post"))  # 216 rows
    return long.select("pen", "cov", "run", "post", "accepted", F.round("wrong_rate", 8).alias("wrong_rate"), F.round("retention", 8).alias("retention"), (place == 1).alias("chosen"))


def promotion(errors: DataFrame, tolerance: float) -> DataFrame:
    """gate, passed: ten gates that a candidate has to pass to replace the baseline, and whether it passes all.

    errors: frame, alt, speed, strict, motion, baseline, candidate (vector errors). A gate on an empty group fails.
    """
    pairs = {"b": F.col("baseline"), "c": F.col("candidate")}
    light = (F.col("speed") >= 5) & (F.col("speed") < 15)
    rms = lambda x, rule=None: F.sqrt(F.avg(F.when(rule, x * x) if rule is not None else x * x))
    by_frame = errors.groupBy("frame").agg(F.count("*").alias("n"), *[rms(x).alias(k) for k, x in pairs.items()])
    weighted = by_frame.agg(*[F.sqrt(F.sum(F.col(k) * F.col(k) * F.col("n")) / F.sum("n")).alias(f"weighted_{k}") for k in pairs])
    tails = quantiles(by_frame, [], "b", {"p95_b": 0.95, "p99_b": 0.99}).join(quantiles(by_frame, [], "c", {"p95_c": 0.95, "p99_c": 0.99}))  # a row each
    plain = errors.agg(
        F.bool_and("strict").alias("strict"), F.bool_or("motion").alias("motion"), *[rms(x, F.col("alt") >= 12000).alias(f"high_{k}") for k, x in pairs.items()], *[rms(x, light).alias(f"light_rmse_{k}") for k, x in pairs.items()],
        *[F.avg(F.when(light, x)).alias(f"light_mae_{k}") for k, x in pairs.items()], *[F.avg(x / F.greatest(F.lit(10.0), F.col("speed"))).alias(f"relative_{k}") for k, x in pairs.items()],
        F.count_if((F.col("speed") >= 5) & (F.col("speed") < 30) & (pairs["c"] / F.greatest(F.lit(1e-6), F.col("speed")) > 2) & (pairs["c"] - pairs["b"] > 5)).alias("worse"),
    )
    row = plain.join(weighted).join(tails, how="left")
    no_worse = lambda n: F.coalesce(F.col(f"{n}_c") <= F.col(f"{n}_b") + tolerance, F.lit(False))
    found = {
        "strict_holdout": F.col("strict"), "motion_is_no_wind": ~F.col("motion"), "weighted_rmse": no_worse("weighted"), "frame_p95": no_worse("p95"), "frame_p99": no_worse("p99"), "alt_12km_plus_rmse": no_worse("high"),
        "light_rmse": no_worse("light_rmse"), "light_mae": no_worse("light_mae"), "floor10_relative_mae": no_worse("relative"), "light_moderate_tail": F.col("worse") == 0,
    }
    overall = F.lit(True)
    for g in found.values():
        overall = overall & F.coalesce(g, F.lit(False))
    every = [F.struct(F.lit(n).alias("gate"), F.coalesce(g, F.lit(False)).alias("passed")) for n, g in (found | {"overall": overall}).items()]
    return row.select(F.explode(F.array(*every)).alias("x")).select("x.*")


#: The borders of the rules that switch a correction on, and its scales.
SPEEDS, HEIGHTS, RISKS, JUMPS, SCALES = (15, 20, 30, 45, 60), (9000, 12000), (0.10, 0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.50), (10, 15, 20, 30), (0.25, 0.5, 0.75, 1.0)


def rules(profile: str = "broad") -> dict[str, tuple[int, Column]]:
    """Rules by name with their complexity: where a correction is switched on, by what is known without truth.

    Columns: pred_speed, alt_m, light (a light wind is predicted), risk, sigma_rep, role_gap, vertical_gap.
    Profiles tail_safe and narrow_safe leave out rules that are on nearly everywhere, or at slow winds.
    """
    speed, alt, risk, dark = F.col("pred_speed"), F.col("alt_m"), F.col("risk"), ~F.col("light")
    found: dict[str, tuple[int, Column, int]] = {"all_points": (1, F.lit(True), 0), "not_light": (1, dark, 0)}  # the last: 0 broad, 1 tail_safe, 2 narrow_safe
    for s in SPEEDS:
        found[f"speed_{s}"] = (1, speed >= s, 1 if s >= 45 else 0)
        found[f"speed_{s}_not_light"] = (2, (speed >= s) & dark, 2 if s >= 45 else 0)
    for h in HEIGHTS:
        found[f"alt_{h}"] = (1, alt >= h, 0)
        found[f"alt_{h}_not_light"] = (2, (alt >= h) & dark, 0)
    for r in RISKS:
        n, over = f"risk_{round(100 * r)}", risk >= r
        found[n] = (1, over, 0)
        found[f"{n}_not_light"] = (2, over & dark, 2 if r > 0.10 else 1)
        for other, also, safe in (("speed_30", speed >= 30, 0), ("speed_45", speed >= 45, 1), ("alt_12000", alt >= 12000, 1)):
            found[f"{n}_or_{other}_not_light"] = (3, (over | also) & dark, safe)
    found["risk_20_to_50_not_light"] = (3, (risk >= 0.20) & (risk < 0.50) & dark, 2)
    found["role_gap_30_not_light"] = (2, (F.col("role_gap") >= 30) & dark, 2)
    found["sigma_10_not_light"] = (2, (F.col("sigma_rep") >= 10) & dark, 2)
    for j in JUMPS:
        found[f"vertical_gap_{j}_not_light"] = (2, (F.col("vertical_gap") >= j) & dark, 2)
    least = {"broad": 0, "tail_safe": 1, "narrow_safe": 2}[profile]
    return {n: (c, rule) for n, (c, rule, safe) in found.items() if safe >= least}


def choose_rule(points: DataFrame, profile: str = "narrow_safe", scales: tuple[float, ...] = SCALES, tolerance: float = 1e-6, least_gain: float = 0.0, least_points: int = 1) -> DataFrame:
    """A row per rule and scale: what it changes on val and on test, whether each passes all guardrails, and the chosen one.

    points: split (val, test; others are not read), u_miss, v_miss (baseline minus truth), du, dv (the correction), speed
    (true) and the columns of `rules`. Only val chooses: among those that pass there and gain, the one of the least
    error, then of the least complexity, scale and name; test is reported. Errors are rounded to a hundredth, so that
    the state of a quantile is bounded.
    """
    named = rules(profile)
    p = points.where(F.col("split").isin("val", "test"))
    on = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(c).alias("complexity"), F.coalesce(rule, F.lit(False)).alias("on")) for n, (c, rule) in named.items()]))
    p = p.select("split", "u_miss", "v_miss", "du", "dv", "speed", on.alias("r")).select("*", "r.*").drop("r")
    base = F.round(F.hypot("u_miss", "v_miss"), 2)
    scale = lambda s: F.when(F.col("on"), F.lit(s)).otherwise(0.0)
    p = p.withColumn("e", base).withColumns({f"e{i}": F.round(F.hypot(F.col("u_miss") + scale(s) * F.col("du"), F.col("v_miss") + scale(s) * F.col("dv")), 2) for i, s in enumerate(scales)})
    light, mild = (F.col("speed") >= 5) & (F.col("speed") < 15), (F.col("speed") >= 5) & (F.col("speed") < 30)

    def measures(e: str) -> dict[str, Column]:
        x = F.col(e)
        return {
            "rmse": F.sqrt(F.avg(x * x)), "p95": F.percentile(x, 0.95), "p99": F.percentile(x, 0.99), "light_rmse": F.coalesce(F.sqrt(F.avg(F.when(light, x * x))), F.lit(0.0)), "light_mae": F.coalesce(F.avg(F.when(light, x)), F.lit(0.0)),
            "floor10": F.avg(x / F.greatest(F.col("speed"), F.lit(10.0))), "large": F.count_if(x >= 30).cast("double"), "worse": F.count_if(mild & (x / F.greatest(F.col("speed"), F.lit(1e-6)) > 2) & (x - F.col("e") > 5)).cast("double"),
        }

    g = p.groupBy("rule", "complexity", "split").agg(F.count_if("on").alias("enabled"), *[F.struct(*[c.alias(n) for n, c in measures(e).items()]).alias(f"m_{e}") for e in ["e", *[f"e{i}" for i in range(len(scales))]]])
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("scale"), F.col(f"m_e{i}").alias("m")) for i, s in enumerate(scales)]))
    g = g.select("rule", "complexity", "split", "enabled", F.col("m_e").alias("b"), each.alias("s")).select("rule", "complexity", "split", "enabled", "b", "s.scale", "s.m")  # a row per rule, split and scale from here
    ok = F.col("m.worse") == 0
    for n in ("rmse", "p95", "p99", "light_rmse", "light_mae", "floor10"):
        ok = ok & (F.col(f"m.{n}") <= F.col(f"b.{n}") + tolerance)
    g = g.withColumns({"passes": ok & (F.col("m.large") <= F.col("b.large")), "delta": F.col("m.rmse") - F.col("b.rmse")})
    of = lambda split, c: F.max(F.when(F.col("split") == split, F.col(c)))
    wide = g.groupBy("rule", "complexity", "scale").agg(*[of(s, c).alias(f"{s}_{c}") for s in ("val", "test") for c in ("enabled", "delta", "passes")])
    wide = wide.withColumn("eligible", F.coalesce(F.col("val_passes") & (F.round("val_delta", 6) < -least_gain) & (F.col("val_enabled") >= least_points), F.lit(False)))
    place = F.row_number().over(Window.orderBy(F.col("eligible").desc(), F.round("val_delta", 6), "complexity", "scale", "rule"))
    return wide.withColumn("chosen", (place == 1) & F.col("eligible"))
