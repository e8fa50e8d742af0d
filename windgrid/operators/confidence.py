"""Confidence of support rows: factors, caps, tiers, grades, roles; what thresholds of the tiers would do; a frozen posterior.

Rows have source (amdar, turb or other), wind_speed, wind_dir, u, v, alt, batch_rows, hspan (degrees), vspan (m),
phase, wind_std, cap (of the first stage), review (a flag of an outlier), tail, flight and strict. A null of a
span, size or spread counts as the widest, a null height as below ground, a null cap as none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windgrid.functions.geo import clip
from windgrid.functions.weights import log_mean, sigmoid, steps

#: Factors by size of the batch, by its spans in degrees and metres, by phase and by the spread of its winds.
SIZE = ([1, 4, 10, 25, 49], [0.96, 0.88, 0.78, 0.60, 0.42, 0.28])
SPANS = [(0.2, 300.0, 1.0), (0.5, 600.0, 0.94), (0.8, 1000.0, 0.88), (1.5, 1800.0, 0.76), (3.0, 3000.0, 0.62), (5.0, 5000.0, 0.45)]
PHASES = {"LVR": (1.0, 230.0, 4.0), "ASC": (0.92, 180.0, 8.0), "DES": (0.88, 190.0, 8.0)}
WIND_SPREAD = [(5.0, 1.0), (10.0, 0.92), (20.0, 0.80), (35.0, 0.65)]
#: Seconds by size and spans, floors and guards of the continuous uncertainty by size.
SECONDS = [(10, 0.8, 1000.0, 300.0), (25, 5.0, 5000.0, 900.0), (49, 5.0, 5000.0, 1500.0)]
FLOOR, GUARD = ([1, 10, 25, 49], [180.0, 300.0, 600.0, 1200.0, 1800.0]), ([1, 10, 25], [60.0, 120.0, 180.0, 240.0])
#: Most plausible wind; least support and most seconds of the tiers.
PLAUSIBLE = 150.0
TIERS = {"T1": (0.72, 300.0), "T2": (0.53, 900.0), "T3": (0.30, 1800.0)}


def _first(pairs: list[tuple[Column, object]], other) -> Column:
    out = F.when(pairs[0][0], pairs[0][1])
    for rule, value in pairs[1:]:
        out = out.when(rule, value)
    return out.otherwise(other)


def scored(rows: DataFrame) -> DataFrame:
    """rows with representative, physics, identity, rejected, support, seconds and seconds_continuous."""
    amdar, turb = F.col("source") == "amdar", F.col("source") == "turb"
    size, hspan, vspan = F.coalesce("batch_rows", F.lit(999_999)), F.coalesce("hspan", F.lit(999.0)), F.coalesce("vspan", F.lit(999_999.0))
    ws, alt = F.col("wind_speed"), F.coalesce("alt", F.lit(-9999.0))
    of_batch = lambda c: F.when(amdar, c).otherwise(1.0)
    spatial = _first([((hspan <= h) & (vspan <= v), f) for h, v, f in SPANS], 0.25)
    phase = _first([(F.col("phase") == p, f) for p, (f, _, _) in PHASES.items()], 0.82)
    spread = F.coalesce("wind_std", F.lit(999.0))
    winds = _first([(size <= 1, 0.96), *[(spread < s, f) for s, f in WIND_SPREAD]], 0.45)
    representative = clip(log_mean([of_batch(steps(size, *SIZE)), of_batch(spatial), of_batch(phase), of_batch(winds)], [0.30, 0.35, 0.10, 0.25]), 0.05, 0.92)
    missing = lambda c: F.col(c).isNull() | F.isnan(c)
    bad = missing("wind_speed") | missing("wind_dir") | missing("u") | missing("v") | (ws < 0) | (F.col("wind_dir") < 0) | (F.col("wind_dir") >= 360)
    review = F.coalesce("review", F.lit(False)) | (F.abs(F.hypot("u", "v") - ws) > 0.5)
    high = amdar & (ws > PLAUSIBLE)
    backed = high & ((ws <= 200) | ((alt >= 7000) & (hspan <= 8) & (vspan <= 6500)))
    physics = _first([(bad, 0.0), (high & ~backed, 0.0), (high & (ws > 200), 0.42), (high & (alt >= 8000), 0.78), (high, 0.55), (review, 0.70)], 1.0)
    own_cap = F.coalesce("cap", F.lit(1.0))
    cap = _first([(backed & (ws > 200), F.greatest(own_cap, F.lit(0.42))), (backed, F.greatest(own_cap, F.lit(0.55)))], own_cap)
    named = F.col("tail").isNotNull().cast("int") + F.col("flight").isNotNull().cast("int")
    identity = _first([(named == 2, 1.0), (named == 1, 0.82)], 0.45)
    source = _first([(turb, 1.0), (amdar, 0.90)], 0.70)
    r = rows.withColumns({"representative": representative, "physics": physics, "identity": identity, "rejected": F.coalesce(bad | (high & ~backed) | (cap <= 0), F.lit(True))})
    support = clip(log_mean([source, F.col("physics"), F.col("representative"), F.col("identity")], [0.22, 0.28, 0.40, 0.10]), 0.0, 0.90)
    seconds = _first([(~amdar, 0.0), (size <= 1, 240.0), *[((size <= n) & (hspan <= h) & (vspan <= v), s) for n, h, v, s in SECONDS]], 2100.0)
    speed, climb = _first([(F.col("phase") == p, s) for p, (_, s, _) in PHASES.items()], 160.0), _first([(F.col("phase") == p, c) for p, (_, _, c) in PHASES.items()], 4.0)
    across = F.greatest(clip(hspan, 0.0, 999.0) * 111_000 / speed, clip(vspan, 0.0, 999_999.0) / climb)
    slow = F.least(seconds, F.greatest(across * 1.20 + steps(size, *GUARD), steps(size, *FLOOR)))
    return r.withColumns({"support": _first([(turb, 1.0), (F.col("rejected"), 0.0)], F.least(support, cap)), "seconds": seconds, "seconds_continuous": F.when(amdar, slow).otherwise(0.0)})


def tier(support: Column, seconds: Column, limits: dict[str, tuple[float, float]] = TIERS) -> Column:
    """The first tier whose support and seconds are met, T4 without any."""
    return _first([((support >= s) & (seconds <= t), n) for n, (s, t) in limits.items()], "T4")


def graded(rows: DataFrame) -> DataFrame:
    """Scored rows with tier, grade, role, subtier and advice."""
    turb, by = F.col("source") == "turb", tier(F.col("support"), F.col("seconds"))
    held = F.coalesce("strict", F.lit(False)) & ~F.col("rejected")
    r = rows.withColumn("tier", _first([(turb & held, "T0"), (turb | F.col("rejected"), "T4")], by))
    t = F.col("tier")
    grade = _first([(turb & held, "S"), (turb | F.col("rejected"), "R"), (t == "T1", "A"), (t == "T2", "B"), (t == "T3", "C")], "D")
    role = _first([(turb & held, "strict_holdout"), (turb, "strict_holdout_review"), (F.col("rejected"), "rejected_or_manual_review"), (t.isin("T1", "T2"), "support_assimilation_candidate"), (t == "T3", "low_confidence_support_or_superob_only")], "display_only_or_reject")
    direct = (F.coalesce("batch_rows", F.lit(999_999)) <= 10) & (F.coalesce("hspan", F.lit(999.0)) <= 2) & (F.coalesce("vspan", F.lit(999_999.0)) <= 2000) & (F.col("representative") >= 0.72)
    subtier = _first([((t == "T2") & direct, "T2a_direct_support_candidate"), (t == "T2", "T2b_broad_or_lower_weight_support")], t)
    r = r.withColumns({"grade": grade, "role": role, "subtier": subtier})
    advice = {"T0": "strict_holdout_evaluation_only", "T1": "direct_support_high_weight", "T2a_direct_support_candidate": "direct_support_medium_weight", "T2b_broad_or_lower_weight_support": "low_weight_or_superob_preferred", "T3": "superob_or_context_only"}
    return r.withColumn("advice", _first([(F.col("subtier") == k, v) for k, v in advice.items()], "display_only_or_reject"))


#: The grid of least supports of the first two tiers.
GRID = [(a, b) for a in (0.70, 0.72, 0.74, 0.76, 0.78) for b in (0.50, 0.53, 0.56, 0.60)]


def threshold_grid(real: DataFrame, cases: DataFrame) -> DataFrame:
    """A row per pair of thresholds: how many real rows (support, seconds) the tiers would have, the q90 of the time error
    and the share of wrong legs of validation cases (support, seconds, error_s, wrong), and what passes.

    Both tables are read once, with conditional aggregates per pair.
    """
    named = [(i, a, b, {"T1": (a, 300.0), "T2": (b, 900.0)}) for i, (a, b) in enumerate(GRID)]
    of = {i: tier(F.col("support"), F.col("seconds"), limits) for i, _, _, limits in named}
    r = real.agg(F.count("*").alias("rows"), *[F.count_if(of[i] == t).alias(f"r{i}{t}") for i, *_ in named for t in ("T1", "T2")])
    inside = lambda i, t, c: F.when(of[i] == t, F.col(c))
    # errors are whole tenths of a second, so that the state of a quantile is bounded
    tenths = cases.withColumn("error_s", F.round("error_s", 1))
    c = tenths.agg(*[F.struct(F.count_if(of[i] == t).alias("n"), F.percentile(inside(i, t, "error_s"), 0.9).alias("q90"), F.avg(inside(i, t, "wrong").cast("double")).alias("wrong")).alias(f"c{i}{t}") for i, *_ in named for t in ("T1", "T2")])
    every = [F.struct(F.lit(a).alias("t1_min"), F.lit(b).alias("t2_min"), F.col("rows").alias("rows"), *[F.col(f"r{i}{t}").alias(f"real_{t.lower()}") for t in ("T1", "T2")], *[F.col(f"c{i}{t}.{f}").alias(f"{t.lower()}_{f}") for t in ("T1", "T2") for f in ("n", "q90", "wrong")]) for i, a, b, _ in named]
    out = r.join(c).select(F.explode(F.array(*every)).alias("g")).select("g.*")  # a row each
    less = lambda c, most: F.coalesce(F.col(c), F.lit(float("inf"))) < most
    passes = less("t1_q90", 180.0) & less("t2_q90", 600.0) & (F.coalesce("t1_wrong", F.lit(float("inf"))) <= 0.01) & (F.coalesce("t2_wrong", F.lit(float("inf"))) <= 0.02)
    return out.withColumns({"coverage": (F.col("real_t1") + F.col("real_t2")) / F.greatest(F.lit(1), F.col("rows")), "passes": passes}).drop("rows")


#: The numbers of a case, each with its value where it is missing, and the marks it can have.
NUMERIC = {"best_cost": 50.0, "cross_track_q90_km": 20.0, "vertical_q90_m": 5000.0, "sampling_gap_max_seconds": 3600.0, "monotonic_violation_count": 20.0, "candidate_leg_count": 0.0, "ambiguity_margin": 1.0, "batch_size": 1.0}
MARKS = [("flight_phase", ["ASC", "DES", "LVR"]), ("source_tier", ["S0", "S1", "S2"]), ("batch_size_bucket", ["1", "2-4", "5-10", "11-25", "26-50"])]


@dataclass(frozen=True)
class Frozen:
    """A logistic model on 8 logarithms and 11 marks, and the steps of its calibration."""

    intercept: float
    weights: list[float]
    means: list[float]
    stds: list[float]
    knots: list[float]
    values: list[float]


def posterior(model: Frozen) -> Column:
    """The calibrated chance of a case; a raw chance beyond the last knot has the last value."""
    x = [F.log1p(F.greatest(F.lit(0.0), F.coalesce(F.col(n).cast("double"), F.lit(d)))) for n, d in NUMERIC.items()]
    for column, marks in MARKS:
        c = F.coalesce(F.col(column), F.lit("unknown"))
        x += [F.when(c.startswith(m) if column == "source_tier" else c == m, 1.0).otherwise(0.0) for m in marks]
    z = F.lit(model.intercept)
    for value, w, mean, std in zip(x, model.weights, model.means, model.stds, strict=True):
        z = z + w * (value - mean) / std
    raw = sigmoid(z)
    return _first([(raw <= k, v) for k, v in zip(model.knots[:-1], model.values[:-1], strict=True)], model.values[-1]) if len(model.knots) > 1 else F.lit(model.values[0])
