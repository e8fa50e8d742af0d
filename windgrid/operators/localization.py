"""How far an observation reaches: kernels by frame, by observation and by target cell.

Observations are rows (frame, z, y, x, role, u, v, w, alt, time_conf, obs_count, consistency, error_weight);
role is current or context. Nothing here looks at rows that are held out.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windgrid.functions.geo import clip
from windgrid.operators.fusion import CELL, layers, vertical_jump
from windgrid.operators.joins import box


def _is(role: str) -> Column:
    return F.col("role") == role


@dataclass(frozen=True)
class Regime:
    """Fixed values of the rules that choose a frame's kernel."""

    high_altitude: float = 12000.0
    high_speed: float = 60.0
    high_altitude_share: float = 0.22
    high_speed_share: float = 0.12
    low_current: int = 2
    high_current: int = 8
    enough_context: int = 300
    moderate_gap: float = 18.0
    high_gap: float = 30.0
    speed_scale: float = 90.0
    radius_z: int = 2
    sigma_z: float = 1.0
    tight_z: tuple[int, float] = (1, 0.75)
    kernels: tuple[tuple[int, float], ...] = ((6, 3.0), (8, 4.0), (10, 5.0), (12, 6.0))


def frame_context(obs: DataFrame, regime: Regime = Regime()) -> DataFrame:
    """A row per frame: numbers of both roles, mean freshness, consistency and error weight, role gap, shares of high and fast rows."""
    mean = lambda c, role: F.avg(F.when(role, F.col(c)))
    gap = F.hypot(mean("u", _is("current")) - mean("u", _is("context")), mean("v", _is("current")) - mean("v", _is("context")))
    share = lambda rule: F.avg(F.when(rule, 1.0).otherwise(0.0))
    return obs.groupBy("frame").agg(
        F.count_if(_is("current")).alias("n_current"), F.count_if(_is("context")).alias("n_context"), F.coalesce(mean("time_conf", _is("context")), F.lit(0.0)).alias("fresh"), F.coalesce(F.avg("consistency"), F.lit(1.0)).alias("agrees"),
        F.coalesce(F.avg("error_weight"), F.lit(1.0)).alias("error_weight"), F.coalesce(gap, F.lit(0.0)).alias("role_gap"),
        share(F.col("alt") >= regime.high_altitude).alias("high_share"), share(F.hypot("u", "v") >= regime.high_speed).alias("fast_share"),
    )


def kernels(context: DataFrame, regime: Regime = Regime()) -> DataFrame:
    """frame, policy, radius, sigma, radius_z, sigma_z: the kernel of four policies, by rules that are tried in turn."""
    n, fresh, agrees, gap = F.col("n_current"), F.col("fresh"), F.col("agrees"), F.col("role_gap")
    useful = (F.col("n_context") >= regime.enough_context) & (fresh >= 0.28)
    low, dense, sparse, lone = n <= regime.low_current, n >= 10, n <= 2, n <= 1
    ratio, weak = gap / regime.speed_scale, F.col("error_weight") < 0.90
    mismatch = (agrees < 0.94) | (ratio >= 0.08)
    big = lambda x: F.col(x)

    def turn(score: Column, rules: list) -> Column:
        for rule, value in rules:
            score = F.when(rule(score), value(score) if callable(value) else F.lit(value)).otherwise(score)
        return score

    careful = turn(F.lit(8.0), [
        (lambda s: useful & ~low & (n <= 18) & (fresh >= 0.50), 10.0), (lambda s: low & useful & (fresh >= 0.55) & ~mismatch, 10.0),
        (lambda s: (n >= regime.high_current) & (ratio >= 0.18) & (fresh < 0.50), 6.0), (lambda s: weak & (s < 10) & useful & (n <= 12), 10.0),
    ])
    calm = ((n <= 8) & (fresh <= 0.57) & (agrees >= 0.98)) | ((n <= 2) & (fresh <= 0.52) & (agrees >= 0.985))
    guarded = turn(careful, [(lambda s: (s > 8) & calm, 8.0)])
    steady, new = agrees >= 0.975, fresh >= 0.52
    by_regime = (
        F.when(mismatch | (agrees <= 0.93) | (ratio >= 0.18), 8.0).when(lone & useful & new & steady, 12.0).when(sparse & useful & new, F.greatest(guarded, F.lit(10.0)))
        .when(dense & steady & (ratio < 0.10), 8.0).otherwise(guarded)
    )
    by_regime = turn(by_regime, [(lambda s: (fresh <= 0.42) & (s > 8), 8.0), (lambda s: weak & (s > 10) & (n >= 3), 10.0)])
    risky, moderate = (gap >= regime.high_gap) | (agrees <= 0.93), gap >= regime.moderate_gap
    support = F.when(risky, 8.0).when(sparse & useful & (fresh >= 0.50) & steady, 10.0).when(dense & ~moderate, 8.0).when(useful & (fresh >= 0.50) & ~mismatch, 10.0).otherwise(8.0)
    extreme = (big("high_share") >= regime.high_altitude_share) | (big("fast_share") >= regime.high_speed_share)
    support = turn(support, [(lambda s: (fresh <= 0.36) | (moderate & ~sparse), 8.0), (lambda s: weak & (s > 8) & ~(sparse & (fresh >= 0.50)), 8.0)])
    tight = extreme | moderate
    found = {"adaptive": careful, "adaptive_v3": guarded, "regime_v4": by_regime, "support_role_height": support}

    def nearest(score: Column) -> Column:
        target = clip(2 * F.bround(score / 2), regime.kernels[0][0], regime.kernels[-1][0])
        return F.array_min(F.array(*[F.struct(F.abs(target - r).alias("off"), F.lit(r).alias("radius"), F.lit(s).alias("sigma")) for r, s in regime.kernels]))

    rows = []
    for name, score in found.items():
        close = tight if name == "support_role_height" else F.lit(False)
        rows.append(F.struct(F.lit(name).alias("policy"), nearest(score).alias("k"), F.when(close, regime.tight_z[0]).otherwise(regime.radius_z).alias("radius_z"), F.when(close, regime.tight_z[1]).otherwise(regime.sigma_z).alias("sigma_z")))
    return context.select("frame", F.explode(F.array(*rows)).alias("r")).select("frame", "r.policy", "r.k.radius", "r.k.sigma", "r.radius_z", "r.sigma_z")


def _product(gates: list[tuple[str, Column, float]]) -> tuple[Column, Column]:
    factor = reduce(lambda a, b: a * b, [F.when(rule, value).otherwise(1.0) for _, rule, value in gates])
    return factor, F.concat_ws("+", *[F.when(rule, F.lit(name)) for name, rule, _ in gates])


def horizontal(obs: DataFrame, context: DataFrame, radius: int, regime: Regime = Regime()) -> DataFrame:
    """obs with xy_factor, xy_radius and xy_reason: six gates on height, speed, role gap, freshness and support."""
    o = obs.join(context.select("frame", "n_current", "fresh", "agrees", "role_gap"), "frame")
    high, fast = F.col("alt") >= regime.high_altitude, F.hypot("u", "v") >= regime.high_speed
    moderate = F.col("role_gap") >= regime.moderate_gap
    stale = _is("context") & ((F.col("time_conf") <= 0.36) | (F.col("fresh") <= 0.36))
    widen = (F.col("n_current") <= 2) & (F.col("fresh") >= 0.50) & (F.col("agrees") >= 0.975) & ~moderate & ~high & ~fast & ~stale
    gates = [("high_altitude", high, 0.78), ("high_speed", fast, 0.85), ("role_gap", moderate, 0.80), ("stale_context", stale, 0.75), ("dense_current", _is("current") & (F.col("n_current") >= 10), 0.90), ("sparse_fresh", widen, 1.10)]
    factor, reason = _product(gates)
    o = o.withColumns({"xy_factor": clip(factor, 0.65, 1.15), "xy_reason": reason}).drop("n_current", "fresh", "agrees", "role_gap")
    return o.withColumn("xy_radius", F.greatest(F.lit(1), F.bround(radius * F.col("xy_factor")).cast("int")))


def vertical(obs: DataFrame, context: DataFrame, radius: int, regime: Regime = Regime()) -> DataFrame:
    """obs with z_factor, z_radius and z_reason: speed, height, density and freshness, and the frame's role gap and freshness."""
    o = obs.join(context.select("frame", "fresh", "role_gap"), "frame")
    first = [
        ("strong_speed", F.hypot("u", "v") >= 60.0, 0.75), ("high_altitude", F.col("alt") >= 9000.0, 0.85),
        ("dense_current", _is("current") & (F.col("obs_count") >= 6), 0.85), ("stale_context", _is("context") & (F.col("time_conf") <= 0.28), 0.70),
    ]
    none = ~reduce(lambda a, b: a | b, [rule for _, rule, _ in first])
    gates = [*first, ("sparse", none & (F.col("obs_count") <= 1), 1.10), ("role_gap", F.col("role_gap") >= regime.moderate_gap, 0.85), ("frame_stale", _is("context") & (F.col("fresh") <= 0.36), 0.85)]
    factor, reason = _product(gates)
    o = o.withColumns({"z_factor": clip(factor, 0.55, 1.25), "z_reason": reason}).drop("fresh", "role_gap")
    return o.withColumn("z_radius", F.greatest(F.lit(1), F.bround(radius * F.col("z_factor")).cast("int")))


def _share_of_p90(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Columns over the p90 of the frame's positive values (1 without any), within [0, 1]."""
    tops = df.groupBy("frame").agg(*[F.coalesce(F.percentile(F.when(F.col(c) > 0, F.col(c)), 0.9), F.lit(1.0)).alias(f"__{n}") for n, c in columns.items()])
    return df.join(tops, "frame").withColumns({n: clip(F.col(c) / F.greatest(F.col(f"__{n}"), F.lit(1e-6)), 0.0, 1.0) for n, c in columns.items()}).drop(*[f"__{n}" for n in columns])


def reliability(field: DataFrame) -> DataFrame:
    """A reconstructed field (u, v, conf, cur_w, ctx_w, role_gap) with support, reliability, tail_risk, no_claim, isolated and rapid."""
    f = _share_of_p90(vertical_jump(field, edges=False), {"current_support": "cur_w", "context_support": "ctx_w"})
    f, speed = layers(f), F.col("speed")
    mean, top = (F.col("below") + F.col("above")) / 2, F.greatest("below", "above")
    f = f.withColumns({"support": F.greatest("current_support", "context_support"), "isolated": (speed >= 60) & (top < 42), "rapid": (F.col("jump") >= 25) | ((speed >= 30) & (F.greatest(F.abs(speed - mean), F.col("jump")) >= 10))})
    gap, has_current = F.coalesce("role_gap", F.lit(0.0)), F.col("cur_w") > 0
    factors = {
        "distance": F.when(F.col("support") >= 0.35, 1.0).when(F.col("support") >= 0.10, 0.5).otherwise(0.15), "role": F.when(gap < 20, 1.0).when(gap < 30, 0.5).otherwise(0.15),
        "count": F.when(has_current | (F.col("context_support") >= 0.10), 1.0).otherwise(0.4), "layer": F.when(F.col("isolated") | F.col("rapid"), 0.25).when(F.col("jump") >= 10, 0.5).otherwise(1.0),
    }
    f = f.withColumns({f"f_{k}": v for k, v in factors.items()})
    risk = 0.20 * (1 - F.col("f_distance")) + 0.20 * (1 - F.col("f_role")) + 0.20 * clip((0.2 - F.col("conf")) / 0.2, 0.0, 1.0) + 0.15 * (1 - F.col("f_count")) + 0.15 * (1 - F.col("f_layer"))
    f = f.withColumns({"reliability": clip(F.col("conf") * F.col("f_distance") * F.col("f_role") * F.col("f_count") * F.col("f_layer"), 0.0, 1.0), "tail_risk": clip(risk + F.when((F.col("ctx_w") > 0) & ~has_current, 0.10).otherwise(0.0), 0.0, 1.0)})
    return f.withColumn("no_claim", (F.col("conf") < 0.05) | (F.col("reliability") < 0.05)).drop("below", "above", *[f"f_{k}" for k in factors])


def guarded(obs: DataFrame, seed: DataFrame, context: DataFrame) -> DataFrame:
    """obs (after `vertical`) whose z_factor is kept only where the seed's `reliability` at its cell allows it; guard says why not."""
    at = seed.select(*CELL, *[F.col(c).alias(f"s_{c}") for c in ("reliability", "tail_risk", "no_claim", "conf", "support", "current_support", "role_gap", "isolated", "rapid")])
    o = obs.join(at, CELL, "left").join(context.select("frame", F.col("role_gap").alias("c_gap")), "frame")
    speed, gap = F.hypot("u", "v"), F.greatest(F.coalesce("s_role_gap", F.lit(0.0)), F.col("c_gap"))
    rel, risk, conf, support = F.coalesce("s_reliability", F.lit(0.0)), F.coalesce("s_tail_risk", F.lit(1.0)), F.coalesce("s_conf", F.lit(0.0)), F.coalesce("s_support", F.lit(0.0))
    unclaimed = F.coalesce("s_no_claim", F.lit(True))
    alone = F.coalesce(F.col("s_isolated") | F.col("s_rapid"), F.lit(False)) | ((speed >= 60) & (F.coalesce("s_current_support", F.lit(0.0)) <= 0) & (support < 0.35))
    poor = (risk >= 0.45) | (rel < 0.20) | unclaimed | (conf < 0.05) | (support < 0.10)
    against = {
        "low_reliability": rel < 0.20, "high_tail_risk": risk >= 0.45, "no_claim": unclaimed, "near_zero_confidence": conf < 0.05, "remote_support": support < 0.10, "role_gap": gap >= 30,
        "high_role_gap": (F.col("alt") >= 12000) & (gap >= 30), "context_extreme": _is("context") & (speed >= 60), "vertical_isolated": alone, "light_protected": (speed <= 30) & (poor | (gap >= 20)),
    }
    o = o.withColumn("guard", F.concat_ws("+", *[F.when(rule, F.lit(n)) for n, rule in against.items()]))
    return o.withColumn("z_factor", F.when(F.col("guard") == "", F.col("z_factor")).otherwise(1.0)).drop(*[c for c in o.columns if c.startswith("s_")], "c_gap")


def accumulate_by(obs: DataFrame, rz: int, rxy: int, sigma_z: float, sigma_xy: float, bounds: tuple[int, int, int], targets: DataFrame | None = None) -> DataFrame:
    """The accumulation of observations that have a z_factor of their own, or of target cells that have xy_factor and z_factor.

    Observations of one cell, role and factor share a kernel, so they are summed before they are spread.
    Factors widen sigma; radii are those times the factor, rounded half to even.
    """
    own_factor = F.lit(1.0) if targets is not None else F.col("z_factor")
    role = F.when(_is("current"), "cur").otherwise("ctx")
    own = obs.groupBy(*CELL, role.alias("r"), own_factor.alias("f")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("u")).alias("wu"), F.sum(F.col("w") * F.col("v")).alias("wv"))
    most = 1.25  # no factor is larger
    reach_z, reach_xy = int(rz * most + 0.5), rxy if targets is None else int(rxy * most + 0.5)
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx")) for a, b, c in box(reach_z, reach_xy, reach_xy, own=True)]))
    at = own.withColumn("o", moves).select("frame", (F.col("z") + F.col("o.dz")).alias("z"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "r", "f", "o", "w", "wu", "wv")
    at = at.where(F.col("z").between(0, bounds[0] - 1) & F.col("y").between(0, bounds[1] - 1) & F.col("x").between(0, bounds[2] - 1))
    fz, fxy = F.col("f"), F.lit(1.0)
    if targets is not None:
        at = at.join(targets.select(*CELL, "xy_factor", "z_factor"), CELL)
        fz, fxy = F.col("z_factor"), F.col("xy_factor")
    inside_z = F.abs("o.dz") <= F.when(F.lit(targets is None), F.greatest(F.lit(1), F.bround(rz * fz))).otherwise(F.bround(rz * fz))
    inside_xy = F.greatest(F.abs("o.dy"), F.abs("o.dx")) <= F.greatest(F.lit(1), F.bround(rxy * fxy))
    k = F.exp(-0.5 * (F.pow(F.col("o.dz") / (sigma_z * fz), 2) + (F.pow(F.col("o.dy"), 2) + F.pow(F.col("o.dx"), 2)) / F.pow(sigma_xy * fxy, 2)))
    at = at.where(inside_z & inside_xy).withColumn("k", k)
    only = lambda r, c: F.sum(F.when(F.col("r") == r, F.col("k") * F.col(c)).otherwise(0.0))
    return at.groupBy(*CELL).agg(*[only(r, c).alias(f"{r}_{c}") for r in ("cur", "ctx") for c in ("w", "wu", "wv")])


@dataclass(frozen=True)
class Point:
    """Fixed values of the factors by target cell."""

    base: float = 0.0
    step: float = 5000.0
    mid: float = 9000.0
    remote: float = 4.0
    sparse: int = 1
    role_gap: float = 18.0
    jump: float = 8.0


def point_regime(acc: DataFrame, near: DataFrame, values: Point = Point()) -> DataFrame:
    """Support map of every target cell with xy_factor and z_factor.

    acc: sums by role (cur_w, cur_wu, ...); near: frame, z, y, x, n_current, distance of the nearest current cell.
    """
    both = (F.col("cur_w") > 0) & (F.col("ctx_w") > 0)
    mean = lambda r, c: F.try_divide(F.col(f"{r}_w{c}"), F.col(f"{r}_w"))
    total = F.col("cur_w") + F.col("ctx_w")
    m = acc.where(total > 0).withColumns({"role_gap": F.when(both, F.hypot(mean("cur", "u") - mean("ctx", "u"), mean("cur", "v") - mean("ctx", "v"))).otherwise(0.0), "u": (F.col("cur_wu") + F.col("ctx_wu")) / total, "v": (F.col("cur_wv") + F.col("ctx_wv")) / total})
    m = vertical_jump(m, edges=False).join(near, CELL, "left").withColumns({"n_current": F.coalesce("n_current", F.lit(0))})
    far, sparse = F.coalesce(F.col("distance") >= values.remote, F.lit(True)), F.col("n_current") <= values.sparse
    high = values.base + F.col("z") * values.step >= values.mid
    gap, jump, lone = F.col("role_gap") >= values.role_gap, F.col("jump") >= values.jump, (F.col("ctx_w") > 0) & (F.col("cur_w") <= 0)
    still = sparse & F.coalesce(F.col("distance") <= values.remote, F.lit(False)) & ~gap & ~jump & (values.base + F.col("z") * values.step < 12000)
    xy, why = _product([("remote", far, 0.94), ("high", high, 0.94), ("role_gap", gap, 0.92), ("jump", jump, 0.94), ("context_only", lone, 0.96), ("still_sparse", still, 1.04)])
    z, _ = _product([("remote", far, 0.94), ("high", high, 0.90), ("role_gap", gap, 0.88), ("jump", jump, 0.84), ("still_sparse", still, 1.02)])
    return m.withColumns({"xy_factor": clip(xy, 0.84, 1.06), "z_factor": clip(z, 0.78, 1.04), "why": why})
