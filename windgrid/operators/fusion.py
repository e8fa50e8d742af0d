"""Fields of cells from weighted observations: accumulation, conflicts, reconstruction, filling, scoring.

A field is a table of rows (frame, z, y, x, ...) with a row per cell that has something to say. What
reaches into neighbouring cells is an equi-join over a small table of offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windgrid.functions.geo import clip
from windgrid.operators.joins import box, offset_join

CELL = ["frame", "z", "y", "x"]
SIX = [(-1, 0, 0), (1, 0, 0), (0, -1, 0), (0, 1, 0), (0, 0, -1), (0, 0, 1)]


def dedupe_sources(a: DataFrame, b: DataFrame, keys: list[str], value: str, t: float, overlap: float = 0.92) -> DataFrame:
    """Weights of a's rows beside b's: 1 where b has none or differs by t, 0.28 from 0.35 t, else 0.

    Where b covers `overlap` of a or more, a is a copy of b and no row of it is left.
    """
    j = a.join(b.select(*keys, F.col(value).alias("__v")), keys, "left")
    share = j.agg((F.count("__v") / F.count(F.lit(1))).alias("__s"))  # one row
    gap = F.abs(F.col(value) - F.col("__v"))
    w = F.when(F.col("__v").isNull() | (gap >= t), 1.0).when(gap >= 0.35 * t, 0.28).otherwise(0.0)
    return j.join(F.broadcast(share)).where(F.col("__s") < overlap).select(*keys, w.alias("w"))


def accumulate(obs: DataFrame, rz: int, ry: int, rx: int, sigma_z: float, sigma_xy: float, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """Every observation (frame, z, y, x, role, u, v, w) adds w * kernel to all cells of its box.

    Observations of one cell and role are summed before they are spread, since the kernel is the same
    for all of them; so the fan-out is in cells, not in observations. Returns per cell the sums of the current
    and of the context rows: weight, weighted u and v, their squares, weighted time_conf (1 where obs has none),
    and weight times kernel (space); the rows that reach it (n), and those in it (own). Sums that are not asked for are pruned.
    """
    role = F.when(F.col("role") == "current", "cur").otherwise("ctx")
    fresh = F.col("time_conf") if "time_conf" in obs.columns else F.lit(1.0)
    parts = {"w": F.lit(1.0), "wu": F.col("u"), "wv": F.col("v"), "wuu": F.col("u") * F.col("u"), "wvv": F.col("v") * F.col("v"), "time": fresh}
    own = obs.groupBy(*CELL, role.alias("r")).agg(*[F.sum(F.col("w") * e).alias(c) for c, e in parts.items()], F.count("*").alias("n"))
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx")) for a, b, c in box(rz, ry, rx, own=True)]))
    k = F.exp(-0.5 * (F.pow(F.col("o.dz") / sigma_z, 2) + (F.pow(F.col("o.dy"), 2) + F.pow(F.col("o.dx"), 2)) / sigma_xy**2))
    at = own.withColumn("o", moves).select("frame", (F.col("z") + F.col("o.dz")).alias("z"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), "r", k.alias("k"), *parts, (k * F.col("w")).alias("space"), "n", ((F.col("o.dz") == 0) & (F.col("o.dy") == 0) & (F.col("o.dx") == 0)).alias("here"))
    if bounds:
        at = at.where(F.col("z").between(0, bounds[0] - 1) & F.col("y").between(0, bounds[1] - 1) & F.col("x").between(0, bounds[2] - 1))
    only = lambda r, c: F.sum(F.when(F.col("r") == r, F.col("k") * F.col(c)).otherwise(0.0))
    return at.groupBy(*CELL).agg(*[only(r, c).alias(f"{r}_{c}") for r in ("cur", "ctx") for c in (*parts, "space")], F.sum("n").alias("n"), F.sum(F.when(F.col("here"), F.col("n")).otherwise(0)).alias("own"))


def resolve_conflict(acc: DataFrame, threshold: float, keep: float) -> DataFrame:
    """Current rows have priority: where both roles are present and disagree, 1 - keep of the context goes."""
    mean = lambda r, c: F.try_divide(F.col(f"{r}_w{c}"), F.col(f"{r}_w"))
    gap = F.hypot(mean("cur", "u") - mean("ctx", "u"), mean("cur", "v") - mean("ctx", "v"))
    conflict = F.coalesce((F.col("cur_w") > 0) & (F.col("ctx_w") > 0) & (gap >= threshold), F.lit(False))
    factor = F.when(F.col("conflict"), keep).otherwise(1.0)
    acc = acc.withColumns({"role_gap": gap, "conflict": conflict})
    return acc.withColumns({c: F.col(c) * factor for c in acc.columns if c.startswith("ctx_")})


def reconstruct(acc: DataFrame) -> DataFrame:
    """u, v, conf = w / p90 of the frame's positive weights within [0, 1], c_time, c_space; blind: no observation lies in the cell."""
    total = acc.withColumn("w", F.col("cur_w") + F.col("ctx_w")).where("w > 1e-12")
    scale = total.groupBy("frame").agg(F.greatest(F.lit(1e-6), F.percentile("w", 0.9)).alias("p90"))
    mean = lambda c: (F.col(f"cur_{c}") + F.col(f"ctx_{c}")) / F.col("w")
    out = total.withColumns({"u": mean("wu"), "v": mean("wv"), "c_time": mean("time"), "c_space": mean("space"), "blind": F.col("own") == 0})
    return out.join(scale, "frame").withColumn("conf", clip(F.col("w") / F.col("p90"), 0.0, 1.0)).drop("p90")


#: Where current rows are dense there is no background, nor where it has hardly any confidence.
SPARSE, LEAST_BACKGROUND = 0.18, 0.02


def gate_background(conf: Column, temporal: Column, change: Column, source: str, gating: str) -> Column:
    """Confidence of a background: conf is its coverage; source dense, coverage, temporal or coverage_temporal; gating none, change or strict."""
    own = {"dense": F.lit(1.0), "coverage": conf, "temporal": temporal, "coverage_temporal": conf * temporal}[source]
    if gating == "none":
        return clip(own, 0.0, 1.0)
    rapid = change >= 18
    out = (own if "temporal" in source else own * temporal) * F.when(rapid, 0.35).otherwise(1.0)
    if gating == "strict":
        out = F.when((temporal >= 0.55) & (change <= 8) & ~rapid, out).otherwise(0.0)
    return clip(out, 0.0, 1.0)


def add_background(acc: DataFrame, background: DataFrame, mode: str, weight: float) -> DataFrame:
    """Accumulated cells with a background (frame, z, y, x, bu, bv, bconf): u, v, w and bg_w.

    mode fixed: bconf * weight everywhere; gated: less where current rows are dense; sparse_gated: besides, only where
    a row reaches. A cell of widely spread context rows alone is drawn back to their mean.
    """
    tops = acc.groupBy("frame").agg(F.coalesce(F.percentile(F.when(F.col("cur_w") > 0, F.col("cur_w")), 0.9), F.lit(1.0)).alias("p90"))
    j = acc.join(background, CELL, "full").join(tops, "frame", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    j = j.withColumns({c: zero(c) for c in ("cur_w", "cur_wu", "cur_wv", "ctx_w", "ctx_wu", "ctx_wv", "ctx_wuu", "ctx_wvv", "bu", "bv", "bconf")})
    density = clip(F.col("cur_w") / F.greatest(F.coalesce("p90", F.lit(1.0)), F.lit(1e-6)), 0.0, 1.0)
    gate = F.when(F.col("bconf") >= LEAST_BACKGROUND, clip((SPARSE - density) / SPARSE, 0.0, 1.0)).otherwise(0.0)
    reached = (F.col("cur_w") > 0) | (F.col("ctx_w") > 0)
    gate = {"fixed": F.lit(1.0), "gated": gate, "sparse_gated": F.when(reached, gate).otherwise(0.0)}[mode]
    j = j.withColumn("bg_w", F.col("bconf") * gate * weight).withColumn("w", F.col("cur_w") + F.col("ctx_w") + F.col("bg_w")).where("w > 1e-12")
    return drawn_back(j.withColumns({c: (F.col(f"cur_w{c}") + F.col(f"ctx_w{c}") + F.col(f"b{c}") * F.col("bg_w")) / F.col("w") for c in "uv"}))


def drawn_back(cells: DataFrame, least_weight: float = 0.05, least_rows: int = 2, spread: float = 18.0) -> DataFrame:
    """u and v of cells of context rows alone that differ by `spread` or more: towards the rows' mean, the more the wider."""
    mean = lambda c: F.try_divide(F.col(f"ctx_w{c}"), F.col("ctx_w"))
    var = lambda c: F.greatest(F.lit(0.0), F.try_divide(F.col(f"ctx_w{c}{c}"), F.col("ctx_w")) - mean(c) * mean(c))
    wide = F.sqrt(var("u") + var("v"))
    robust = F.coalesce((F.col("cur_w") <= 0) & (F.col("ctx_w") >= least_weight) & (F.col("n") >= least_rows) & (wide >= spread), F.lit(False))
    shrink = F.least(F.lit(1.0), spread / wide)
    return cells.withColumns({"robust": robust, "u": F.when(robust, mean("u") + shrink * (F.col("u") - mean("u"))).otherwise(F.col("u")), "v": F.when(robust, mean("v") + shrink * (F.col("v") - mean("v"))).otherwise(F.col("v"))})


def layers(field: DataFrame) -> DataFrame:
    """speed, and the speeds of the cells below and above, a cell's own where there is none."""
    w = Window.partitionBy("frame", "y", "x").orderBy("z")
    f = field.withColumn("speed", F.hypot("u", "v"))
    near = lambda f: F.when(F.abs(f("z", 1).over(w) - F.col("z")) == 1, f("speed", 1).over(w)).otherwise(F.col("speed"))
    return f.withColumns({"below": near(F.lag), "above": near(F.lead)})


def diagnostics(field: DataFrame, strong: float = 60.0, rapid: float = 25.0, flat: float = 2.0, most: float = 120.0) -> DataFrame:
    """A row per frame: smoothness, divergence, vorticity, shear, vertical jumps and the numbers of cells that look wrong."""
    f = layers(vertical_jump(gradients(stencil(field, ["u", "v"])), edges=False))
    n = F.coalesce("n_around", F.lit(0))
    # missing neighbours stand for the cell itself
    off = lambda c: F.coalesce(n * (F.col(f"mean_{c}") - F.col(c)) / 6, F.lit(0.0))
    f = f.withColumn("rough", F.hypot(off("u"), off("v")))
    fast, jump = F.col("speed") >= strong, F.col("jump")
    count = {
        "strong": fast, "rapid": jump >= rapid, "strong_rapid": fast & (jump >= rapid), "flat": fast & (jump <= flat), "mismatch": fast & (F.abs(F.col("speed") - (F.col("below") + F.col("above")) / 2) >= rapid),
        "isolated": fast & (F.greatest("below", "above") < 0.7 * strong), "too_fast": F.col("speed") > most,
    }
    return f.groupBy("frame").agg(
        F.count("*").alias("n"), F.avg("rough").alias("smoothness"), F.avg(F.abs("divergence")).alias("divergence"), F.avg(F.abs("vorticity")).alias("vorticity"), F.avg("shear").alias("shear"), F.avg("jump").alias("jump_mean"),
        F.percentile("jump", 0.95).alias("jump_p95"), F.percentile("jump", 0.99).alias("jump_p99"), F.coalesce(F.avg(F.when(fast, jump)), F.lit(0.0)).alias("strong_jump"), *[F.count_if(c).alias(k) for k, c in count.items()],
    )


def vertical_jump(field: DataFrame, edges: bool = True) -> DataFrame:
    """jump: largest vector difference to the cell above and below; an edge takes its own speed, or (edges=False) nothing."""
    w = Window.partitionBy("frame", "y", "x").orderBy("z")

    def to(f):
        there = f("z", 1).over(w)
        adjacent = F.abs(there - F.col("z")) == 1
        gap = F.hypot(f("u", 1).over(w) - F.col("u"), f("v", 1).over(w) - F.col("v"))
        return F.when(adjacent, gap).otherwise(F.hypot("u", "v") if edges else F.lit(0.0))

    return field.withColumn("jump", F.greatest(to(F.lag), to(F.lead)))


def stencil(field: DataFrame, columns: list[str], mask: str | None = None) -> DataFrame:
    """mean_<column> of the six neighbours that exist, and their number n_around."""
    near = offset_join(field.select(*CELL), field.select(*CELL, *columns), ["frame"], SIX)
    means = near.groupBy(*CELL).agg(*[F.avg(f"n_{c}").alias(f"mean_{c}") for c in columns], F.count("*").alias("n_around"))
    return field.join(means, CELL, "left")


def gradients(field: DataFrame) -> DataFrame:
    """Central differences where both neighbours exist, else 0: divergence, vorticity, shear."""
    wx, wy, wz = (Window.partitionBy("frame", *[c for c in "zyx" if c != a]).orderBy(a) for a in "xyz")

    def slope(c, a, w):
        both = (F.lead(a).over(w) - F.col(a) == 1) & (F.col(a) - F.lag(a).over(w) == 1)
        return F.when(both, (F.lead(c).over(w) - F.lag(c).over(w)) / 2).otherwise(0.0)

    out = field.withColumns({"ux": slope("u", "x", wx), "vx": slope("v", "x", wx), "uy": slope("u", "y", wy), "vy": slope("v", "y", wy), "uz": slope("u", "z", wz), "vz": slope("v", "z", wz)})
    return out.withColumns({"divergence": F.col("ux") + F.col("vy"), "vorticity": F.col("vx") - F.col("uy"), "shear": F.hypot("uz", "vz")})


def dilate(cells: DataFrame, rz: int, ry: int, rx: int) -> DataFrame:
    """All cells within a box of a given one."""
    moves = F.explode(F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx")) for a, b, c in box(rz, ry, rx, own=True)]))
    at = cells.withColumn("o", moves)
    return at.select("frame", (F.col("z") + F.col("o.dz")).alias("z"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x")).distinct()


def inverse_variance(voxels: DataFrame, base: dict[str, float]) -> DataFrame:
    """Fuses sources (frame, z, y, x, source, u, v, sigma): weight base / sigma^2, spread, source entropy, agreement."""
    b = F.coalesce(*[F.when(F.col("source") == s, F.lit(w)) for s, w in base.items()], F.lit(0.0))
    w = voxels.withColumn("w", b / F.pow("sigma", 2)).where("w > 0")
    src = w.groupBy(*CELL, "source").agg(F.sum("w").alias("w"), *[F.sum(F.col("w") * F.col(c)).alias(f"w{c}") for c in "uv"], F.sum(F.col("w") * (F.pow("u", 2) + F.pow("v", 2))).alias("w2"))
    total = F.sum("w").over(Window.partitionBy(*CELL))
    p = F.col("w") / total
    g = src.withColumn("h", -p * F.ln(p)).groupBy(*CELL).agg(F.sum("w").alias("w"), (F.sum("wu") / F.sum("w")).alias("u"), (F.sum("wv") / F.sum("w")).alias("v"), (F.sum("w2") / F.sum("w")).alias("e2"), F.sum("h").alias("entropy"), F.count("*").alias("sources"))
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("e2") - F.pow("u", 2) - F.pow("v", 2)))
    return g.withColumn("spread", spread).withColumn("agreement", F.exp(-F.col("spread") / 10)).drop("e2")


def fill_from_neighbours(field: DataFrame, wanted: DataFrame, rz: int, ry: int, rx: int, least: int, most: int, factor: float) -> DataFrame:
    """Wanted cells without a value take the mean of their `most` nearest known cells in the box, w = conf / (d^2 + 1)."""
    open_ = wanted.join(field.select(*CELL), CELL, "left_anti")
    near = offset_join(open_, field.select(*CELL, "u", "v", "conf"), ["frame"], box(rz, ry, rx))
    d2 = F.pow(F.col("o.dz"), 2) + F.pow(F.col("o.dy"), 2) + F.pow(F.col("o.dx"), 2)
    near = near.withColumn("d2", d2).withColumn("r", F.row_number().over(Window.partitionBy(*CELL).orderBy("d2", "o.dz", "o.dy", "o.dx"))).where(F.col("r") <= most)
    w = F.col("n_conf") / (F.col("d2") + 1)
    g = near.groupBy(*CELL).agg(F.count("*").alias("n"), (F.sum(w * F.col("n_u")) / F.sum(w)).alias("u"), (F.sum(w * F.col("n_v")) / F.sum(w)).alias("v"), (F.avg("n_conf") * factor).alias("conf"))
    return g.where(F.col("n") >= least)


#: Least support and neighbours of a filled cell, the widest spread of its neighbours.
FILL_SUPPORT, FILL_NEIGHBOURS, FILL_SPREAD = 0.12, 3, 18.0


def supported_fill(field: DataFrame, support: DataFrame, rz: int, rxy: int, most: int = 10, spread: float = FILL_SPREAD) -> DataFrame:
    """u, v, conf of cells (frame, z, y, x, support) that are not known, from their `most` nearest known cells.

    A cell needs FILL_SUPPORT, FILL_NEIGHBOURS in the box, and neighbours that agree within `spread`.
    """
    open_ = support.where(F.col("support") >= FILL_SUPPORT).join(field.select(*CELL), CELL, "left_anti")
    near = offset_join(open_.select(*CELL, "support"), field.select(*CELL, "u", "v", "conf"), ["frame"], box(rz, rxy, rxy))
    d2 = F.pow(F.col("o.dz"), 2) + F.pow(F.col("o.dy"), 2) + F.pow(F.col("o.dx"), 2)
    near = near.withColumn("d2", d2).withColumn("r", F.row_number().over(Window.partitionBy(*CELL).orderBy("d2", "o.dz", "o.dy", "o.dx"))).where(F.col("r") <= most)
    w = clip(F.col("n_conf"), 0.05, 1.0) / (F.col("d2") + 1)
    mean = lambda c: F.sum(w * F.col(f"n_{c}")) / F.sum(w)
    square = F.sum(w * (F.col("n_u") * F.col("n_u") + F.col("n_v") * F.col("n_v"))) / F.sum(w)
    g = near.groupBy(*CELL, "support").agg(F.count("*").alias("n"), mean("u").alias("u"), mean("v").alias("v"), square.alias("__e2"), F.avg(clip(F.col("n_conf"), 0.0, 1.0)).alias("__c"))
    g = g.withColumn("spread", F.sqrt(F.greatest(F.lit(0.0), F.col("__e2") - F.col("u") * F.col("u") - F.col("v") * F.col("v")))).where((F.col("n") >= FILL_NEIGHBOURS) & (F.col("spread") <= spread))
    conf = 0.13 + 0.50 * F.col("support") + 0.18 * clip(1 - F.col("spread") / spread, 0.0, 1.0) + 0.16 * F.col("__c")
    return g.withColumn("conf", clip(conf, 0.10, 0.82)).drop("__e2", "__c")


def targets(cells: DataFrame, share: float = 0.30, least: int = 32) -> DataFrame:
    """frame, z, y, x, kind, score: the cells most worth sending, of kinds wind, motion, uncertainty and joint.

    cells: wind_weight, wind_count, motion_count (null: none), support, conf, physics, diversity. Each kind keeps `share`
    of the frame's supported cells, `least` at least; joint chooses among the kept ones by their weighted scores.
    """
    c = cells.withColumn("__k", F.greatest(F.lit(least), F.floor(share * F.count_if(F.col("support") > 0).over(Window.partitionBy("frame")))))
    sure = clip(0.55 + 0.30 * clip(F.col("physics"), 0.0, 1.0) + 0.15 * clip(F.col("diversity"), 0.0, 1.0), 0.0, 1.25)
    scores = {
        "wind": (F.col("wind_count").isNotNull(), 0.65 * F.coalesce("wind_weight", F.lit(0.0)) + 0.35 * F.log1p("wind_count"), 0.70), "motion": (F.col("motion_count").isNotNull(), 0.55 * F.log1p("motion_count") + 0.45 * F.col("support"), 0.30),
        "uncertainty": (F.col("support") > 0, F.col("support") * clip(1 - F.col("conf"), 0.0, 1.0) * sure, 0.20),
    }
    kinds = F.explode(F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(n).alias("kind"), score.alias("score"), F.lit(w).alias("weight"))) for n, (rule, score, w) in scores.items()])))
    best = lambda df, keys, tie: df.withColumn("__r", F.row_number().over(Window.partitionBy("frame", *keys).orderBy(F.round("score", 6).desc(), "z", "y", "x", *tie))).where("__r <= __k").drop("__r")
    single = best(c.select(*CELL, "__k", kinds.alias("k")).select(*CELL, "__k", "k.*"), ["kind"], [])
    joint = best(single.withColumns({"score": F.col("score") * F.col("weight"), "of": F.col("kind"), "kind": F.lit("joint")}), [], ["of"])
    return single.withColumn("of", F.col("kind")).unionByName(joint).select(*CELL, "kind", "of", "score")


def point_errors(held: DataFrame, field: DataFrame) -> DataFrame:
    """Held-out rows (frame, z, y, x, hu, hv, ...) with their error and those of the 27 cells around: number, mean, least, by confidence, spread."""
    err = F.hypot(F.col("n_u") - F.col("hu"), F.col("n_v") - F.col("hv"))
    near = offset_join(held, field.select(*CELL, "u", "v", "conf"), ["frame"], box(1, 1, 1, own=True)).withColumns({"e": err, "c": F.greatest("n_conf", F.lit(1e-6))})
    centre = (F.col("o.dz") == 0) & (F.col("o.dy") == 0) & (F.col("o.dx") == 0)
    g = near.groupBy(*held.columns).agg(
        F.max(F.when(centre, F.col("e"))).alias("err"), F.count("*").alias("cells"), F.avg("e").alias("mean"), F.min("e").alias("best"), (F.sum(F.col("e") * F.col("c")) / F.sum("c")).alias("by_conf"), F.stddev_pop("e").alias("spread"),
    )
    return g.where("err is not null").withColumn("gap", F.col("err") - F.col("best"))


def advected(cloud: DataFrame, field: DataFrame, shape: tuple[int, int], blend: float, levels: int = 3, most: int = 8) -> DataFrame:
    """cloud (frame, y, x, cloud) moved by whole cells with the mean wind of the lowest levels; the edges wrap."""
    part = lambda e: clip(F.avg(e) * blend, -most, most).cast("long")
    m = field.where(F.col("z") < levels).groupBy("frame").agg(part(F.col("u")).alias("shift_x"), part(-F.col("v")).alias("shift_y"))
    return cloud.join(m, "frame").withColumns({"y": F.pmod(F.col("y") + F.col("shift_y"), F.lit(shape[0])), "x": F.pmod(F.col("x") + F.col("shift_x"), F.lit(shape[1]))})


def future_wind(field: DataFrame, smooth: float = 0.15, decay: float = 0.95) -> DataFrame:
    """u and v drawn to the mean of the six neighbours (a missing one stands for the cell itself), conf decayed."""
    f, n = stencil(field.select(*CELL, "u", "v", "conf"), ["u", "v"]), F.coalesce("n_around", F.lit(0))
    off = lambda c: F.coalesce(n * (F.col(f"mean_{c}") - F.col(c)) / 6, F.lit(0.0))
    return f.select(*CELL, *[(F.col(c) + smooth * off(c)).alias(c) for c in "uv"], clip(F.col("conf") * decay, 0.0, 1.0).alias("conf"))


def regions(cloud: DataFrame, wind: DataFrame, shape: tuple[int, int], half: int = 64) -> DataFrame:
    """frame, region, y0, y1, x0, x1, cloud, speed: the means of two windows, at a third and two thirds of the grid."""
    h, w = shape
    out = None
    for i, (cy, cx) in enumerate(((h // 3, w // 3), (2 * h // 3, 2 * w // 3))):
        y0, y1, x0, x1 = max(0, cy - half), min(h, cy + half), max(0, cx - half), min(w, cx + half)
        inside = F.col("y").between(y0, y1 - 1) & F.col("x").between(x0, x1 - 1)
        c = cloud.where(inside).groupBy("frame").agg(F.avg("cloud").alias("cloud"))
        v = wind.where(inside).groupBy("frame").agg(F.avg(F.hypot("u", "v")).alias("speed"))
        part = c.join(v, "frame", "full").select("frame", F.lit(i).alias("region"), *[F.lit(b).alias(n) for n, b in (("y0", y0), ("y1", y1), ("x0", x0), ("x1", x1))], "cloud", "speed")
        out = part if out is None else out.unionByName(part)
    return out


class Leak(ValueError):
    """Truth that was held out has found its way into training."""


def leakage(train: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of train that are held-out rows: equal cell and components, rounded to 9 digits."""
    key = lambda d: d.select("frame", "z", "y", "x", F.round("u", 9).alias("u"), F.round("v", 9).alias("v"))
    return key(train).join(key(held), ["frame", "z", "y", "x", "u", "v"], "left_semi")


def leaked_pairs(train: DataFrame, held: DataFrame) -> DataFrame:
    """leaked: the pairs of a row of train and a held-out row that it equals. Equal rows are counted, not paired."""
    at = ["frame", "z", "y", "x", "u", "v"]
    count = lambda d, n: d.select(*at[:4], F.round("u", 9).alias("u"), F.round("v", 9).alias("v")).groupBy(*at).agg(F.count("*").alias(n))
    pairs = count(train, "__n").join(count(held, "__m"), at)
    return pairs.agg(F.coalesce(F.sum(F.col("__n") * F.col("__m")), F.lit(0)).alias("leaked"))


def guard(train: DataFrame, held: DataFrame, roles: set[str]) -> None:
    """Raises on held-out rows in training, and on training rows of a role that is not wind."""
    if not leakage(train, held).isEmpty():
        raise Leak("held-out rows are among the training rows")
    if not train.where(~F.col("role").isin(*sorted(roles)) | F.col("role").isNull()).isEmpty():
        raise Leak("training rows have a role that is no wind source")


#: For each signal of a frame the least size (of the larger frame; of this one for wind and seed), change and share of change.
TRIGGERS = {"wind": (8, 4, 0.35), "motion": (40, 10, 0.20), "pairs": (40, 15, 0.20), "links": (15, 4, 0.15), "seed": (120, 20, 0.15)}
OWN_SIZE = ("wind", "seed")


def event_trigger(frames: DataFrame, frame: str) -> DataFrame:
    """frame, reason, fired: whether a frame is worth a reconstruction, against the frame before it.

    The first frame is, one after a gap is, and one in which a signal changes by enough both in size and in share.
    """
    w = Window.orderBy(frame)  # a row per frame
    s = frames.withColumn("__f", F.lag(frame).over(w)).withColumns({f"__{n}": F.lag(n).over(w) for n in TRIGGERS})
    fired = {}
    for n, (size, change, share) in TRIGGERS.items():
        apart = F.abs(F.col(n) - F.col(f"__{n}"))
        big = F.col(n) if n in OWN_SIZE else F.greatest(n, f"__{n}")
        fired[n] = (big >= size) & (apart >= change) & (apart / F.greatest(F.lit(1.0), F.abs(f"__{n}")) >= share)
    named = F.concat_ws("|", *[F.when(c, F.lit(n)) for n, c in fired.items()])
    reason = F.when(F.col("__f").isNull(), "first").when(F.col(frame) - F.col("__f") > 1, "gap").otherwise(named)
    return s.select(frame, reason.alias("reason")).withColumn("fired", F.col("reason") != "")


def between_analyses(fields: DataFrame, wanted: DataFrame, scale: float = 24.0, rapid: float = 18.0) -> DataFrame:
    """The field (frame, z, y, x, u, v) at times (t0, t1, a) between two analyses, a in [0, 1): nearest and linear.

    change is the speed by which the two differ, conf falls with it, rapid marks where it is large. At an analysis
    (a = 0) its own cells are taken; elsewhere those that both have.
    """
    cells = ["z", "y", "x"]
    first = wanted.join(fields.withColumnsRenamed({"frame": "t0", "u": "u0", "v": "v0"}), "t0")
    both = first.where("a > 0").join(fields.withColumnsRenamed({"frame": "t1", "u": "u1", "v": "v1"}), ["t1", *cells])
    whole = first.where("a = 0").withColumns({"u1": F.col("u0"), "v1": F.col("v0")}).unionByName(both)
    change = F.hypot(F.col("u1") - F.col("u0"), F.col("v1") - F.col("v0"))
    mix = lambda c: (1 - F.col("a")) * F.col(f"{c}0") + F.col("a") * F.col(f"{c}1")
    out = whole.withColumns({"u_nearest": F.when(F.col("a") < 0.5, F.col("u0")).otherwise(F.col("u1")), "u_linear": mix("u"), "v_linear": mix("v"), "change": change})
    return out.withColumns({"conf": F.exp(-F.col("change") / scale), "rapid": F.col("change") >= rapid})
