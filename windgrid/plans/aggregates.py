"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windgrid.functions import clean
from windgrid.operators import aggregates as A
from windgrid.operators import quantiles as Q
from windgrid.operators.joins import box, offset_join
from windgrid.operators.ordering import top_k
from windgrid.operators.voxels import Grid, voxelize
from windgrid.plans.base import ERRORS, OBS, SCORED, errors, obs, query, r6, read, scored
from windgrid.plans.projections import VOXEL

CELLS = f"{OBS}, cells AS (SELECT *, {VOXEL} FROM obs WHERE lat <= 54.2)"
#: a coarse grid on which the driver's events meet
COARSE = "floor((54.2::DOUBLE - lat) / 5.0)::BIGINT AS y, floor((lon - 73.0::DOUBLE) / 5.0)::BIGINT AS x, floor(alt / 5000)::BIGINT AS z"
CCELLS = f"{OBS}, cells AS (SELECT *, {COARSE} FROM obs)"
COARSE_GRID = Grid(step=5.0, dz=5000.0, levels=4)


def coarse(spark, d):
    return voxelize(obs(spark, d), COARSE_GRID, bounded=False)


@query("agg_01_batch_spans", f"""
WITH {OBS} SELECT source, ident, count(*) AS n, round(max(lat) - min(lat), 6) AS dlat, round(sqrt(pow(max(lat) - min(lat), 2) + pow(max(lon) - min(lon), 2)), 6) AS hspan, max(alt) - min(alt) AS vspan FROM obs GROUP BY source, ident""")
def agg_01(spark, d):
    dlat, dlon = F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon")
    return obs(spark, d).groupBy("source", "ident").agg(F.count("*").alias("n"), r6(dlat).alias("dlat"), r6(F.hypot(dlat, dlon)).alias("hspan"), (F.max("alt") - F.min("alt")).alias("vspan"))


@query("agg_02_batch_class", f"""
WITH {OBS}, b AS (SELECT source, ident, count(*) AS n, sqrt(pow(max(lat) - min(lat), 2) + pow(max(lon) - min(lon), 2)) AS h FROM obs GROUP BY source, ident)
SELECT source, ident, CASE WHEN n > 1 AND h >= 40 AND source = 'amdar' THEN 'batched' WHEN n > 30 THEN 'duplicate' ELSE 'single' END AS flag FROM b""")
def agg_02(spark, d):
    b = obs(spark, d).groupBy("source", "ident").agg(F.count("*").alias("n"), F.hypot(F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon")).alias("h"))
    return b.select("source", "ident", clean.first_reason([("batched", F.expr("n > 1 and h >= 40 and source = 'amdar'")), ("duplicate", F.expr("n > 30"))], "single").alias("flag"))


@query("agg_03_first_in_order", f"WITH {OBS} SELECT ident, arg_min(source, us) AS first_source, arg_min(alt, us) AS first_alt, min(us) AS us FROM obs GROUP BY ident")
def agg_03(spark, d):
    order = F.struct("us", "event_id")
    return obs(spark, d).groupBy("ident").agg(F.min_by("source", order).alias("first_source"), F.min_by("alt", order).alias("first_alt"), F.min("us").alias("us"))


@query("agg_04_last_in_order", f"WITH {OBS} SELECT ident, arg_max(source, us) AS last_source, arg_max(alt, us) AS last_alt FROM obs GROUP BY ident")
def agg_04(spark, d):
    order = F.struct("us", "event_id")
    return obs(spark, d).groupBy("ident").agg(F.max_by("source", order).alias("last_source"), F.max_by("alt", order).alias("last_alt"))


@query("agg_05_voxel_mean", f"WITH {CCELLS} SELECT z, y, x, round(avg(speed), 8) AS u, round(avg(wind_speed), 8) AS v, count(*) AS n FROM cells GROUP BY z, y, x")
def agg_05(spark, d):
    return coarse(spark, d).groupBy("z", "y", "x").agg(r6(F.avg("speed"), 8).alias("u"), r6(F.avg("wind_speed"), 8).alias("v"), F.count("*").alias("n"))


@query("agg_06_voxel_flight_mean", f"WITH {CCELLS} SELECT z, y, x, ident, round(avg(speed), 6) AS u, count(*) AS n FROM cells GROUP BY z, y, x, ident")
def agg_06(spark, d):
    return coarse(spark, d).groupBy("z", "y", "x", "ident").agg(r6(F.avg("speed")).alias("u"), F.count("*").alias("n"))


@query("agg_07_density", f"WITH {CELLS} SELECT z, y, x, count(*) AS density FROM cells GROUP BY z, y, x")
def agg_07(spark, d):
    return voxelize(obs(spark, d).where("lat <= 54.2D"), Grid(), bounded=False).groupBy("z", "y", "x").agg(F.count("*").alias("density"))


@query("agg_08_weighted_mean", f"WITH {ERRORS} SELECT config, round(sum(eu * w) / greatest(sum(w), 1e-12), 5) AS m FROM errors GROUP BY config")
def agg_08(spark, d):
    return errors(spark, d).groupBy("config").agg(r6(A.weighted_mean(F.col("eu"), F.col("w")), 5).alias("m"))


#: What is averaged over a super-observation, as SQL of both engines; the weight of a report is its height here.
MEANS = {
    "u": "-wind_speed * sin(radians(wind_dir))", "v": "-wind_speed * cos(radians(wind_dir))", "lat": "lat", "lon": "lon", "alt": "alt", "minute": "(us % 3600000000) / 60000000",
    "time_conf": "exp(-(us % 3600000000) / 3600000000)", "space_conf": "exp(-abs(lat - 33) / 20)", "tail_factor": "least(1.0, 60 / greatest(wind_speed, 1e-6))",
    "error_factor": "least(4.0, greatest(0.05, pow(8 / (2 + wind_speed / 20), 2)))", "obs_conf": "1 - wind_speed / 200", "raw_conf": "1 - speed / 1000", "sigma": "2 + wind_speed / 20",
    "roi_km": "abs(lon - 104) * 111", "roi_m": "abs(alt - 9000)",
}
SUPER_COLUMNS = "z, y, x, source"
SUPER = f"""{CCELLS}, val AS (SELECT z, y, x, source, ident, event_id, us, alt AS w, {', '.join(f'({e})::DOUBLE AS {n}' for n, e in MEANS.items())} FROM cells WHERE alt > 0),
one AS (SELECT {SUPER_COLUMNS}, {', '.join(f'sum({n} * w) / greatest(sum(w), 1e-12) AS {n}' for n in MEANS)}, sum(u * u * w) / greatest(sum(w), 1e-12) AS u2, sum(v * v * w) / greatest(sum(w), 1e-12) AS v2, sum(w) AS weight,
pow(sum(w), 2) / greatest(sum(w * w), 1e-12) AS eff_n, count(*) AS n, sqrt(pow((max(lat) - min(lat)) * 111, 2) + pow((max(lon) - min(lon)) * 111, 2)) AS hspan_km, max(alt) - min(alt) AS vspan_m, arg_min(ident, event_id) AS first_ident, max(us) - min(us) AS span_us, count(*) FILTER (WHERE speed_conf < 0.5) AS doubtful FROM (SELECT *, raw_conf AS speed_conf FROM val) GROUP BY {SUPER_COLUMNS}),
kinds AS (SELECT {SUPER_COLUMNS}, ident, count(*) AS c FROM val GROUP BY {SUPER_COLUMNS}, ident), most AS (SELECT {SUPER_COLUMNS}, arg_min(ident, (-c, ident)) AS mode_ident FROM kinds GROUP BY {SUPER_COLUMNS})"""


@query("agg_09_super_observation", f"WITH {SUPER} SELECT {SUPER_COLUMNS}, {', '.join(f'round({n}, 4) AS {n}' for n in MEANS)}, round(sqrt(greatest(0.0, u2 - u * u) + greatest(0.0, v2 - v * v)), 4) AS spread, round(weight, 2) AS weight, round(eff_n, 4) AS eff_n, n, round(hspan_km, 4) AS hspan_km, vspan_m, first_ident, mode_ident, span_us, doubtful FROM one JOIN most USING ({SUPER_COLUMNS})")
def agg_09(spark, d):
    rows = coarse(spark, d).where("alt > 0").select("z", "y", "x", "source", "ident", "event_id", "us", F.col("alt").alias("w"), *[F.expr(f"cast({e} as double)").alias(n) for n, e in MEANS.items()])
    return A.super_observation(rows, ["z", "y", "x", "source"], "w", list(MEANS), "ident", "event_id", "us", F.col("raw_conf") < 0.5)


@query("agg_10_weighted_mean_unguarded", f"WITH {ERRORS} SELECT l_orderkey, round(sum(eu * CASE WHEN w > 45 THEN w ELSE 0 END) / nullif(sum(CASE WHEN w > 45 THEN w ELSE 0 END), 0), 6) AS m FROM errors GROUP BY 1")
def agg_10(spark, d):
    w = F.when(F.col("w") > 45, F.col("w")).otherwise(0.0)
    return errors(spark, d).groupBy("l_orderkey").agg(r6(A.weighted_mean(F.col("eu"), w, None)).alias("m"))


@query("agg_11_weight_entropy", f"""
WITH {ERRORS}, p AS (SELECT l_orderkey, greatest(1e-12, w / sum(w) OVER (PARTITION BY l_orderkey)) AS p FROM errors) SELECT l_orderkey, round(-sum(p * ln(p)), 5) + 0.0 AS h FROM p GROUP BY 1""")
def agg_11(spark, d):
    p = F.greatest(F.lit(1e-12), F.col("w") / F.sum("w").over(Window.partitionBy("l_orderkey")))
    return errors(spark, d).select("l_orderkey", p.alias("p")).groupBy("l_orderkey").agg((r6(-F.sum(F.col("p") * F.ln("p")), 5) + 0.0).alias("h"))


@query("agg_12_mode", "WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) SELECT user_id, event_type AS kind FROM r WHERE k = 1")
def agg_12(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(A.mode(F.col("event_type")).alias("kind"))


@query("agg_13_conditional", "SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, round(sum(CASE WHEN value > 50 THEN value ELSE 0 END), 4) AS high FROM events GROUP BY 1")
def agg_13(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), r6(F.sum(F.when(F.col("value") > 50, F.col("value")).otherwise(0.0)), 4).alias("high"))


@query("agg_14_filtered", "SELECT l_orderkey, round(sum(l_quantity) FILTER (WHERE l_linenumber > 1), 4) AS q, max(l_quantity) FILTER (WHERE l_linenumber > 1) AS top FROM lineitem GROUP BY 1")
def agg_14(spark, d):
    later = F.col("l_linenumber") > 1
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(r6(F.sum(F.when(later, F.col("l_quantity"))), 4).alias("q"), F.max(F.when(later, F.col("l_quantity"))).alias("top"))


@query("agg_15_quantile_nearest", "SELECT l_suppkey, list_sort(list(l_quantity))[(round((count(*) - 1) * 0.9) + 1)::INTEGER] AS q90 FROM lineitem GROUP BY 1")
def agg_15(spark, d):
    return Q.quantiles(read(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", {"q90": 0.9}, "nearest")


@query("agg_16_quantile_linear", "SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.95), 6) AS p95, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10 FROM lineitem GROUP BY 1")
def agg_16(spark, d):
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(r6(F.percentile("l_extendedprice", 0.95)).alias("p95"), r6(F.percentile("l_extendedprice", 0.1)).alias("p10"))


@query("agg_17_median", "SELECT l_suppkey, round(median(l_extendedprice), 6) AS m FROM lineitem GROUP BY 1")
def agg_17(spark, d):
    return read(spark, d, "lineitem").groupBy("l_suppkey").agg(r6(F.median("l_extendedprice")).alias("m"))


@query("agg_18_weighted_median", """
WITH c AS (SELECT l_suppkey, l_extendedprice AS v, sum(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey ROWS UNBOUNDED PRECEDING) AS c, sum(l_quantity) OVER (PARTITION BY l_suppkey) / 2 AS h FROM lineitem)
SELECT l_suppkey, min(v) AS m FROM c WHERE c >= h - 1e-9 GROUP BY 1""")
def agg_18(spark, d):
    return Q.weighted_median(read(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity", "m")


@query("agg_19_robust_centre", """
WITH s AS (SELECT l_orderkey, count(*) AS n, median(l_extendedprice) AS m, quantile_cont(l_extendedprice, 0.1) AS lo, quantile_cont(l_extendedprice, 0.9) AS hi FROM lineitem GROUP BY 1)
SELECT l_orderkey, round(CASE WHEN any_value(n) < 5 THEN any_value(m) ELSE 0.5 * any_value(m) + 0.5 * avg(l_extendedprice) END, 6) AS centre FROM lineitem JOIN s USING (l_orderkey) WHERE l_extendedprice BETWEEN lo AND hi GROUP BY 1""")
def agg_19(spark, d):
    return A.robust_centre(read(spark, d, "lineitem"), ["l_orderkey"], "l_extendedprice", "c").select("l_orderkey", r6(F.col("c")).alias("centre"))


@query("agg_20_trimmed_rmse", f"""
WITH {ERRORS}, e AS (SELECT config, sqrt(eu * eu + ev * ev) AS e FROM errors), q AS (SELECT config, quantile_cont(e, 0.95) AS p FROM e GROUP BY 1)
SELECT config, round(sqrt(avg(e * e)), 5) AS rmse FROM e JOIN q USING (config) WHERE e <= p + 1e-9 GROUP BY 1""")
def agg_20(spark, d):
    e = errors(spark, d).select("config", F.sqrt(F.col("eu") * F.col("eu") + F.col("ev") * F.col("ev")).alias("e"))
    p = Q.quantiles(e, ["config"], "e", {"p": 0.95})
    return e.join(F.broadcast(p), "config").where("e <= p + 1e-9").groupBy("config").agg(r6(F.sqrt(F.avg(F.col("e") * F.col("e"))), 5).alias("rmse"))


METRICS = "round(sqrt(avg(eu * eu + ev * ev)), 5) AS rmse, round(avg(sqrt(eu * eu + ev * ev)), 5) AS mae, round(avg(eu), 5) AS bias_u, round(avg(ev), 5) AS bias_v, round(max(sqrt(eu * eu + ev * ev)), 5) AS worst, round(quantile_cont(sqrt(eu * eu + ev * ev), 0.95), 5) AS p95"


@query("agg_21_error_metrics", f"WITH {ERRORS} SELECT config, role, {METRICS} FROM errors GROUP BY config, role")
def agg_21(spark, d):
    plain = {n: c for n, c in A.error_metrics(F.col("eu"), F.col("ev")).items() if n != "p95"}
    m = Q.with_quantiles(errors(spark, d), ["config", "role"], [r6(c, 5).alias(n) for n, c in plain.items()], F.hypot("eu", "ev"), {"p95": 0.95})
    return m.withColumn("p95", r6(F.coalesce("p95", F.lit(0.0)), 5))


@query("agg_22_pooled_rmse", f"""
WITH {ERRORS}, f AS (SELECT l_orderkey, any_value(l_orderkey % 7) AS g, sqrt(avg(eu * eu + ev * ev)) AS rmse, CASE WHEN l_orderkey % 5 = 0 THEN 0 ELSE count(*) END AS n FROM errors GROUP BY l_orderkey)
SELECT g, round(sqrt(sum(rmse * rmse * CASE WHEN n > 0 THEN n ELSE 1 END) / sum(CASE WHEN n > 0 THEN n ELSE 1 END)), 5) AS pairwise, round(sqrt(sum(rmse * rmse * n) FILTER (WHERE n > 0) / sum(n) FILTER (WHERE n > 0)), 5) AS stratified FROM f GROUP BY g""")
def agg_22(spark, d):
    f = errors(spark, d).groupBy("l_orderkey").agg(F.sqrt(F.avg(F.expr("eu * eu + ev * ev"))).alias("rmse"), F.count("*").alias("c"))
    f = f.select((F.col("l_orderkey") % 7).alias("g"), "rmse", F.when(F.col("l_orderkey") % 5 == 0, 0).otherwise(F.col("c")).alias("n"))
    return f.groupBy("g").agg(r6(A.pooled_rmse(F.col("rmse"), F.col("n"), False), 5).alias("pairwise"), r6(A.pooled_rmse(F.col("rmse"), F.col("n"), True), 5).alias("stratified"))


#: Standard deviations of wind components by height, of two published tables (metres below which, m/s; last: above).
SIGMA_A = ((1000, 1.4), (3000, 1.3), (6000, 1.2), (None, 1.1))
SIGMA_B = ((3000, 2.2), (6000, 2.5), (None, 2.8))


def _case(table, column):
    return "CASE " + " ".join(f"WHEN {column} < {top} THEN {v}" for top, v in table[:-1]) + f" ELSE {table[-1][1]} END"


@query("agg_23_component_rmse", f"""
WITH {ERRORS}, e AS (SELECT *, 0.5 * (eu * eu + ev * ev) AS sq, sqrt(eu * eu + ev * ev) AS vec, {_case(SIGMA_A, 'w * 300')}::DOUBLE AS a, {_case(SIGMA_B, 'w * 300')}::DOUBLE AS b FROM errors)
SELECT config, count(*) AS points, round(avg(eu), 6) AS u_bias, round(avg(ev), 6) AS v_bias, round(avg(abs(eu)), 6) AS u_mae, round(avg(abs(ev)), 6) AS v_mae, round(sqrt(avg(eu * eu)), 6) AS u_rmse, round(sqrt(avg(ev * ev)), 6) AS v_rmse,
round(sqrt(avg(sq)), 6) AS component_rmse, round(sqrt(avg(vec * vec)), 6) AS vector_rmse, round(avg(vec), 6) AS vector_mae, round(avg(a), 6) AS sigma_a, round(avg(b), 6) AS sigma_b, round(sqrt(avg(sq)) / avg(a), 6) AS over_a, round(sqrt(avg(sq)) / avg(b), 6) AS over_b,
round(avg(sq / (a * a)), 6) AS chi2_a, round(avg(sq / (b * b)), 6) AS chi2_b, round(quantile_cont(vec, 0.95), 6) AS p95, round(max(vec), 6) AS worst FROM e GROUP BY config""")
def agg_23(spark, d):
    return A.component_summary(errors(spark, d).withColumn("alt", F.col("w") * 300), ["config"], "eu", "ev", "alt", SIGMA_A, SIGMA_B)


@query("agg_24_win_loss_tie", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount - l_tax < -1e-12) AS wins, count(*) FILTER (WHERE l_discount - l_tax > 1e-12) AS losses, count(*) FILTER (WHERE abs(l_discount - l_tax) <= 1e-12) AS ties FROM lineitem GROUP BY 1")
def agg_24(spark, d):
    delta = F.col("l_discount") - F.col("l_tax")
    return read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.count_if(delta < -1e-12).alias("wins"), F.count_if(delta > 1e-12).alias("losses"), F.count_if(F.abs(delta) <= 1e-12).alias("ties"))


#: Frames of an evaluation: counts of hold-out points, their errors, and what the strata ask.
FRAMES = f"""{ERRORS}, frames AS (SELECT l_orderkey AS frame, l_orderkey % 3 AS config, count(*) FILTER (WHERE role = 'O') AS holdout, sqrt(avg(eu * eu + ev * ev) FILTER (WHERE role = 'O')) AS rmse, avg(sqrt(eu * eu + ev * ev)) FILTER (WHERE role = 'O') AS mae, avg(eu) FILTER (WHERE role = 'O') AS bias_u, avg(ev) FILTER (WHERE role = 'O') AS bias_v, count(*) FILTER (WHERE gt_speed > 60) AS strong, count(*) FILTER (WHERE w > 45) AS mismatch FROM errors GROUP BY 1, 2)"""
#: name: (condition, official and with error metrics)
FRAME_STRATA = {
    "all_frames": ("true", False), "holdout_only": ("holdout > 0", True), "no_holdout": ("holdout = 0", False), "single_holdout": ("holdout = 1", True), "multi_holdout": ("holdout >= 2", True),
    "multi_holdout_ge3": ("holdout >= 3", True), "rmse_le6": ("holdout > 0 and rmse <= 6", True), "rmse_gt6": ("holdout > 0 and rmse > 6", True), "strong_wind": ("holdout > 0 and strong > 0", True), "vertical_mismatch": ("holdout > 0 and mismatch > 0", True),
}
_FRAME_METRICS = """round(avg(rmse), 6) AS mean_rmse, round(avg(mae), 6) AS mean_mae, round(quantile_cont(rmse, 0.5), 6) AS p50, round(quantile_cont(rmse, 0.9), 6) AS p90, round(quantile_cont(rmse, 0.95), 6) AS p95, round(quantile_cont(rmse, 0.99), 6) AS p99, round(max(rmse), 6) AS worst, round(avg(bias_u), 6) AS bias_u, round(avg(bias_v), 6) AS bias_v,
round(sqrt(sum(rmse * rmse * holdout) / nullif(sum(holdout) FILTER (WHERE rmse IS NOT NULL), 0)), 6) AS weighted_rmse, round(sum(mae * holdout) / nullif(sum(holdout) FILTER (WHERE mae IS NOT NULL), 0), 6) AS weighted_mae"""
_NO_METRICS = "NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL"


def frames(spark, d):
    held = F.col("role") == "O"
    e2 = F.expr("eu * eu + ev * ev")
    return errors(spark, d).groupBy(F.col("l_orderkey").alias("frame"), (F.col("l_orderkey") % 3).alias("config")).agg(
        F.count_if(held).alias("holdout"), F.sqrt(F.avg(F.when(held, e2))).alias("rmse"), F.avg(F.when(held, F.sqrt(e2))).alias("mae"), F.avg(F.when(held, F.col("eu"))).alias("bias_u"), F.avg(F.when(held, F.col("ev"))).alias("bias_v"),
        F.count_if(F.col("gt_speed") > 60).alias("strong"), F.count_if(F.col("w") > 45).alias("mismatch"),
    )


@query("agg_25_strata", f"WITH {FRAMES}, configs AS (SELECT DISTINCT config FROM frames), " + ", ".join(f"s{k} AS (SELECT config, count(*) AS frames, sum(holdout)::BIGINT AS points, {_FRAME_METRICS if official else ', '.join('NULL::DOUBLE AS ' + c for c in ('mean_rmse', 'mean_mae', 'p50', 'p90', 'p95', 'p99', 'worst', 'bias_u', 'bias_v', 'weighted_rmse', 'weighted_mae'))} FROM frames WHERE {rule} GROUP BY config)" for k, (rule, official) in enumerate(FRAME_STRATA.values())) + " "
       + " UNION ALL ".join(f"SELECT configs.config, '{name}' AS stratum, {str(official).lower()} AS official, coalesce(frames, 0) AS frames, coalesce(points, 0) AS points, mean_rmse, mean_mae, p50, p90, p95, p99, worst, bias_u, bias_v, weighted_rmse, weighted_mae FROM configs LEFT JOIN s{k} ON s{k}.config = configs.config" for k, (name, (_, official)) in enumerate(FRAME_STRATA.items())))
def agg_25(spark, d):
    return A.frame_strata(frames(spark, d), "config", FRAME_STRATA)


#: the nineteen settings that name a configuration, as expressions of its number
SETTINGS = {f"s{k:02d}": f"(l_suppkey % 10) {op} {c}" for k, (op, c) in enumerate([("%", 2), ("%", 3), ("%", 4), ("%", 5), ("*", 2), ("*", 3), ("*", 5), ("+", 1), ("+", 7), ("-", 3), ("*", 10), ("%", 6), ("%", 7), ("%", 8), ("%", 9), ("+", 100), ("*", 100), ("-", 1), ("+", 0)])}


@query("agg_26_many_keys", f"""
WITH f AS (SELECT l_orderkey AS frame, {', '.join(f'{e} AS {n}' for n, e in SETTINGS.items())}, count(*) FILTER (WHERE l_linestatus = 'O') AS holdout, sqrt(avg(l_discount * l_discount * 100 + l_tax * l_tax * 100)) AS rmse, max(l_quantity) AS support FROM lineitem GROUP BY 1, l_suppkey % 10)
SELECT {', '.join(SETTINGS)}, count(*) AS frames, count(*) FILTER (WHERE holdout > 0) AS official, sum(holdout)::BIGINT AS points, round(avg(rmse) FILTER (WHERE holdout > 0), 6) AS mean_rmse, round(max(rmse) FILTER (WHERE holdout > 0), 6) AS worst, round(sqrt(sum(rmse * rmse * holdout) / nullif(sum(holdout), 0)), 6) AS weighted_rmse, round(avg(support), 6) AS support FROM f GROUP BY ALL""")
def agg_26(spark, d):
    li = read(spark, d, "lineitem")
    f = li.groupBy(F.col("l_orderkey").alias("frame"), (F.col("l_suppkey") % 10).alias("c")).agg(F.count_if(F.col("l_linestatus") == "O").alias("holdout"), F.sqrt(F.avg(F.expr("l_discount * l_discount * 100 + l_tax * l_tax * 100"))).alias("rmse"), F.max("l_quantity").alias("support"))
    f = f.select("*", *[F.expr(e.replace("(l_suppkey % 10)", "c")).alias(n) for n, e in SETTINGS.items()])
    return A.by_configuration(f, list(SETTINGS), "rmse", "holdout", "support")


POINT_STRATA = {
    "all": "true", "single_line": "lines = 1", "ge2": "lines >= 2", "ge3": "lines >= 3", "alt_9_12km": "alt >= 9000 and alt < 12000", "alt_12km_plus": "alt >= 12000", "alt_12km_plus_single": "alt >= 12000 and lines = 1",
    "context_only": "role = 'F'", "alt_12km_plus_context_only": "alt >= 12000 and role = 'F'", "single_context_only": "lines = 1 and role = 'F'", "current": "role = 'O'", "far": "l_linenumber > 4", "role_gap": "gt_speed >= 30",
    "role_conflict": "config = 'R'", "review": "w > 48", "no_review": "not (w > 48)", "high_error": "sqrt(eu * eu + ev * ev) >= 1", "extreme_truth": "gt_speed >= 80", "extreme_config": "config = 'N' and w >= 40", "calm": "gt_speed < 5",
}
POINTS = f"{ERRORS}, points AS (SELECT *, w * 300 AS alt, count(*) OVER (PARTITION BY l_orderkey) AS lines FROM errors)"


@query("agg_27_tail_metrics", f"WITH {POINTS}, total AS (SELECT sum(eu * eu + ev * ev) AS sse FROM errors), s AS (" + " UNION ALL ".join(f"SELECT *, '{n}' AS stratum FROM points WHERE {r}" for n, r in POINT_STRATA.items()) + """), e AS (SELECT *, sqrt(eu * eu + ev * ev) AS e FROM s)
SELECT stratum, count(*) AS points, count(DISTINCT l_orderkey) AS frames, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS mae, round(quantile_cont(e, 0.5), 6) AS p50, round(quantile_cont(e, 0.9), 6) AS p90, round(quantile_cont(e, 0.95), 6) AS p95, round(quantile_cont(e, 0.99), 6) AS p99, round(max(e), 6) AS worst,
round(sum(e * e) / any_value(sse), 6) AS sse_share, round(avg(alt), 4) AS mean_alt, round(avg(gt_speed), 4) AS mean_speed, round(avg(l_linenumber), 6) AS mean_distance FROM e, total GROUP BY stratum""")
def agg_27(spark, d):
    p = errors(spark, d).withColumn("alt", F.col("w") * 300).withColumn("lines", F.count("*").over(Window.partitionBy("l_orderkey")))
    return A.tail_metrics(p, "l_orderkey", "eu", "ev", {n: F.expr(r) for n, r in POINT_STRATA.items()}, {"mean_alt": ("alt", 4), "mean_speed": ("gt_speed", 4), "mean_distance": ("l_linenumber", 6)})


@query("agg_28_rule_recall", f"""
WITH {ERRORS}, e AS (SELECT config, w > 30 AS flagged, sqrt(eu * eu + ev * ev) > 8 AS high, eu * eu + ev * ev AS sse FROM errors)
SELECT config, round(count(*) FILTER (WHERE flagged AND high) / nullif(count(*) FILTER (WHERE high), 0)::DOUBLE, 6) AS recall, round(count(*) FILTER (WHERE flagged AND high) / nullif(count(*) FILTER (WHERE flagged), 0)::DOUBLE, 6) AS precision, round(sum(CASE WHEN flagged THEN sse ELSE 0 END) / sum(sse), 5) AS sse_share FROM e GROUP BY config""")
def agg_28(spark, d):
    e = errors(spark, d).select("config", (F.col("w") > 30).alias("flagged"), (F.sqrt(F.expr("eu * eu + ev * ev")) > 8).alias("high"), F.expr("eu * eu + ev * ev").alias("sse"))
    both = F.count_if(F.col("flagged") & F.col("high"))
    return e.groupBy("config").agg(r6(F.try_divide(both, F.count_if("high"))).alias("recall"), r6(F.try_divide(both, F.count_if("flagged"))).alias("precision"), r6(F.sum(F.when(F.col("flagged"), F.col("sse")).otherwise(0.0)) / F.sum("sse"), 5).alias("sse_share"))


@query("agg_29_rate_lift", """
WITH b AS (SELECT 'quantity' AS feature, floor(l_quantity / 10)::BIGINT AS bucket, l_returnflag = 'R' AS hit FROM lineitem UNION ALL SELECT 'line', l_linenumber::BIGINT, l_returnflag = 'R' FROM lineitem),
t AS (SELECT avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS r FROM lineitem)
SELECT feature, bucket, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) / any_value(r), 5) AS lift, count(*) AS n FROM b, t GROUP BY 1, 2""")
def agg_29(spark, d):
    li = read(spark, d, "lineitem").select(F.floor(F.col("l_quantity") / 10).alias("quantity"), F.col("l_linenumber").cast("long").alias("line"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("hit"))
    rate = li.agg(F.avg("hit").alias("r"))  # one row
    long = li.unpivot("hit", ["quantity", "line"], "feature", "bucket").join(F.broadcast(rate))
    return long.groupBy("feature", "bucket").agg(r6(F.avg("hit") / F.first("r"), 5).alias("lift"), F.count("*").alias("n"))


@query("agg_30_score_buckets", f"""
WITH {ERRORS}, e AS (SELECT floor(gt_speed / 10)::BIGINT AS bucket, sqrt(eu * eu + ev * ev) AS e, sqrt(eu * eu + ev * ev) >= 1 AS high FROM errors), b AS (SELECT bucket, count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(e) AS mae, quantile_cont(e, 0.5) AS p50, quantile_cont(e, 0.95) AS p95, quantile_cont(e, 0.99) AS p99, count(*) FILTER (WHERE high) AS high, sum(e * e) AS sse FROM e GROUP BY 1)
SELECT bucket, n, round(n / sum(n) OVER ()::DOUBLE, 6) AS share, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(p50, 6) AS p50, round(p95, 6) AS p95, round(p99, 6) AS p99, high, round(high / n::DOUBLE, 6) AS high_rate, round(high / sum(high) OVER ()::DOUBLE, 6) AS high_recall, round(sse / sum(sse) OVER (), 6) AS sse_share,
(sum(n) OVER w)::BIGINT AS n_above, round(sum(high) OVER w / sum(high) OVER ()::DOUBLE, 6) AS recall_above, round(sum(sse) OVER w / sum(sse) OVER (), 6) AS sse_above FROM b WINDOW w AS (ORDER BY bucket DESC ROWS UNBOUNDED PRECEDING)""")
def agg_30(spark, d):
    e = errors(spark, d).select(F.floor(F.col("gt_speed") / 10).alias("bucket"), F.sqrt(F.expr("eu * eu + ev * ev")).alias("e"))
    return A.score_buckets(e, "bucket", "e", 1.0)


@query("agg_31_top_examples", f"WITH {ERRORS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(eu * eu + ev * ev), 6) AS e FROM errors ORDER BY sqrt(eu * eu + ev * ev) DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 25")
def agg_31(spark, d):
    e = errors(spark, d).withColumn("s", F.sqrt(F.expr("eu * eu + ev * ev")))
    return e.orderBy(F.col("s").desc(), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(25).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(F.col("s")).alias("e"))


@query("agg_32_count_map", "SELECT coalesce(CASE WHEN event_id % 4 <> 0 THEN event_type END, 'null') AS value, count(*) AS n FROM events GROUP BY 1")
def agg_32(spark, d):
    return A.count_map(read(spark, d, "events").select(F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("t")), "t")


@query("agg_33_distinct_with_null", "SELECT user_id, count(DISTINCT CASE WHEN event_id % 4 <> 0 THEN event_type END) + max(CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) AS n FROM events GROUP BY 1")
def agg_33(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(A.distinct_with_null(F.when(F.col("event_id") % 4 != 0, F.col("event_type"))).alias("n"))


@query("agg_34_lists", "SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), '|') AS statuses, array_to_string(list_sort(list(o_orderkey)), '|') AS keys FROM orders GROUP BY 1")
def agg_34(spark, d):
    return read(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), "|").alias("statuses"), F.array_join(F.sort_array(F.collect_list("o_orderkey")).cast("array<string>"), "|").alias("keys"))


PEARSON = {"quantity": "l_quantity", "price": "l_extendedprice", "discount": "l_discount", "tax": "l_tax", "line": "l_linenumber::DOUBLE", "fixed": "1.0::DOUBLE"}


@query("agg_35_correlations", " UNION ALL ".join(f"SELECT l_returnflag, '{a}' AS a, '{b}' AS b, " + ("NULL::DOUBLE" if "fixed" in (a, b) else f"round(corr({x}, {y}), 6)") + " AS r FROM lineitem GROUP BY l_returnflag" for a, x in PEARSON.items() for b, y in PEARSON.items()))
def agg_35(spark, d):
    li = read(spark, d, "lineitem").select("l_returnflag", *[F.expr(e.replace("::DOUBLE", "")).cast("double").alias(n) for n, e in PEARSON.items()])
    return A.correlations(li, ["l_returnflag"], list(PEARSON))


@query("agg_36_calibration_error", f"""
WITH {SCORED}, b AS (SELECT least(floor(p * 15), 14) AS b, count(*) AS n, avg(p) AS p, avg(y) AS y FROM scored GROUP BY 1) SELECT round(sum(n * abs(p - y)) / sum(n), 6) AS ece FROM b""")
def agg_36(spark, d):
    return A.calibration_error(scored(spark, d), [], "p", "y", 15).select(r6(F.col("ece")).alias("ece"))


#: Candidate bridges: residuals, Mahalanobis distances, a calibrated chance and the truth.
LINKS = "l AS (SELECT l_discount * 50 AS km, l_quantity * 40 AS climb, l_linenumber * 200 AS gap, l_discount * 20 AS ahead, l_tax * 20 AS back, l_quantity / 20 AS high, 1 / (1 + exp(l_discount * 30 - 2)) AS chance, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem)"
FORMULAS = {
    "none": "0.0", "physical": "CASE WHEN km <= 3 AND climb <= 1000 AND gap <= 900 THEN 1.0 ELSE 0.0 END", "forward": "exp(-0.5 * ahead)", "both_ways": "exp(-0.25 * (ahead + back))",
    "covariance": "exp(-0.20 * (ahead + back + high))", "calibrated": "chance",
}


@query("agg_37_brier", f"WITH {LINKS}, p AS (" + " UNION ALL ".join(f"SELECT '{n}' AS model, ({e})::DOUBLE AS p, y FROM l" for n, e in FORMULAS.items()) + "), b AS (SELECT model, least(floor(p * 15), 14) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my, sum(pow(p - y, 2)) AS s FROM p GROUP BY 1, 2) SELECT model, round(sum(s) / sum(n), 6) AS brier, round(sum(n * abs(mp - my)) / sum(n), 6) AS ece FROM b GROUP BY 1")
def agg_37(spark, d):
    li = read(spark, d, "lineitem").selectExpr("l_discount * 50 as km", "l_quantity * 40 as climb", "l_linenumber * 200 as gap", "l_discount * 20 as ahead", "l_tax * 20 as back", "l_quantity / 20 as high", "1 / (1 + exp(l_discount * 30 - 2)) as chance", "if(l_returnflag = 'R', 1D, 0D) as y")
    return A.brier_scores(li, A.baseline_chances("km", "climb", "gap", "ahead", "back", "high", "chance"), "y", 15)


@query("agg_38_robust_sigma", f"WITH {ERRORS} SELECT config, role, round(least(6.0, greatest(1.0, 0.5 * sqrt(avg(eu * eu)) + 0.5 * quantile_cont(abs(eu), 0.75))), 5) AS sigma FROM errors GROUP BY config, role")
def agg_38(spark, d):
    return A.robust_sigmas(errors(spark, d), ["config", "role"], "eu", 1.0, 6.0, 0).select("config", "role", r6(F.col("sigma"), 5).alias("sigma"))


SIGMA_BINS = {"bin": ["config", "role", "band", "kernel"], "config": ["config"], "role": ["role"], "band": ["band"], "kernel": ["kernel"]}


@query("agg_39_sigma_map", f"WITH {ERRORS}, b AS (SELECT config, role, l_linenumber::VARCHAR AS band, (l_suppkey % 4)::VARCHAR AS kernel, sqrt(eu * eu + ev * ev) AS x FROM errors) " + " UNION ALL ".join(f"SELECT '{kind}' AS kind, {' || chr(124) || '.join(keys)} AS key, count(*) AS n, CASE WHEN count(*) >= 200 THEN round(least(6.0, greatest(0.1, 0.5 * sqrt(avg(x * x)) + 0.5 * quantile_cont(abs(x), 0.75))), 6) END AS sigma FROM b GROUP BY {', '.join(keys)}" for kind, keys in SIGMA_BINS.items()))
def agg_39(spark, d):
    b = errors(spark, d).select("config", "role", F.col("l_linenumber").cast("string").alias("band"), (F.col("l_suppkey") % 4).cast("string").alias("kernel"), F.sqrt(F.expr("eu * eu + ev * ev")).alias("x"))
    out = None
    for kind, keys in SIGMA_BINS.items():
        part = A.robust_sigmas(b, keys, "x", 0.1, 6.0, 200).select(F.lit(kind).alias("kind"), F.concat_ws("|", *keys).alias("key"), "n", r6(F.col("sigma")).alias("sigma"))
        out = part if out is None else out.unionByName(part)
    return out


AGG40 = f"{CCELLS}, v AS (SELECT z, y, x, avg(speed) AS s, count(*) AS n FROM cells GROUP BY z, y, x)"


@query("agg_40_leave_one_out", f"""
WITH {AGG40}, j AS (SELECT a.z, a.y, a.x, a.s, sum(b.s * b.n) / sum(b.n) AS m, count(*) AS k FROM v a JOIN v b ON abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND NOT (a.z = b.z AND a.y = b.y AND a.x = b.x) GROUP BY a.z, a.y, a.x, a.s)
SELECT z, y, x, round(s - m, 4) AS departure, k FROM j WHERE k >= 3""")
def agg_40(spark, d):
    v = coarse(spark, d).groupBy("z", "y", "x").agg(F.avg("speed").alias("s"), F.count("*").alias("n"))
    j = offset_join(v, v, [], box(1, 1, 1))
    j = j.groupBy("z", "y", "x", "s").agg(A.weighted_mean(F.col("n_s"), F.col("n_n")).alias("m"), F.count("*").alias("k")).where("k >= 3")
    return j.select("z", "y", "x", r6(F.col("s") - F.col("m"), 4).alias("departure"), "k")


@query("agg_41_influence", f"WITH {ERRORS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(9.0 / (9.0 + pow(1 + w / 10, 2)), 6) AS gain, round(9.0 * (1 - 9.0 / (9.0 + pow(1 + w / 10, 2))), 6) AS variance FROM errors")
def agg_41(spark, d):
    gain = 9.0 / (9.0 + F.pow(1 + F.col("w") / 10, 2))
    return errors(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(gain).alias("gain"), r6(9.0 * (1 - gain)).alias("variance"))


@query("agg_42_summary", "SELECT l_returnflag, min(l_quantity) AS q_min, round(quantile_cont(l_quantity, 0.1), 6) AS q_q10, round(quantile_cont(l_quantity, 0.5), 6) AS q_q50, round(quantile_cont(l_quantity, 0.9), 6) AS q_q90, round(quantile_cont(l_quantity, 0.99), 6) AS q_q99, max(l_quantity) AS q_max, count(*) FILTER (WHERE l_quantity IS NULL) AS q_nulls FROM lineitem GROUP BY 1")
def agg_42(spark, d):
    q = F.col("l_quantity")
    m = Q.with_quantiles(read(spark, d, "lineitem"), ["l_returnflag"], [F.min(q).alias("q_min"), F.max(q).alias("q_max"), F.count_if(q.isNull()).alias("q_nulls")], q, {"q_q10": 0.1, "q_q50": 0.5, "q_q90": 0.9, "q_q99": 0.99})
    return m.select("l_returnflag", "q_min", *[r6(F.col(c)).alias(c) for c in ("q_q10", "q_q50", "q_q90", "q_q99")], "q_max", "q_nulls")


@query("agg_43_frame_scale", f"""
WITH {OBS}, f AS (SELECT date_trunc('day', ts) AS frame, event_id, speed FROM obs), s AS (SELECT frame, greatest(1e-6, quantile_cont(speed, 0.9) FILTER (WHERE speed > 0)) AS p90 FROM f GROUP BY 1)
SELECT event_id, round(least(1.0, speed / p90), 6) AS conf FROM f JOIN s USING (frame)""")
def agg_43(spark, d):
    f = obs(spark, d).select(F.date_trunc("day", "ts").alias("frame"), "event_id", "speed")
    s = f.groupBy("frame").agg(F.greatest(F.lit(1e-6), F.percentile(F.when(F.col("speed") > 0, F.col("speed")), 0.9)).alias("p90"))
    return f.join(s, "frame").select("event_id", r6(F.least(F.lit(1.0), F.col("speed") / F.col("p90"))).alias("conf"))


@query("agg_44_top_then_mean", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem) SELECT l_suppkey, round(avg(l_extendedprice), 4) AS m, count(*) AS n FROM r WHERE k <= 5 GROUP BY 1")
def agg_44(spark, d):
    t = top_k(read(spark, d, "lineitem"), ["l_suppkey"], [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber", "l_partkey"], 5)
    return t.groupBy("l_suppkey").agg(r6(F.avg("l_extendedprice"), 4).alias("m"), F.count("*").alias("n"))


@query("agg_45_partial_final", "SELECT l_returnflag, count(*) AS n, round(sum(l_extendedprice), 2) AS s FROM lineitem GROUP BY 1")
def agg_45(spark, d):
    shard = read(spark, d, "lineitem").groupBy("l_returnflag", (F.col("l_orderkey") % 8).alias("shard")).agg(F.count("*").alias("n"), F.sum("l_extendedprice").alias("s"))
    return shard.groupBy("l_returnflag").agg(F.sum("n").alias("n"), F.round(F.sum("s"), 2).alias("s"))


@query("agg_46_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def agg_46(spark, d):
    return read(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))
