"""Tracks, alignment, calibration, gates and evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windgrid.functions import clean, geo, weights
from windgrid.operators import aggregates as A
from windgrid.operators import corruption, gates, smoothing, uncertainty
from windgrid.operators import sequences as S
from windgrid.operators import tracks as T
from windgrid.operators.calibration import Logit, Sharpness
from windgrid.operators.nearest import nearest_on_sphere
from windgrid.operators.ordering import global_row_number, top_k
from windgrid.plans.base import ERRORS, HAVERSINE, OBS, SCORED, errors, obs, query, r6, read, scaled_round, scored
from windgrid.plans.tracks import TRACK_SQL, legs

ENDS = f"""{TRACK_SQL}, ends AS (SELECT ident, leg, count(*) AS n, min(us) / 1e6::DOUBLE AS a, max(us) / 1e6::DOUBLE AS b, arg_min(lat, us) AS slat, arg_min(lon, us) AS slon, arg_min(alt, us) AS salt, arg_max(lat, us) AS elat, arg_max(lon, us) AS elon, arg_max(alt, us) AS ealt FROM legs GROUP BY 1, 2),
hops AS (""" + " UNION ALL ".join(f"SELECT ident, leg, {k} AS hop, b, elat, elon, ealt, lead(leg, {k}) OVER w AS to_leg, lead(a, {k}) OVER w - b AS gap, lead(slat, {k}) OVER w AS nlat, lead(slon, {k}) OVER w AS nlon, lead(salt, {k}) OVER w AS nalt FROM ends WINDOW w AS (PARTITION BY ident ORDER BY a, leg)" for k in (1, 2, 3)) + f"""),
e0 AS (SELECT *, {HAVERSINE.format(a='e', b='n')} AS km, abs(nalt - ealt) AS climb FROM hops WHERE gap BETWEEN 1 AND 172800),
edges AS (SELECT *, km * 1000 / gap AS speed, km / (3 + 0.03 * gap) AS m, climb / (500 + 3 * gap) AS malt FROM e0),
scored_edges AS (SELECT *, exp(-0.55 * m - 0.35 * malt - 0.004 * speed - 0.001 * gap / 60) AS prior, m <= 12 AND malt <= 12 AND speed <= 420 AS physical FROM edges)"""


def ends(spark, d):
    return T.leg_ends(legs(spark, d))


#: the score of a point stands in for its consistency with its neighbours
SMOOTH_SQL = f"""{TRACK_SQL}, mid AS (SELECT ident, leg, median(lat) AS lat0, median(lon) AS lon0, 111.32 * greatest(0.1, cos(radians(median(lat)))) AS wide FROM legs GROUP BY 1, 2),
pts AS (SELECT l.ident, l.leg, event_id, us / 1e6::DOUBLE AS t, row_number() OVER w AS i, count(*) OVER (PARTITION BY l.ident, l.leg) AS n, (lon - lon0) * wide AS east, (lat - lat0) * 111.32 AS north, alt, wind_speed / 200 AS doubt, lat0, lon0, wide FROM legs l JOIN mid m ON l.ident = m.ident AND l.leg = m.leg WINDOW w AS (PARTITION BY l.ident, l.leg ORDER BY us, event_id)),
axes AS (SELECT 'e' AS axis, ident, leg, i, n, t, east AS x, pow(0.025 + 0.2 * doubt, 2) AS r, 2e-6::DOUBLE AS q FROM pts UNION ALL SELECT 'n', ident, leg, i, n, t, north, pow(0.025 + 0.2 * doubt, 2), 2e-6::DOUBLE FROM pts UNION ALL SELECT 'a', ident, leg, i, n, t, alt, pow(20 + 180 * doubt, 2), 0.08::DOUBLE FROM pts),
ways AS (SELECT 1 AS way, axis, ident, leg, i AS k, i, t, x, greatest(1e-6, r) AS r, q FROM axes UNION ALL SELECT -1, axis, ident, leg, n - i + 1, i, -t, x, greatest(1e-6, r), q FROM axes),
f AS (SELECT way, axis, ident, leg, k, i, t, x AS p, 0.0::DOUBLE AS v, r AS pv, greatest(1e-6, q) AS vv FROM ways WHERE k = 1
UNION ALL SELECT way, axis, ident, leg, k, i, t, p + g * (x - p), v + least(0.8, 2 * g / dt) * (x - p), greatest(1e-6, (1 - g) * pv), greatest(1e-8, (1 - least(g, 0.6)) * vv + q)
FROM (SELECT *, pv / (pv + r) AS g FROM (SELECT d.way, d.axis, d.ident, d.leg, d.k, d.i, d.t, d.x, d.r, d.q, greatest(1.0, d.t - f.t) AS dt, f.p + f.v * greatest(1.0, d.t - f.t) AS p, f.v, f.vv, f.pv + pow(greatest(1.0, d.t - f.t), 2) * f.vv + d.q * greatest(1.0, d.t - f.t) AS pv
FROM f JOIN ways d ON d.way = f.way AND d.axis = f.axis AND d.ident = f.ident AND d.leg = f.leg AND d.k = f.k + 1))),
merged AS (SELECT a.axis, a.ident, a.leg, a.i, (a.p / a.pv + b.p / b.pv) / (1 / a.pv + 1 / b.pv) AS p, (a.v / a.pv + b.v / b.pv) / (1 / a.pv + 1 / b.pv) AS v, 1 / (1 / a.pv + 1 / b.pv) AS s FROM f a JOIN f b ON a.axis = b.axis AND a.ident = b.ident AND a.leg = b.leg AND a.i = b.i AND a.way = 1 AND b.way = -1),
states AS (SELECT p.ident, p.leg, p.event_id, p.t, p.i, p.n, lat0 + n_.p / 111.32 AS lat, lon0 + e_.p / wide AS lon, a_.p AS alt, e_.v AS v_east, n_.v AS v_north, a_.v AS v_up, e_.s + n_.s AS var_across, a_.s AS var_alt
FROM pts p JOIN merged e_ ON e_.axis = 'e' AND e_.ident = p.ident AND e_.leg = p.leg AND e_.i = p.i JOIN merged n_ ON n_.axis = 'n' AND n_.ident = p.ident AND n_.leg = p.leg AND n_.i = p.i JOIN merged a_ ON a_.axis = 'a' AND a_.ident = p.ident AND a_.leg = p.leg AND a_.i = p.i)"""


def smoothed_legs(spark, d):
    o = legs(spark, d).select("ident", "leg", "event_id", "us", (F.col("us") / 1e6).alias("t"), "lat", "lon", "alt", (1 - F.col("wind_speed") / 200).alias("score"))
    return smoothing.smoothed_tracklets(o, ["ident", "leg"], ["us", "event_id"], "t", "lat", "lon", "alt", "score")


@query("seq_01_smoother", f"WITH RECURSIVE {SMOOTH_SQL} SELECT event_id, round(lat, 6) AS lat, round(lon, 6) AS lon, round(alt, 3) AS alt, round(v_east, 6) AS v_east, round(v_north, 6) AS v_north, round(v_up, 5) AS v_up, round(sqrt(var_across), 5) AS radius_km FROM states")
def seq_01(spark, d):
    s = smoothed_legs(spark, d)
    return s.select("event_id", r6(F.col("s_lat")).alias("lat"), r6(F.col("s_lon")).alias("lon"), r6(F.col("s_alt"), 3).alias("alt"), r6(F.col("v_east")).alias("v_east"), r6(F.col("v_north")).alias("v_north"), r6(F.col("v_up"), 5).alias("v_up"), r6(F.col("radius_km"), 5).alias("radius_km"))


MODE_SQL = "least(1.0, abs((((heading - prev_heading + 180) % 360) + 360) % 360 - 180) / 90) AS turn, least(1.0, abs(alt - prev_alt) / 3000) AS vert"


@query("seq_02_mode_probabilities", f"""
WITH {TRACK_SQL}, m AS (SELECT event_id, greatest(0.01, {MODE_SQL.replace(' AS turn, ', ') AS turn, greatest(0.01, ').replace(' AS vert', ') AS vert')} FROM legs WHERE prev_us IS NOT NULL), l AS (SELECT *, greatest(0.01, 1 - greatest(turn, vert)) AS level FROM m)
SELECT event_id, round(turn / (turn + vert + level), 8) AS turn, round(vert / (turn + vert + level), 8) AS vert, round(level / (turn + vert + level), 8) AS level FROM l""")
def seq_02(spark, d):
    s = legs(spark, d).where("prev_us is not null")
    turn = F.greatest(F.lit(0.01), F.least(F.lit(1.0), geo.angle_difference(F.col("heading"), F.col("prev_heading")) / 90))
    vert = F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.abs(F.col("alt") - F.col("prev_alt")) / 3000))
    s = s.select("event_id", turn.alias("t"), vert.alias("v")).withColumn("l", F.greatest(F.lit(0.01), 1 - F.greatest("t", "v")))
    total = F.col("t") + F.col("v") + F.col("l")
    return s.select("event_id", *[r6(F.col(c[0]) / total, 8).alias(c) for c in ("turn", "vert", "level")])


@query("seq_03_tracklet_tiers", f"WITH {TRACK_SQL}, t AS (SELECT ident, leg, CASE WHEN count(*) >= 8 THEN 'T0' WHEN count(*) >= 3 THEN 'T1' WHEN count(*) = 2 THEN 'T2' ELSE 'T3' END AS tier FROM legs GROUP BY 1, 2) SELECT tier, count(*) AS n FROM t GROUP BY 1")
def seq_03(spark, d):
    return T.tracklets(legs(spark, d)).groupBy("tier").agg(F.count("*").alias("n"))


BRIDGES = f"""{SMOOTH_SQL}, tips AS (SELECT a.ident, a.leg, a.t AS a, a.lat AS slat, a.lon AS slon, a.alt AS salt, a.v_east AS sve, a.v_north AS svn, a.var_across AS svar, a.var_alt AS svar_alt, b.t AS b, b.lat AS elat, b.lon AS elon, b.alt AS ealt, b.v_east AS eve, b.v_north AS evn, b.v_up AS evu, b.var_across AS evar, b.var_alt AS evar_alt FROM states a JOIN states b ON a.ident = b.ident AND a.leg = b.leg AND a.i = 1 AND b.i = b.n),
skips AS (""" + " UNION ALL ".join(f"SELECT *, {k} AS hop, lead(leg, {k}) OVER w AS to_leg, lead(a, {k}) OVER w - b AS gap, " + ", ".join(f"lead({c}, {k}) OVER w AS t{c}" for c in ("slat", "slon", "salt", "sve", "svn", "svar", "svar_alt")) + " FROM tips WINDOW w AS (PARTITION BY ident ORDER BY a, leg)" for k in (1, 2, 3)) + f"""),
aimed AS (SELECT *, elat + evn * gap / 111.32 AS plat, elon + eve * gap / (111.32 * least(1.0, greatest(0.1, cos(radians(elat))))) AS plon, abs(tsalt - (ealt + evu * gap)) AS m, sqrt(pow(tsve - eve, 2) + pow(tsvn - evn, 2)) * 1000 AS turn FROM skips WHERE gap BETWEEN 1 AND 172800),
missed AS (SELECT *, {HAVERSINE.format(a='p', b='ts')} AS km FROM aimed),
bridges AS (SELECT *, km / greatest(0.02, sqrt(evar + tsvar + pow(0.0025 * gap, 2))) AS far, m / greatest(20.0, sqrt(evar_alt + tsvar_alt + pow(1.5 * gap, 2))) AS high FROM missed)"""


@query("seq_04_candidate_edges", f"WITH RECURSIVE {BRIDGES} SELECT ident, leg::BIGINT AS leg, to_leg::BIGINT AS to_leg, hop, round(km, 3) AS km, round(far, 4) AS far, round(high, 4) AS high, round(turn, 4) AS turn, round(least(1.0, exp(-0.55 * far - 0.35 * high - 0.004 * turn - 0.001 * gap)), 6) AS prior, far <= 12 AND high <= 12 AND turn <= 180 AND km <= 3 + 0.03 * gap AS physical FROM bridges")
def seq_04(spark, d):
    e = smoothing.end_states(smoothed_legs(spark, d), ["ident", "leg"], F.struct("us", "event_id"))
    e = smoothing.bridge_edges(e, ["ident"], "leg", 172800.0)
    return e.select("ident", "leg", "to_leg", "hop", r6(F.col("km"), 3).alias("km"), *[r6(F.col(c), 4).alias(c) for c in ("far", "high", "turn")], r6(F.col("prior")).alias("prior"), "physical")


@query("seq_05_paths", f"""
WITH {ENDS}, r AS (SELECT *, row_number() OVER (PARTITION BY ident, leg ORDER BY prior DESC, to_leg) AS r FROM scored_edges WHERE physical)
SELECT ident, leg::BIGINT AS first_leg, NULL::BIGINT AS second_leg, 1.0::DOUBLE AS score FROM ends UNION ALL SELECT ident, leg::BIGINT, to_leg::BIGINT, round(prior, 6) FROM r WHERE r <= 2""")
def seq_05(spark, d):
    e = ends(spark, d)
    return T.paths(e, T.edges(e, 172800.0, 12.0), 2).withColumn("score", r6(F.col("score")))


@query("seq_06_leg_quality", f"""
WITH {TRACK_SQL}, e AS (SELECT ident, leg, us, event_id, alt, brk, CASE WHEN event_id % 7 > 0 THEN 1 ELSE 0 END AS tail, CASE WHEN event_id % 5 > 0 THEN 1 ELSE 0 END AS flight, CASE WHEN brk = 0 THEN alt - prev_alt END AS step, CASE WHEN brk = 0 THEN dt END AS gap, CASE WHEN brk = 0 THEN km END AS way FROM legs),
q AS (SELECT ident, leg, count(*) AS n, (max(us) - min(us)) / 1e6 AS seconds, coalesce(sum(way), 0) AS km, arg_max(alt, (us, event_id)) - arg_min(alt, (us, event_id)) AS change, max(alt) - min(alt) AS rng, count(*) FILTER (WHERE gap <= 0) AS back, count(*) FILTER (WHERE way * 1000 / gap > 40) AS fast, count(*) FILTER (WHERE way > 2000) AS jumps, count(*) FILTER (WHERE gap > 43200) AS gaps,
count(*) FILTER (WHERE abs(step) / gap > 0.2) AS steep, count(*) FILTER (WHERE tail = 0 AND flight = 0) AS unnamed, max(tail) + max(flight) AS named, count(*) FILTER (WHERE step > 50) AS up, count(*) FILTER (WHERE step < -50) AS down, quantile_cont(gap, 0.9) AS gq0, coalesce(max(gap), 0) AS gm, quantile_cont(way * 1000 / gap, 0.99) AS sq0 FROM e GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN change > 500 THEN 'ASC' WHEN change < -500 THEN 'DES' ELSE 'LVR' END AS phase, fast / greatest(1, n - 1)::DOUBLE AS fr, coalesce(gq0, 999999) AS gq, coalesce(sq0, 0) AS sq FROM q),
f AS (SELECT *, (phase = 'ASC' AND down / greatest(1, n - 1)::DOUBLE > 0.35) OR (phase = 'DES' AND up / greatest(1, n - 1)::DOUBLE > 0.35) OR (phase = 'LVR' AND rng > 1800) AS mixed FROM p),
s AS (SELECT *, CASE WHEN back > 0 OR gm > 72000 THEN 1 WHEN gq <= 21600 AND gm <= 43200 THEN 3 WHEN gq <= 43200 AND gm <= 43200 THEN 2 ELSE 1 END AS s1, CASE WHEN jumps > 0 OR fr > 0.02 THEN 1 WHEN fast = 0 AND sq <= 30 THEN 3 WHEN sq <= 40 THEN 2 ELSE 1 END AS s2, CASE named WHEN 2 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS s3,
CASE WHEN n >= 4 AND seconds >= 3600 AND gq <= 21600 THEN 3 WHEN n >= 2 AND seconds >= 600 AND gq <= 43200 THEN 2 ELSE 1 END AS s4, CASE WHEN mixed THEN 1 WHEN phase = 'LVR' AND rng > 1000 THEN 2 ELSE 3 END AS s5 FROM f),
g AS (SELECT *, least(s1, s2, s3, s4, s5) AS score, back > 0 OR steep > 0 OR unnamed > 0 OR n < 2 OR seconds < 600 OR jumps > 0 OR mixed OR fr > 0.02 AS hard, (back > 0)::INT + (fast > 0)::INT + (jumps > 0)::INT + (gaps > 0)::INT + (steep > 0)::INT + (unnamed > 0)::INT + (seconds < 600)::INT + (n < 2)::INT + mixed::INT AS failures FROM s)
SELECT ident, leg::BIGINT AS leg, phase, failures, hard, s1 AS time_score, s2 AS geometry_score, s3 AS identity_score, s4 AS sampling_score, s5 AS phase_score, score, CASE WHEN hard OR score < 2 THEN 'C' WHEN score >= 3 THEN 'A' ELSE 'B' END AS grade,
CASE WHEN NOT hard AND score >= 2 AND n >= 4 AND seconds >= 3600 AND km >= 100 AND gq <= 21600 AND coalesce(sq0, 999999) <= 30 THEN 'M1_strong' WHEN NOT hard AND score >= 2 AND n >= 2 AND seconds >= 600 AND km >= 10 AND gq <= 43200 AND coalesce(sq0, 999999) <= 40 THEN 'M2_broad' ELSE 'M3_not_ready' END AS ready FROM g""")
def seq_06(spark, d):
    # events are hours apart, so the borders are too
    rules = T.LegRules(least_points=2, least_s=600.0, hard_gap_s=72000.0, warn_gap_s=43200.0, jump_km=2000.0, most_speed=40.0, most_climb=0.2, dense_s=(21600.0, 43200.0), fast=(30.0, 40.0), strong=(4, 3600.0, 100.0), broad=(2, 600.0, 10.0), broad_gap_s=43200.0)
    named = legs(spark, d).withColumns({"tail": F.expr("case when event_id % 7 > 0 then 't' end"), "flight": F.expr("case when event_id % 5 > 0 then 'f' end")})
    return T.quality(named, rules).select("ident", "leg", "phase", "failures", "hard", *[f"{n}_score" for n in ("time", "geometry", "identity", "sampling", "phase")], "score", "grade", "ready")


def batch_pairs(spark, d, least: int = 3):
    """Orders as batches and supplier-like ladders as legs: two arrays of (x, y) per order."""
    li = read(spark, d, "lineitem")
    rows = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 10).alias("x"), (F.col("l_discount") * 50).alias("y")))).alias("r"))
    rows = rows.where(F.size("r") >= least).withColumn("rows", F.transform("r", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    states = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.struct((k / 2.0).alias("x"), (F.pmod(k + F.col("l_orderkey"), F.lit(5)) * 1.0).alias("y")))
    return rows.select("l_orderkey", "rows", states.alias("states"))


def _kernel(spark, pairs, name, kind):
    """Runs a NumPy kernel on the (rows, states) cost matrix of every batch."""
    import pandas as pd

    from windgrid.runtime import ship

    ship(spark)

    def run(batches):
        for pdf in batches:
            out = []
            for key, rows, states in pdf.itertuples(index=False):
                r, s = (np.array([[p["x"], p["y"]] for p in a], dtype=float) for a in (rows, states))
                cost = np.hypot(*(r[:, None] - s[None]).transpose(2, 0, 1))
                if kind == "monotone":
                    total, path = S.monotone_path(cost)
                elif kind == "viterbi":
                    bound = np.where(np.arange(len(s))[None] <= np.arange(len(r))[:, None] + len(s) - len(r), cost, np.inf)
                    total, path = S.monotone_path(bound)
                elif kind == "partial":
                    _, total, path = S.partial_alignment(cost, 1.5)
                elif kind == "order":
                    forward, backward = S.monotone_path(cost)[0], S.monotone_path(cost[::-1])[0]
                    axis = S.principal_order(r)
                    total = min(forward, backward, S.monotone_path(cost[axis])[0], S.monotone_path(cost[axis[::-1]])[0])
                    path = axis
                else:
                    total, path = S.stability(cost, 1.0), np.array([])
                out.append((key, round(float(total), 6), ",".join(map(str, path))))
            yield pd.DataFrame(out, columns=["l_orderkey", name, "path"])

    return pairs.mapInPandas(run, f"l_orderkey long, {name} double, path string")


@query("seq_07_monotone_points")
def seq_07(spark, d):
    return _kernel(spark, batch_pairs(spark, d), "cost", "monotone")


@query("seq_08_viterbi_segments")
def seq_08(spark, d):
    return _kernel(spark, batch_pairs(spark, d), "cost", "viterbi")


@query("seq_09_order_hypotheses")
def seq_09(spark, d):
    return _kernel(spark, batch_pairs(spark, d), "cost", "order")


@query("seq_10_partial_alignment")
def seq_10(spark, d):
    return _kernel(spark, batch_pairs(spark, d), "cost", "partial")


@query("seq_11_drop_alignment")
def seq_11(spark, d):
    return S.aligned(batch_pairs(spark, d), ["l_orderkey"], "rows", "states", 1.0).select("l_orderkey", r6(F.col("cost")).alias("cost"), "matched", r6(F.col("coverage")).alias("coverage"))


@query("seq_12_stability")
def seq_12(spark, d):
    return _kernel(spark, batch_pairs(spark, d), "stable", "stability").drop("path")


@query("seq_13_corruptions")
def seq_13(spark, d):
    import pandas as pd

    from windgrid.runtime import ship

    ship(spark)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["us", "event_id"])
        p, case = g[["lat", "lon", "alt"]].to_numpy(float), int(g["ident"].iloc[0])
        out = []
        for kind in corruption.KINDS:
            order, shift = corruption.plan(len(p), kind, corruption.seed_of(case, kind))
            out.append((case, kind, len(order), int((shift != 0).any(axis=1).sum()), int((np.diff(order) < 0).sum()), round(float(corruption.corrupt(p, kind, corruption.seed_of(case, kind)).sum()), 4)))
        return pd.DataFrame(out, columns=["ident", "kind", "n", "outliers", "inversions", "total"])

    return obs(spark, d).groupBy("ident").applyInPandas(run, "ident long, kind string, n long, outliers long, inversions long, total double")


@query("seq_14_hard_negatives", """
WITH c AS (SELECT c_custkey, c_nationkey, c_mktsegment FROM customer), p AS (SELECT a.c_custkey, b.c_custkey AS neg, CASE WHEN a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment THEN 1 WHEN a.c_nationkey = b.c_nationkey THEN 2 WHEN a.c_mktsegment = b.c_mktsegment THEN 3 ELSE 4 END AS policy FROM c a JOIN c b ON a.c_custkey <> b.c_custkey),
r AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY policy, (neg * 2654435761) % 4294967296, neg) AS r FROM p) SELECT c_custkey, neg, policy FROM r WHERE r = 1""")
def seq_14(spark, d):
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    # the two first by hash of each nation and segment, of each nation, of each segment, and of all: ranks, no pairs
    h = F.pmod(F.col("neg") * 2654435761, F.lit(4294967296))
    least = lambda keys: c.withColumnRenamed("c_custkey", "neg").groupBy(*keys).agg(F.min(F.struct(h.alias("h"), "neg")).alias("one"))

    def two(keys, policy):
        """Per key the first by hash, and the first of the others."""
        first = least(keys)
        others = c.join(F.broadcast(first.select(F.col("one.neg").alias("c_custkey"))), "c_custkey", "left_anti").withColumnRenamed("c_custkey", "neg")
        second = others.groupBy(*keys).agg(F.min(F.struct(h.alias("h"), "neg")).alias("two"))
        both = first.join(second, keys, "left") if keys else first.crossJoin(second)  # one row each
        return both.select(*keys, F.array_compact(F.array("one", "two")).alias(f"p{policy}"))

    out = c
    for policy, keys in ((1, ["c_nationkey", "c_mktsegment"]), (2, ["c_nationkey"]), (3, ["c_mktsegment"]), (4, [])):
        found = two(keys, policy)
        out = out.join(F.broadcast(found), keys, "left") if keys else out.join(F.broadcast(found))
    mine = lambda k: F.try_element_at(F.filter(f"p{k}", lambda x: x["neg"] != F.col("c_custkey")), F.lit(1))["neg"]
    pick = F.coalesce(*[F.when(mine(k).isNotNull(), F.struct(mine(k).alias("neg"), F.lit(k).alias("policy"))) for k in (1, 2, 3, 4)])
    return out.select("c_custkey", pick.alias("x")).where("x is not null").select("c_custkey", "x.neg", "x.policy")


@query("seq_15_pair_score", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(2 * l_discount + 1.5 * l_tax + 0.75 * l_quantity / 50 + 0.5 * l_linenumber / 7.0, 6) AS s FROM lineitem")
def seq_15(spark, d):
    s = 2 * F.col("l_discount") + 1.5 * F.col("l_tax") + 0.75 * F.col("l_quantity") / 50 + 0.5 * F.col("l_linenumber") / 7.0
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(s).alias("s"))


CASES = ["clean", "drop_first", "drop_last", "shift_position", "shift_altitude", "reverse", "duplicate", "time_bias", "identity", "outlier"]


@query("seq_16_case_bank", f"""
WITH t AS (SELECT DISTINCT user_id FROM events), c AS (SELECT user_id, kind, i FROM t, (VALUES {', '.join(f"('{c}', {i})" for i, c in enumerate(CASES))}) v(kind, i))
SELECT user_id * 10 + i AS case_id, kind, CASE WHEN kind IN ('clean', 'drop_first', 'drop_last', 'duplicate') THEN 1 ELSE 0 END AS truth, CASE WHEN (user_id * 2654435761 % 4294967296) % 10 <= 5 THEN 'train' WHEN (user_id * 2654435761 % 4294967296) % 10 <= 7 THEN 'validation' ELSE 'test' END AS split FROM c""")
def seq_16(spark, d):
    t = read(spark, d, "events").select("user_id").distinct()
    c = t.select("user_id", F.posexplode(F.array(*map(F.lit, CASES))).alias("i", "kind"))
    part = F.pmod(F.pmod(F.col("user_id") * 2654435761, F.lit(4294967296)), F.lit(10))
    return c.select((F.col("user_id") * 10 + F.col("i")).alias("case_id"), "kind", F.when(F.col("kind").isin("clean", "drop_first", "drop_last", "duplicate"), 1).otherwise(0).alias("truth"), F.when(part <= 5, "train").when(part <= 7, "validation").otherwise("test").alias("split"))


@query("seq_17_isotonic")
def seq_17(spark, d):
    s = scored(spark, d)
    upper, value = S.pool_binned(*S.binned(s, "p", "y"))  # at most 1001 blocks
    blocks = F.array(*[F.struct(F.lit(float(u)).alias("u"), F.lit(float(v)).alias("v")) for u, v in zip(upper, value, strict=True)])
    hit = F.filter(blocks, lambda b: b["u"] >= F.round("p", 3))
    return s.select("doc_id", r6(F.coalesce(F.try_element_at(hit, F.lit(1))["v"], F.lit(float(value[-1])))).alias("q"))


def _fitted(spark, d):
    """A logistic model of quality on document sizes, from a bounded sample of labelled rows (at most 5000)."""
    from windgrid.operators.ordering import hash_sample

    x = read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars", F.length(F.regexp_replace("text", "[^A-Z]", "")).alias("upper"), F.length(F.regexp_replace("text", "[^#$%&*|!]", "")).alias("marks")), "doc_id")
    x = x.select("doc_id", F.log1p("n_chars").alias("a"), (F.col("upper") / F.greatest("n_chars", F.lit(1))).alias("b"), (F.col("marks") / F.greatest("n_chars", F.lit(1))).alias("c"), F.col("quality").cast("double").alias("y"))
    t = hash_sample(x, F.col("doc_id"), 5000).toPandas()
    return x, Logit.fit(t[["a", "b", "c"]].to_numpy(), t["y"].to_numpy()), t


def _probability(x, model):
    z = F.lit(model.bias)
    for c, wk, m, s in zip("abc", model.weights, model.centre, model.scale, strict=True):
        z = z + float(wk) * (F.col(c) - float(m)) / float(s)
    return x.withColumn("z", z).withColumn("p", weights.sigmoid(F.col("z")))


@query("seq_18_logistic")
def seq_18(spark, d):
    x, model, _ = _fitted(spark, d)
    return _probability(x, model).select("doc_id", r6(F.col("p"), 4).alias("p"), F.col("y").cast("int").alias("y"))


@query("seq_19_platt")
def seq_19(spark, d):
    x, model, t = _fitted(spark, d)
    line = Sharpness.fit(model.score(t[["a", "b", "c"]].to_numpy()), t["y"].to_numpy())
    return _probability(x, model).select("doc_id", r6(weights.sigmoid(line.slope * F.col("z") + line.shift), 4).alias("p"))


@query("seq_20_safety_gates", f"WITH {OBS} SELECT event_id, CASE WHEN heading > 150 OR event_id % 2000 < 10 OR event_id % 2000 > 1800 THEN least(alt / 15000, 1e-4) ELSE alt / 15000 END AS p FROM obs")
def seq_20(spark, d):
    unsafe = F.expr("heading > 150 or event_id % 2000 < 10 or event_id % 2000 > 1800")
    p = F.col("alt") / 15000
    return obs(spark, d).select("event_id", F.when(unsafe, F.least(p, F.lit(1e-4))).otherwise(p).alias("p"))


#: The limits on shares of false accepts, overall, among the accepted, by two hard kinds and by any corruption; and the grid of thresholds.
LIMITS = {"overall": 0.008, "accepted": 0.008, "unreachable": 0.005, "same_identity": 0.01, "kind": 0.015}
GRID = (0.5, 0.999, 300)


@query("seq_21_threshold_search", f"""
WITH {SCORED}, c AS (SELECT round(p * y + (1 - y) * p * 0.9, 6) AS s, y, CASE doc_id % 3 WHEN 0 THEN 'unreachable' WHEN 1 THEN 'same_identity' ELSE 'none' END AS hard, doc_id % 4 AS kind FROM scored),
t AS (SELECT DISTINCT round(t, 6) AS t FROM (SELECT 0.5 + 0.499 * i / 299 AS t FROM range(300) r(i) UNION ALL SELECT s FROM c)),
k AS (SELECT t, kind, count(*) FILTER (WHERE y = 0 AND s >= t) / greatest(1, count(*) FILTER (WHERE y = 0))::DOUBLE AS fpr FROM t, c GROUP BY 1, 2),
m AS (SELECT t, count(*) FILTER (WHERE s >= t) AS accepted, count(*) FILTER (WHERE s >= t AND y = 1) AS hits, count(*) FILTER (WHERE s >= t AND y = 0) AS fa, count(*) FILTER (WHERE y = 0) AS neg, count(*) FILTER (WHERE hard = 'unreachable' AND y = 0) AS un, count(*) FILTER (WHERE hard = 'unreachable' AND y = 0 AND s >= t) AS una, count(*) FILTER (WHERE hard = 'same_identity' AND y = 0) AS si, count(*) FILTER (WHERE hard = 'same_identity' AND y = 0 AND s >= t) AS sia FROM t, c GROUP BY 1),
f AS (SELECT m.* FROM m JOIN (SELECT t, max(fpr) AS worst FROM k GROUP BY 1) w USING (t) WHERE fa / greatest(1, neg)::DOUBLE <= 0.008 AND fa / greatest(1, accepted)::DOUBLE <= 0.008 AND una / greatest(1, un)::DOUBLE <= 0.005 AND sia / greatest(1, si)::DOUBLE <= 0.01 AND worst <= 0.015)
SELECT t AS threshold, hits, fa AS false_accepts, accepted FROM f ORDER BY hits DESC, t LIMIT 1""")
def seq_21(spark, d):
    hard = F.expr("case doc_id % 3 when 0 then 'unreachable' when 1 then 'same_identity' else 'none' end")
    c = scored(spark, d).select(F.round(F.col("p") * F.col("y") + (1 - F.col("y")) * F.col("p") * 0.9, 6).alias("s"), "y", hard.alias("hard"), (F.col("doc_id") % 4).alias("kind"))
    return gates.threshold(c, "s", "y", "hard", "kind", LIMITS, GRID)


POLICY = "SELECT [0.5, 0.75, 1.0, 1.5, 2.0, 3.0][1 + l_linenumber % 6] AS penalty, l_quantity / 50 AS matched, l_discount * 10 AS contiguous, l_tax * 12.5 AS stable, 0.9 + (l_partkey % 100) / 1000 AS posterior, l_suppkey % 97 = 0 AS wrong, l_linestatus = 'O' AS clean FROM lineitem"


@query("seq_22_policy_grid", f"""
WITH p AS ({POLICY}), grid AS (SELECT * FROM (VALUES (0.5), (0.75), (1.0), (1.5), (2.0), (3.0)) a(pen), (VALUES (0.5), (0.6), (0.7)) b(cov), (VALUES (0.4), (0.5), (0.6)) c(run), (VALUES (0.9), (0.95), (0.98), (0.99)) e(post)),
n AS (SELECT pen, cov, run, post, count(*) FILTER (WHERE ok) AS accepted, count(*) FILTER (WHERE ok AND wrong) AS bad, count(*) FILTER (WHERE ok AND clean) AS kept, count(*) FILTER (WHERE clean) AS cleans FROM (SELECT g.*, wrong, clean, matched >= cov AND contiguous >= run AND stable >= 0.6 AND posterior >= post AS ok FROM grid g LEFT JOIN p ON penalty = pen) GROUP BY 1, 2, 3, 4),
r AS (SELECT *, bad / greatest(1, accepted)::DOUBLE AS wrong_rate, kept / greatest(1, cleans)::DOUBLE AS retention FROM n), o AS (SELECT *, row_number() OVER (ORDER BY (wrong_rate <= 0.01 AND accepted > 0) DESC, CASE WHEN wrong_rate <= 0.01 AND accepted > 0 THEN 0 ELSE wrong_rate END, CASE WHEN wrong_rate <= 0.01 AND accepted > 0 THEN -retention ELSE 0 END, accepted DESC, CASE WHEN wrong_rate <= 0.01 AND accepted > 0 THEN post ELSE 0 END, pen, cov, run, post) AS place FROM r)
SELECT pen::DOUBLE AS pen, cov::DOUBLE AS cov, run::DOUBLE AS run, post::DOUBLE AS post, accepted, round(wrong_rate, 8) AS wrong_rate, round(retention, 8) AS retention, place = 1 AS chosen FROM o""")
def seq_22(spark, d):
    penalty = F.element_at(F.array(*map(F.lit, gates.PENALTIES)), (1 + F.col("l_linenumber") % 6).cast("int"))
    p = read(spark, d, "lineitem").select(
        penalty.alias("penalty"), (F.col("l_quantity") / 50).alias("matched"), (F.col("l_discount") * 10).alias("contiguous"), (F.col("l_tax") * 12.5).alias("stable"), F.expr("0.9D + (l_partkey % 100) / 1000.0D").alias("posterior"),
        (F.col("l_suppkey") % 97 == 0).alias("wrong"), (F.col("l_linestatus") == "O").alias("clean"),
    )
    return gates.policies(p)


def _frozen():
    from windgrid.operators.confidence import Frozen

    return Frozen(-0.2, [0.3 - 0.1 * (i % 5) for i in range(19)], [1.0 + 0.25 * (i % 4) if i < 8 else 0.25 for i in range(19)], [1.5 if i < 8 else 0.4 for i in range(19)], [0.2, 0.35, 0.5, 0.7, 1.0], [0.02, 0.2, 0.45, 0.8, 0.97])


#: a case's numbers and marks, as SQL of an observation
CASE = {
    "best_cost": "CASE WHEN event_id % 17 = 0 THEN NULL ELSE speed / 10 END", "cross_track_q90_km": "wind_speed / 5", "vertical_q90_m": "alt / 3", "sampling_gap_max_seconds": "CASE WHEN event_id % 13 = 0 THEN NULL ELSE heading * 10 END", "monotonic_violation_count": "event_id % 6",
    "candidate_leg_count": "event_id % 9 - 1", "ambiguity_margin": "heading / 360", "batch_size": "1 + event_id % 50", "flight_phase": "CASE event_id % 4 WHEN 0 THEN 'ASC' WHEN 1 THEN 'DES' WHEN 2 THEN 'LVR' END",
    "source_tier": "CASE event_id % 5 WHEN 0 THEN 'S0_exact' WHEN 1 THEN 'S1_tail' WHEN 2 THEN 'S2_flight' WHEN 3 THEN 'other' END", "batch_size_bucket": "CASE WHEN event_id % 50 < 1 THEN '1' WHEN event_id % 50 < 4 THEN '2-4' WHEN event_id % 50 < 10 THEN '5-10' WHEN event_id % 50 < 25 THEN '11-25' ELSE '26-50' END",
}


def _posterior_sql() -> str:
    m, terms = _frozen(), []
    other = dict(zip(list(CASE)[:8], (50, 20, 5000, 3600, 20, 0, 1, 1), strict=True))
    x = [f"ln(1 + greatest(0.0::DOUBLE, coalesce({n}, {v})))" for n, v in other.items()] + [f"coalesce({t}, false)::INT" for t in ("flight_phase = 'ASC'", "flight_phase = 'DES'", "flight_phase = 'LVR'", "source_tier LIKE 'S0%'", "source_tier LIKE 'S1%'", "source_tier LIKE 'S2%'")]
    x += [f"(batch_size_bucket = '{b}')::INT" for b in ("1", "2-4", "5-10", "11-25", "26-50")]
    for e, w, mean, std in zip(x, m.weights, m.means, m.stds, strict=True):
        terms.append(f"({w!r}::DOUBLE * ({e} - {mean}) / {std}::DOUBLE)")
    knots = " ".join(f"WHEN raw <= {k} THEN {v}" for k, v in zip(m.knots[:-1], m.values[:-1], strict=True))
    return f"WITH {OBS}, c AS (SELECT event_id, {', '.join(f'{e} AS {n}' for n, e in CASE.items())} FROM obs), z AS (SELECT event_id, 1 / (1 + exp(-({m.intercept} + {' + '.join(terms)}))) AS raw FROM c) SELECT event_id, (CASE {knots} ELSE {m.values[-1]} END)::DOUBLE AS p FROM z"


@query("seq_23_frozen_posterior", _posterior_sql())
def seq_23(spark, d):
    from windgrid.operators.confidence import posterior

    return obs(spark, d).select("event_id", *[F.expr(e).alias(n) for n, e in CASE.items()]).select("event_id", posterior(_frozen()).alias("p"))


@query("seq_24_acceptance_roles", f"WITH {SCORED} SELECT doc_id, CASE WHEN p >= 0.9 AND doc_id % 3 <> 0 THEN 'unique' WHEN p >= 0.55 THEN 'mixture' ELSE 'reject' END AS role FROM scored")
def seq_24(spark, d):
    return scored(spark, d).select("doc_id", clean.first_reason([("unique", F.expr("p >= 0.9D and doc_id % 3 <> 0")), ("mixture", F.expr("p >= 0.55D"))], "reject").alias("role"))


@query("seq_25_batch_combination", f"WITH {SCORED} SELECT 'frozen' AS origin, count(*) AS n FROM scored WHERE p >= 0.9 UNION ALL SELECT 'increment', count(*) FROM scored WHERE p >= 0.6 AND p < 0.9 UNION ALL SELECT 'overlap', 0")
def seq_25(spark, d):
    a, b = scored(spark, d).where("p >= 0.9D").select("doc_id"), scored(spark, d).where("p >= 0.6D and p < 0.9D").select("doc_id")
    count = lambda df, n: df.agg(F.lit(n).alias("origin"), F.count("*").alias("n")).select("origin", "n")
    return count(a, "frozen").unionByName(count(b, "increment")).unionByName(count(b.join(a, "doc_id", "left_semi"), "overlap"))


@query("seq_26_best_and_second", """
WITH r AS (SELECT l_orderkey, l_extendedprice AS c, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice, l_partkey, l_suppkey) AS r FROM lineitem), b AS (SELECT l_orderkey, max(CASE WHEN r = 1 THEN c END) AS best, max(CASE WHEN r = 2 THEN c END) AS second FROM r WHERE r <= 2 GROUP BY 1)
SELECT l_orderkey, best, second, CASE WHEN second IS NULL THEN 'single' WHEN second / best >= 1.12 THEN 'clear' ELSE 'ambiguous' END AS grade FROM b""")
def seq_26(spark, d):
    best = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.slice(F.sort_array(F.collect_list("l_extendedprice")), 1, 2).alias("c"))
    b = best.select("l_orderkey", F.element_at("c", 1).alias("best"), F.try_element_at("c", F.lit(2)).alias("second"))
    return b.withColumn("grade", clean.first_reason([("single", F.col("second").isNull()), ("clear", F.col("second") / F.col("best") >= 1.12)], "ambiguous"))


SIZES = (2, 4, 6, 10)


@query("seq_27_pseudo_batches", f"""
WITH {TRACK_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY ident, leg ORDER BY us, event_id) - 1 AS i, count(*) OVER (PARTITION BY ident, leg) AS points FROM legs), s AS (SELECT r.*, size FROM r, (VALUES (2), (4), (6), (10)) v(size) WHERE points >= 2), g AS (SELECT ident, leg, size, i // size AS batch, count(*) AS n, min(us) AS start_us, max(us) + 60000000 AS end_us, min(event_id) AS first_event FROM s GROUP BY 1, 2, 3, 4)
SELECT ident, leg::BIGINT AS leg, size, batch, start_us, end_us, first_event FROM g WHERE n = size""")
def seq_27(spark, d):
    return T.pseudo_batches(legs(spark, d), ["ident", "leg"], ["us", "event_id"], SIZES, least=2).select("ident", "leg", "size", "batch", "start_us", "end_us", "first_event")


@query("seq_28_time_uncertainty", """
WITH o AS (SELECT o_orderkey, o_custkey, epoch_us(o_orderdate) AS us, (epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) / 1e6::DOUBLE AS gap, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 100 END AS prior FROM orders),
l AS (SELECT *, count(*) OVER k AS n, sum(l_quantity) OVER k * 1000 AS hspan, max(l_quantity) OVER k * 100 AS vspan, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth FROM lineitem WINDOW k AS (PARTITION BY l_orderkey)),
a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, us, gap, prior, n, greatest(300.0, least(3600.0, coalesce(prior, 300.0))) AS prior_s, greatest(300.0, least(3600.0, greatest(hspan / CASE l_orderkey % 4 WHEN 0 THEN 160 WHEN 1 THEN 180 WHEN 2 THEN 230 ELSE 200 END, vspan / CASE l_orderkey % 4 WHEN 0 THEN 8 WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 7.5 END) * 1.35 + 180)) AS span_s,
greatest(300.0, least(7200.0, CASE WHEN gap > 0 THEN gap + 300 ELSE 7200.0 END)) AS cap_s, least(1.0, greatest(0.0, (nth - 1) / greatest(1.0, n - 1.0))) AS progress, l_linenumber % 2 = 0 AS taken,
greatest(90.0, least(300.0, greatest(90.0, l_quantity * 0.5, l_discount * 10 * 12, l_tax * 10000 * 0.05, CASE WHEN n <= 1 THEN 180.0 ELSE 240.0 END))) AS own_s, us + ((l_quantity - 45) * -60000000)::BIGINT AS guess FROM l JOIN o ON o_orderkey = l_orderkey),
w AS (SELECT *, greatest(300.0, least(greatest(prior_s, span_s), cap_s, 3600.0)) AS width, least(guess, us) AS mid FROM a),
q AS (SELECT *, CASE WHEN taken THEN mid ELSE us - round((width - width * (0.25 + 0.55 * progress)) * 1000000)::BIGINT END AS q50, CASE WHEN taken THEN mid - round(own_s * 500000)::BIGINT ELSE us - round(width * 1000000)::BIGINT END AS q10, CASE WHEN taken THEN least(us, mid + round(own_s * 500000)::BIGINT) ELSE us END AS q90 FROM w)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, us - q10 AS q10_before, us - q50 AS q50_before, us - q90 AS q90_before, CASE WHEN cap_s < greatest(prior_s, span_s) THEN 'previous_batch_gap' WHEN span_s > prior_s THEN 'physical_span' ELSE 'confidence' END AS driver, CASE WHEN taken THEN round((q90 - q10) / 1e6, 4) ELSE round(width, 4) END AS uncertainty_s,
CASE WHEN taken THEN CASE WHEN prior <= 300 THEN 'B_narrow' ELSE 'C_narrow' END WHEN prior <= 900 THEN 'C_interval' WHEN prior <= 1800 THEN 'D_wide' ELSE 'R_rejected' END AS grade, guess > us AS clipped FROM q""")
def seq_28(spark, d):
    us = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    o = read(spark, d, "orders").select("o_orderkey", us.alias("us"), ((us - F.lag(us).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))) / 1e6).alias("gap_s"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice") / 100).alias("prior_s"))
    k = Window.partitionBy("l_orderkey")
    rows = read(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.count("*").over(k).alias("n"), F.row_number().over(k.orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("nth"), (F.sum("l_quantity").over(k) * 1000).alias("hspan_m"), (F.max("l_quantity").over(k) * 100).alias("vspan_m"),
        F.expr("elt(cast(1 + l_orderkey % 4 as int), 'ASC', 'DES', 'LVR', 'x')").alias("phase"), (F.col("l_linenumber") % 2 == 0).alias("accepted"), F.col("l_quantity").alias("sampling_s"), (F.col("l_discount") * 10).alias("cross_km"), (F.col("l_tax") * 10000).alias("vertical_m"), ((F.col("l_quantity") - 45) * -60000000).cast("long").alias("ahead"),
    ).join(o, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("estimate_us", F.col("us") + F.col("ahead"))
    t = uncertainty.row_times(rows)
    before = [(F.col("us") - F.col(f"{c}_us")).alias(f"{c}_before") for c in ("q10", "q50", "q90")]
    return t.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *before, "driver", r6(F.col("uncertainty_s"), 4).alias("uncertainty_s"), "grade", "clipped")


#: a support row, as SQL of an observation
SUPPORT = {
    "source": "source", "wind_speed": "CASE WHEN event_id % 41 = 0 THEN NULL ELSE speed END", "wind_dir": "CAST(wind_dir + CASE WHEN event_id % 53 = 0 THEN 360 ELSE 0 END AS DOUBLE)", "u": "speed * sin(radians(wind_dir))", "v": "speed * cos(radians(wind_dir)) + CASE WHEN event_id % 19 = 0 THEN 5 ELSE 0 END", "alt": "alt",
    "batch_rows": "CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 1 ELSE 1 + event_id % 57 END", "hspan": "CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST(event_id % 37 AS DOUBLE) * (event_id % 11) / 60 END", "vspan": "CAST(event_id * 13 % 61 * (event_id % 7) * 16 AS DOUBLE)",
    "phase": "CASE event_id % 5 WHEN 0 THEN 'LVR' WHEN 1 THEN 'ASC' WHEN 2 THEN 'DES' WHEN 3 THEN 'LVR' END", "wind_std": "CAST(event_id % 45 AS DOUBLE)", "cap": "CASE WHEN event_id % 31 = 0 THEN 0.0 WHEN event_id % 7 = 0 THEN NULL ELSE 0.5 + (event_id % 6) / 10.0 END", "review": "event_id % 10 = 0",
    "tail": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE 't' END", "flight": "CASE WHEN event_id % 6 = 0 THEN NULL ELSE 'f' END", "strict": "CASE WHEN event_id % 8 = 0 THEN NULL ELSE event_id % 9 > 0 END", "error_s": "CAST(event_id * 7 % 4000 AS DOUBLE) / 5", "wrong": "event_id % 61 = 0", "valid": "event_id % 4 > 0",
}


def _support_columns() -> list[str]:
    return [f"CAST({e} AS DOUBLE) AS {n}" if n in ("cap", "u", "v", "hspan") else f"{e} AS {n}" for n, e in SUPPORT.items()]


SCORE = f"""{OBS}, s0 AS (SELECT event_id, {', '.join(_support_columns())} FROM obs),
s1 AS (SELECT *, source = 'amdar' AS am, coalesce(batch_rows, 999999) AS sz, coalesce(hspan, 999) AS hs, coalesce(vspan, 999999) AS vs, coalesce(wind_std, 999) AS sd, coalesce(cap, 1) AS c0, coalesce(wind_speed IS NULL OR wind_speed < 0 OR wind_dir < 0 OR wind_dir >= 360, true) AS bad, coalesce(source = 'amdar' AND wind_speed > 150, false) AS high FROM s0),
s2 AS (SELECT *, high AND (wind_speed <= 200 OR (alt >= 7000 AND hs <= 8 AND vs <= 6500)) AS backed, CASE WHEN sz <= 1 THEN 0.96 WHEN sz <= 4 THEN 0.88 WHEN sz <= 10 THEN 0.78 WHEN sz <= 25 THEN 0.6 WHEN sz <= 49 THEN 0.42 ELSE 0.28 END AS f1,
CASE WHEN hs <= 0.2 AND vs <= 300 THEN 1.0 WHEN hs <= 0.5 AND vs <= 600 THEN 0.94 WHEN hs <= 0.8 AND vs <= 1000 THEN 0.88 WHEN hs <= 1.5 AND vs <= 1800 THEN 0.76 WHEN hs <= 3 AND vs <= 3000 THEN 0.62 WHEN hs <= 5 AND vs <= 5000 THEN 0.45 ELSE 0.25 END AS f2,
CASE phase WHEN 'LVR' THEN 1.0 WHEN 'ASC' THEN 0.92 WHEN 'DES' THEN 0.88 ELSE 0.82 END AS f3, CASE WHEN sz <= 1 THEN 0.96 WHEN sd < 5 THEN 1.0 WHEN sd < 10 THEN 0.92 WHEN sd < 20 THEN 0.8 WHEN sd < 35 THEN 0.65 ELSE 0.45 END AS f4 FROM s1),
s3 AS (SELECT *, CASE WHEN am THEN least(0.92, greatest(0.05, exp(0.3 * ln(f1::DOUBLE) + 0.35 * ln(f2::DOUBLE) + 0.1 * ln(f3::DOUBLE) + 0.25 * ln(f4::DOUBLE)))) ELSE 0.92 END AS rep, bad OR (high AND NOT backed) OR (CASE WHEN backed AND wind_speed > 200 THEN greatest(c0, 0.42) WHEN backed THEN greatest(c0, 0.55) ELSE c0 END) <= 0 AS rejected,
CASE WHEN backed AND wind_speed > 200 THEN greatest(c0, 0.42) WHEN backed THEN greatest(c0, 0.55) ELSE c0 END AS cp, CASE WHEN bad OR (high AND NOT backed) THEN 1e-6 WHEN high AND wind_speed > 200 THEN 0.42 WHEN high AND alt >= 8000 THEN 0.78 WHEN high THEN 0.55 WHEN review OR abs(sqrt(u * u + v * v) - wind_speed) > 0.5 THEN 0.7 ELSE 1 END::DOUBLE AS ph,
CASE WHEN tail IS NOT NULL AND flight IS NOT NULL THEN 1 WHEN tail IS NULL AND flight IS NULL THEN 0.45 ELSE 0.82 END::DOUBLE AS idn, CASE source WHEN 'turb' THEN 1 WHEN 'amdar' THEN 0.9 ELSE 0.7 END::DOUBLE AS sq FROM s2),
s4 AS (SELECT *, CASE WHEN source = 'turb' THEN 1 WHEN rejected THEN 0 ELSE least(cp, 0.9, exp(0.22 * ln(sq) + 0.28 * ln(ph) + 0.4 * ln(rep) + 0.1 * ln(idn))) END AS support, CASE WHEN NOT am THEN 0 WHEN sz <= 1 THEN 240 WHEN sz <= 10 AND hs <= 0.8 AND vs <= 1000 THEN 300 WHEN sz <= 25 AND hs <= 5 AND vs <= 5000 THEN 900 WHEN sz <= 49 AND hs <= 5 AND vs <= 5000 THEN 1500 ELSE 2100 END AS seconds,
greatest(hs * 111000 / CASE phase WHEN 'LVR' THEN 230 WHEN 'ASC' THEN 180 WHEN 'DES' THEN 190 ELSE 160 END, vs / CASE WHEN phase IN ('ASC', 'DES') THEN 8 ELSE 4 END) * 1.2 + CASE WHEN sz <= 1 THEN 60 WHEN sz <= 10 THEN 120 WHEN sz <= 25 THEN 180 ELSE 240 END AS across, CASE WHEN sz <= 1 THEN 180 WHEN sz <= 10 THEN 300 WHEN sz <= 25 THEN 600 WHEN sz <= 49 THEN 1200 ELSE 1800 END AS least_s FROM s3)"""


@query("seq_29_confidence_tiers", f"""
WITH {SCORE}, t AS (SELECT *, CASE WHEN source = 'turb' THEN CASE WHEN coalesce(strict, false) AND NOT rejected THEN 'T0' ELSE 'T4' END WHEN rejected THEN 'T4' WHEN support >= 0.72 AND seconds <= 300 THEN 'T1' WHEN support >= 0.53 AND seconds <= 900 THEN 'T2' WHEN support >= 0.3 AND seconds <= 1800 THEN 'T3' ELSE 'T4' END AS tier FROM s4),
g AS (SELECT *, CASE WHEN tier = 'T0' THEN 'S' WHEN source = 'turb' OR rejected THEN 'R' WHEN tier = 'T1' THEN 'A' WHEN tier = 'T2' THEN 'B' WHEN tier = 'T3' THEN 'C' ELSE 'D' END AS grade,
CASE WHEN tier = 'T0' THEN 'strict_holdout' WHEN source = 'turb' THEN 'strict_holdout_review' WHEN rejected THEN 'rejected_or_manual_review' WHEN tier IN ('T1', 'T2') THEN 'support_assimilation_candidate' WHEN tier = 'T3' THEN 'low_confidence_support_or_superob_only' ELSE 'display_only_or_reject' END AS role,
CASE WHEN tier <> 'T2' THEN tier WHEN sz <= 10 AND hs <= 2 AND vs <= 2000 AND rep >= 0.72 THEN 'T2a_direct_support_candidate' ELSE 'T2b_broad_or_lower_weight_support' END AS subtier FROM t)
SELECT event_id, round(rep, 6) AS representative, round(support::DOUBLE, 6) AS support, seconds::DOUBLE AS seconds, round((CASE WHEN am THEN least(seconds, greatest(across, least_s)) ELSE 0 END)::DOUBLE, 4) AS seconds_continuous, rejected, tier, grade, role, subtier,
CASE subtier WHEN 'T0' THEN 'strict_holdout_evaluation_only' WHEN 'T1' THEN 'direct_support_high_weight' WHEN 'T2a_direct_support_candidate' THEN 'direct_support_medium_weight' WHEN 'T2b_broad_or_lower_weight_support' THEN 'low_weight_or_superob_preferred' WHEN 'T3' THEN 'superob_or_context_only' ELSE 'display_only_or_reject' END AS advice FROM g""")
def seq_29(spark, d):
    from windgrid.operators.confidence import graded, scored

    g = graded(scored(supports(spark, d)))
    return g.select("event_id", r6(F.col("representative")).alias("representative"), r6(F.col("support")).alias("support"), "seconds", r6(F.col("seconds_continuous"), 4).alias("seconds_continuous"), "rejected", "tier", "grade", "role", "subtier", "advice")


def supports(spark, d):
    return obs(spark, d).selectExpr("event_id", *_support_columns())


@query("seq_30_threshold_grid", f"""
WITH {SCORE}, grid AS (SELECT a::DOUBLE AS a, b::DOUBLE AS b FROM (VALUES (0.70), (0.72), (0.74), (0.76), (0.78)) x(a), (VALUES (0.50), (0.53), (0.56), (0.60)) y(b)),
p AS (SELECT a, b, s4.*, CASE WHEN support >= a AND seconds <= 300 THEN 1 WHEN support >= b AND seconds <= 900 THEN 2 ELSE 0 END AS t FROM s4, grid),
r AS (SELECT a, b, count(*) FILTER (WHERE am) AS n, count(*) FILTER (WHERE am AND t = 1) AS r1, count(*) FILTER (WHERE am AND t = 2) AS r2, count(*) FILTER (WHERE valid AND t = 1) AS n1, quantile_cont(round(error_s, 1), 0.9) FILTER (WHERE valid AND t = 1) AS q1, avg(wrong::INT) FILTER (WHERE valid AND t = 1) AS w1, count(*) FILTER (WHERE valid AND t = 2) AS n2, quantile_cont(round(error_s, 1), 0.9) FILTER (WHERE valid AND t = 2) AS q2, avg(wrong::INT) FILTER (WHERE valid AND t = 2) AS w2 FROM p GROUP BY 1, 2)
SELECT a AS t1_min, b AS t2_min, r1 AS real_t1, r2 AS real_t2, n1 AS t1_n, round(q1, 4) AS t1_q90, round(w1, 6) AS t1_wrong, n2 AS t2_n, round(q2, 4) AS t2_q90, round(w2, 6) AS t2_wrong, round((r1 + r2) / greatest(1, n)::DOUBLE, 6) AS coverage, coalesce(q1 < 180 AND q2 < 600 AND w1 <= 0.01 AND w2 <= 0.02, false) AS passes FROM r""")
def seq_30(spark, d):
    from windgrid.operators.confidence import scored as confidences
    from windgrid.operators.confidence import threshold_grid

    s = confidences(supports(spark, d))
    g = threshold_grid(s.where("source = 'amdar'"), s.where("valid"))
    return g.select("t1_min", "t2_min", "real_t1", "real_t2", *[c for t in ("t1", "t2") for c in (f"{t}_n", r6(F.col(f"{t}_q90"), 4).alias(f"{t}_q90"), r6(F.col(f"{t}_wrong")).alias(f"{t}_wrong"))], r6(F.col("coverage")).alias("coverage"), "passes")


@query("seq_31_ground_agents", f"WITH {OBS} SELECT ident, round(median(lat), 6) AS lat, round(median(lon), 6) AS lon, count(DISTINCT floor(alt / 500)) AS levels, round(avg(speed), 8) AS speed FROM obs GROUP BY 1")
def seq_31(spark, d):
    return obs(spark, d).groupBy("ident").agg(r6(F.median("lat")).alias("lat"), r6(F.median("lon")).alias("lon"), F.count_distinct(F.floor(F.col("alt") / 500)).alias("levels"), r6(F.avg("speed"), 8).alias("speed"))


@query("seq_32_agent_edges", f"""
WITH {OBS}, a AS (SELECT ident, median(lat) AS lat, median(lon) AS lon, avg(alt) AS alt, max(us) / 1e6::DOUBLE AS t FROM obs GROUP BY 1), p AS (SELECT a.ident AS a, b.ident AS b, {HAVERSINE.format(a='a.', b='b.')} AS km, abs(a.alt - b.alt) AS dalt, abs(a.t - b.t) AS dt FROM a JOIN a b ON a.ident <> b.ident),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(km, 6), b) AS r FROM p WHERE km <= 600 AND dalt <= 900 AND dt <= 172800), k AS (SELECT *, row_number() OVER (ORDER BY a, r) - 1 AS slot FROM r WHERE r <= 12)
SELECT a, b, round(km, 3) AS km, round(dalt, 3) AS dalt, round(dt, 3) AS dt, slot, min(slot) OVER (PARTITION BY a) AS row_start FROM k""")
def seq_32(spark, d):
    a = obs(spark, d).groupBy("ident").agg(F.median("lat").alias("lat"), F.median("lon").alias("lon"), F.avg("alt").alias("alt"), (F.max("us") / 1e6).alias("t"))
    p = nearest_on_sphere(a, "ident", "lat", "lon", 600.0, 12, {"alt": 900.0, "t": 172800.0}).withColumnsRenamed({"d_alt": "dalt", "d_t": "dt"})
    # compressed rows: edges in one order, and where each agent's begin
    p = global_row_number(p, ["a", "r"], "slot", F.floor(F.col("a") / 1000)).withColumn("row_start", F.min("slot").over(Window.partitionBy("a")))
    return p.select("a", "b", *[r6(F.col(c), 3).alias(c) for c in ("km", "dalt", "dt")], "slot", "row_start")


@query("seq_33_ground_estimate", f"WITH {OBS} SELECT ident, round(CASE WHEN count(*) < 5 THEN median(alt) ELSE sum(alt * (1 + speed)) / sum(1 + speed) END, 4) AS alt FROM obs GROUP BY 1")
def seq_33(spark, d):
    w = 1 + F.col("speed")
    return obs(spark, d).groupBy("ident").agg(r6(F.when(F.count("*") < 5, F.median("alt")).otherwise(A.weighted_mean(F.col("alt"), w)), 4).alias("alt"))


@query("seq_34_payload_roles", f"WITH {OBS} SELECT ident, 'wind' AS role, count(*) AS n FROM obs WHERE source <> 'other' GROUP BY 1 UNION ALL SELECT ident, 'motion', count(*) FROM obs WHERE source = 'other' GROUP BY 1")
def seq_34(spark, d):
    return obs(spark, d).groupBy("ident", F.when(F.col("source") != "other", "wind").otherwise("motion").alias("role")).agg(F.count("*").alias("n"))


@query("seq_35_agent_support", """
WITH c AS (SELECT user_id, floor((event_id * 31 % 15000) / 1000.0)::BIGINT AS z, event_type FROM events), a AS (SELECT DISTINCT user_id, z + dz AS z FROM c, range(-1, 2) r(dz) WHERE event_type = 'click'), w AS (SELECT DISTINCT user_id, z FROM c WHERE event_type = 'purchase')
SELECT a.user_id, count(*) AS dilated, count(w.z) AS supported FROM a LEFT JOIN w ON a.user_id = w.user_id AND a.z = w.z GROUP BY 1""")
def seq_35(spark, d):
    c = read(spark, d, "events").select("user_id", F.floor(F.expr("(event_id * 31 % 15000) / 1000D")).alias("z"), "event_type")
    a = c.where("event_type = 'click'").select("user_id", F.explode(F.array(F.col("z") - 1, F.col("z"), F.col("z") + 1)).alias("z")).distinct()
    w = c.where("event_type = 'purchase'").select("user_id", "z", F.lit(1).alias("hit")).distinct()
    return a.join(w, ["user_id", "z"], "left").groupBy("user_id").agg(F.count("*").alias("dilated"), F.count("hit").alias("supported"))


#: what the points of the query know, as SQL of an observation; all else is 0
POINT = {
    "z": "floor(alt / 500)", "y": "floor((54.2{D} - lat) * 4)", "x": "floor((lon - 73.0{D}) * 4)", "lat": "lat", "lon": "lon", "alt_m": "alt", "pred_u": "speed / 2", "pred_v": "wind_speed", "pred_speed": "wind_speed", "recon_confidence": "(event_id % 40) / 100.0{D}",
    "nearest_role_gap_mps": "heading / 8", "nearest_current_count": "event_id % 3", "nearest_context_count": "event_id % 5", "recon_vertical_jump_mps": "speed / 10", "vertical_speed_gap_mps": "wind_speed / 5", "nearest_train_distance_vox": "event_id % 8",
}
RISK = """SELECT *, least(1, greatest(0, (nearest_train_distance_vox - 2) / 4)) AS d_, least(1, greatest(0, (nearest_role_gap_mps - 20) / 20)) AS g_, 1 - least(1, recon_confidence / 0.2::DOUBLE) AS l_, 1 - least(1, (nearest_current_count + 0.5 * nearest_context_count) / 3) AS s_,
least(1, greatest(vertical_speed_gap_mps, recon_vertical_jump_mps) / 30) AS v_, (alt_m >= 12000)::INT AS h_, (nearest_current_count <= 0 AND src = 'context_wind')::INT AS c_, least(1, greatest(0, (pred_speed - 45) / 45)) AS f_ FROM p"""


def _features_sql() -> str:
    from windgrid.operators.residual import FLAGS, NUMBERS

    def number(n):
        return f"({POINT[n].format(D='::DOUBLE')})::DOUBLE" if n in POINT else "0.0::DOUBLE"

    out = {n: n for n in NUMBERS} | {"role_overlap_at_point": "ov::INT::DOUBLE", "role_conflict_at_point": "0.0::DOUBLE"}
    assert set(FLAGS) <= set(out)
    out |= {f"{a}_norm": f"least(1.0, greatest(-1.0, {a} / {n - 1}.0 * 2 - 1))" for a, n in (("z", 40), ("y", 168), ("x", 248))}
    out |= {"alt_norm": "least(1.2, greatest(0.0, alt_m / 20000))", "pred_speed_norm": "least(2.0, pred_speed / 120)", "support_total": "nearest_current_count + nearest_context_count", "support_log1p": "ln(1 + nearest_current_count + nearest_context_count)"}
    hour, day = "2 * pi() * (hour(ts) + minute(ts) / 60.0) / 24", "2 * pi() * (dayofyear(ts) - 1) / 366"
    out |= {"hour_sin": f"sin({hour})", "hour_cos": f"cos({hour})", "day_sin": f"sin({day})", "day_cos": f"cos({day})"}
    out |= {"nearest_source_current_train": "(src = 'current_wind_train')::INT::DOUBLE", "nearest_source_context": "(src = 'context_wind')::INT::DOUBLE", "nearest_source_unknown": "(src = '')::INT::DOUBLE"}
    out |= {
        "representation_risk_score": "risk", "sigma_rep_proxy_mps": "sig", "tail_probability_proxy": "pow(risk, 2.2)", "residual_gate_initial": "least(0.85, (1 - 0.8 * risk) * least(1, greatest(0.05, (recon_confidence - 0.02) / 0.18)) * greatest(0.1, 1 - 0.65 * g_) * greatest(0.15, 1 - 0.55 * s_))",
        "sample_weight_raw": "1 / (4.84 + sig * sig)", "distance_risk_score": "d_", "role_gap_risk_score": "g_", "low_conf_risk_score": "l_", "support_risk_score": "s_", "vertical_risk_score": "v_", "context_only_risk_flag": "c_::DOUBLE",
        "high_altitude_flag": "h_::DOUBLE", "pred_light_wind_flag": "(pred_speed >= 5 AND pred_speed < 15)::INT::DOUBLE",
    }
    source = "CASE event_id % 3 WHEN 0 THEN 'context_wind' WHEN 1 THEN 'current_wind_train' ELSE '' END"
    return f"""WITH {OBS}, p AS (SELECT event_id, ts, {source} AS src, event_id % 4 = 0 AS ov, {', '.join(f'{number(n)} AS {n}' for n in NUMBERS)} FROM obs), r AS ({RISK}),
t AS (SELECT *, least(1.0, 0.23 * d_ + 0.18 * g_ + 0.18 * l_ + 0.16 * s_ + 0.12 * v_ + 0.06 * h_ + 0.05 * c_ + 0.02 * f_) AS risk FROM r), u AS (SELECT *, least(32.0, 2 + 22 * risk + 4 * h_) AS sig FROM t)
SELECT event_id, {', '.join(f'round(({e})::DOUBLE, 5) + 0.0 AS {n}' for n, e in out.items())} FROM u"""


def points(spark, d):
    o = obs(spark, d)
    source = F.expr("case event_id % 3 when 0 then 'context_wind' when 1 then 'current_wind_train' else '' end")
    return o.select("event_id", "ts", *[F.expr(e.format(D="D")).alias(n) for n, e in POINT.items()], (F.col("event_id") % 4 == 0).alias("role_overlap_at_point"), source.alias("nearest_train_source_role"))


@query("seq_36_residual_features", _features_sql())
def seq_36(spark, d):
    from windgrid.operators.residual import features

    f = features(points(spark, d), ["event_id"], "ts", (40, 168, 248), 20000.0)
    return f.select("event_id", *[(scaled_round(F.col(c), 5) + 0.0).alias(c) for c in f.columns[1:]])


@query("seq_37_residual_network")
def seq_37(spark, d):
    from windgrid.operators.residual import predict, train

    e = read(spark, d, "embeddings").where("size(embedding) = 64")
    e = e.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"), (F.col("label") % 2).cast("double").alias("y_u"), (F.col("label") % 3).cast("double").alias("y_v"), F.lit(1.0).alias("gate"), F.lit(1.0).alias("weight"))
    return predict(e, train(e, "vec_id")).select("vec_id", *[r6(F.col(c), 4).alias(c) for c in ("delta_u", "delta_v", "sigma_u", "sigma_v")])


#: a point with its baseline error and correction, as SQL of a line item
GATED = {
    "split": "CASE WHEN l_orderkey % 10 < 6 THEN 'train' WHEN l_orderkey % 10 < 8 THEN 'val' ELSE 'test' END", "u_miss": "l_discount * 203.3{D}", "v_miss": "l_tax * 207.7{D}", "du": "l_discount * 203.3{D} * CASE WHEN l_partkey % 9 = 0 THEN 0.31{D} ELSE -0.43{D} END",
    "dv": "l_tax * 207.7{D} * -0.23{D}", "speed": "l_extendedprice / 1000", "pred_speed": "l_quantity * 2", "alt_m": "l_partkey * 37 % 16000", "light": "l_quantity * 2 >= 5 AND l_quantity * 2 < 15", "risk": "(l_orderkey * 7 % 100) / 100.0{D}", "sigma_rep": "2 + 22 * (l_orderkey * 7 % 100) / 100.0{D}",
    "role_gap": "l_quantity", "vertical_gap": "l_tax * 400",
}
NARROW = {f"speed_{s}_not_light": (2, f"pred_speed >= {s}") for s in (45, 60)} | {f"risk_{round(100 * r)}_not_light": (2, f"risk >= {r}") for r in (0.15, 0.20, 0.25, 0.30, 0.35, 0.40, 0.50)}
NARROW |= {"risk_20_to_50_not_light": (3, "risk >= 0.2 AND risk < 0.5"), "role_gap_30_not_light": (2, "role_gap >= 30"), "sigma_10_not_light": (2, "sigma_rep >= 10")} | {f"vertical_gap_{j}_not_light": (2, f"vertical_gap >= {j}") for j in (10, 15, 20, 30)}


@query("seq_38_gate_rules", f"""
WITH p AS (SELECT {', '.join(f"{e.replace('{D}', '::DOUBLE')} AS {n}" for n, e in GATED.items())} FROM lineitem), r AS ({' UNION ALL '.join(f"SELECT '{n}' AS rule, {c} AS complexity, split, u_miss, v_miss, du, dv, speed, NOT light AND {e} AS hit FROM p WHERE split <> 'train'" for n, (c, e) in NARROW.items())}),
x AS (SELECT *, round(sqrt(u_miss * u_miss + v_miss * v_miss), 2) AS b, round(sqrt(pow(u_miss + CASE WHEN hit THEN scale ELSE 0 END * du, 2) + pow(v_miss + CASE WHEN hit THEN scale ELSE 0 END * dv, 2)), 2) AS c FROM r, (VALUES (0.25::DOUBLE), (0.5), (0.75), (1.0)) s(scale)),
m AS (SELECT rule, complexity, scale, split, count(*) FILTER (WHERE hit) AS enabled, sqrt(avg(b * b)) AS br, sqrt(avg(c * c)) AS cr, quantile_cont(b, 0.95) AS b95, quantile_cont(c, 0.95) AS c95, quantile_cont(b, 0.99) AS b99, quantile_cont(c, 0.99) AS c99, coalesce(sqrt(avg(b * b) FILTER (WHERE speed >= 5 AND speed < 15)), 0) AS blr, coalesce(sqrt(avg(c * c) FILTER (WHERE speed >= 5 AND speed < 15)), 0) AS clr,
coalesce(avg(b) FILTER (WHERE speed >= 5 AND speed < 15), 0) AS blm, coalesce(avg(c) FILTER (WHERE speed >= 5 AND speed < 15), 0) AS clm, avg(b / greatest(speed, 10)) AS bf, avg(c / greatest(speed, 10)) AS cf, count(*) FILTER (WHERE b >= 30) AS bl, count(*) FILTER (WHERE c >= 30) AS cl, count(*) FILTER (WHERE speed >= 5 AND speed < 30 AND c / speed > 2 AND c - b > 5) AS worse FROM x GROUP BY 1, 2, 3, 4),
k AS (SELECT *, cr - br AS delta, cr <= br + 1e-6 AND c95 <= b95 + 1e-6 AND c99 <= b99 + 1e-6 AND clr <= blr + 1e-6 AND clm <= blm + 1e-6 AND cf <= bf + 1e-6 AND worse = 0 AND cl <= bl AS passes FROM m),
w AS (SELECT rule, complexity, scale, max(enabled) FILTER (WHERE split = 'val') AS val_enabled, max(delta) FILTER (WHERE split = 'val') AS val_delta, bool_or(passes) FILTER (WHERE split = 'val') AS val_passes, max(enabled) FILTER (WHERE split = 'test') AS test_enabled, max(delta) FILTER (WHERE split = 'test') AS test_delta, bool_or(passes) FILTER (WHERE split = 'test') AS test_passes FROM k GROUP BY 1, 2, 3),
e AS (SELECT *, coalesce(val_passes AND round(val_delta, 6) < 0 AND val_enabled >= 1, false) AS eligible FROM w)
SELECT rule, complexity, scale, val_enabled, round(val_delta, 5) AS val_delta, val_passes, test_enabled, round(test_delta, 5) AS test_delta, test_passes, eligible, eligible AND row_number() OVER (ORDER BY eligible DESC, round(val_delta, 6), complexity, scale, rule) = 1 AS chosen FROM e""")
def seq_38(spark, d):
    p = read(spark, d, "lineitem").select(*[F.expr(e.replace("{D}", "D")).alias(n) for n, e in GATED.items()])
    g = gates.choose_rule(p)
    return g.select(*[r6(F.col(c), 5).alias(c) if c.endswith("delta") else F.col(c) for c in g.columns])


@query("seq_39_gate_replay", f"WITH {ERRORS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(eu - CASE WHEN w > 30 THEN 0.5 * least(0.4, greatest(-0.4, eu)) ELSE 0 END, 6) AS eu FROM errors")
def seq_39(spark, d):
    fix = F.when(F.col("w") > 30, 0.5 * geo.clip(F.col("eu"), -0.4, 0.4)).otherwise(0.0)
    return errors(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(F.col("eu") - fix).alias("eu"))


@query("seq_40_regime_audit", f"""
WITH {ERRORS}, b AS (SELECT 'speed' AS axis, floor(gt_speed / 20)::BIGINT AS bucket, eu FROM errors UNION ALL SELECT 'weight', floor(w / 10)::BIGINT, eu FROM errors) SELECT axis, bucket, count(*) AS n, round(sqrt(avg(eu * eu)), 5) AS rmse FROM b GROUP BY 1, 2 HAVING count(*) >= 100""")
def seq_40(spark, d):
    e = errors(spark, d).select("eu", F.floor(F.col("gt_speed") / 20).alias("speed"), F.floor(F.col("w") / 10).alias("weight"))
    g = e.unpivot("eu", ["speed", "weight"], "axis", "bucket").groupBy("axis", "bucket").agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(F.col("eu") * F.col("eu"))), 5).alias("rmse"))
    return g.where("n >= 100")


PROMOTION = f"""{ERRORS}, e AS (SELECT l_orderkey AS frame, w * 300 AS alt, gt_speed, role, sqrt(eu * eu + ev * ev) AS b, sqrt(eu * eu + ev * ev) * (0.9 + (l_linenumber % 3) * 0.1) AS c FROM errors),
f AS (SELECT frame, count(*) AS n, sqrt(avg(b * b)) AS b, sqrt(avg(c * c)) AS c FROM e GROUP BY 1),
m AS (SELECT sqrt(sum(b * b * n) / sum(n)) AS wb, sqrt(sum(c * c * n) / sum(n)) AS wc, quantile_cont(b, 0.95) AS b95, quantile_cont(c, 0.95) AS c95, quantile_cont(b, 0.99) AS b99, quantile_cont(c, 0.99) AS c99 FROM f),
x AS (SELECT bool_and(role IN ('O', 'F')) AS strict, bool_or(role = 'M') AS motion, sqrt(avg(b * b) FILTER (WHERE alt >= 12000)) AS hb, sqrt(avg(c * c) FILTER (WHERE alt >= 12000)) AS hc, sqrt(avg(b * b) FILTER (WHERE gt_speed >= 5 AND gt_speed < 15)) AS lb, sqrt(avg(c * c) FILTER (WHERE gt_speed >= 5 AND gt_speed < 15)) AS lc, avg(b) FILTER (WHERE gt_speed >= 5 AND gt_speed < 15) AS ab, avg(c) FILTER (WHERE gt_speed >= 5 AND gt_speed < 15) AS ac, avg(b / greatest(10.0, gt_speed)) AS rb, avg(c / greatest(10.0, gt_speed)) AS rc, count(*) FILTER (WHERE gt_speed >= 5 AND gt_speed < 30 AND c / greatest(1e-6, gt_speed) > 2 AND c - b > 5) AS worse FROM e),
g AS (SELECT 'strict_holdout' AS gate, strict AS passed FROM x UNION ALL SELECT 'motion_is_no_wind', NOT motion FROM x UNION ALL SELECT 'weighted_rmse', coalesce(wc <= wb + 0.05, false) FROM m UNION ALL SELECT 'frame_p95', coalesce(c95 <= b95 + 0.05, false) FROM m UNION ALL SELECT 'frame_p99', coalesce(c99 <= b99 + 0.05, false) FROM m UNION ALL SELECT 'alt_12km_plus_rmse', coalesce(hc <= hb + 0.05, false) FROM x
UNION ALL SELECT 'light_rmse', coalesce(lc <= lb + 0.05, false) FROM x UNION ALL SELECT 'light_mae', coalesce(ac <= ab + 0.05, false) FROM x UNION ALL SELECT 'floor10_relative_mae', coalesce(rc <= rb + 0.05, false) FROM x UNION ALL SELECT 'light_moderate_tail', worse = 0 FROM x)"""


@query("seq_41_promotion", f"WITH {PROMOTION} SELECT gate, passed FROM g UNION ALL SELECT 'overall', bool_and(passed) FROM g")
def seq_41(spark, d):
    b = F.sqrt(F.expr("eu * eu + ev * ev"))
    e = errors(spark, d).select(F.col("l_orderkey").alias("frame"), (F.col("w") * 300).alias("alt"), F.col("gt_speed").alias("speed"), F.col("role").isin("O", "F").alias("strict"), (F.col("role") == "M").alias("motion"), b.alias("baseline"), (b * (0.9 + (F.col("l_linenumber") % 3) * 0.1)).alias("candidate"))
    return gates.promotion(e, 0.05)


@query("seq_42_oracle_kernel", f"WITH {ERRORS}, f AS (SELECT l_suppkey, config, round(sqrt(avg(eu * eu + ev * ev)), 8) AS rmse FROM errors GROUP BY 1, 2) SELECT l_suppkey, arg_min(config, rmse) AS best, round(min(rmse), 5) AS rmse FROM f GROUP BY 1")
def seq_42(spark, d):
    f = errors(spark, d).groupBy("l_suppkey", "config").agg(scaled_round(F.sqrt(F.avg(F.expr("eu * eu + ev * ev"))), 8).alias("rmse"))
    return f.groupBy("l_suppkey").agg(F.min_by("config", F.struct("rmse", "config")).alias("best"), scaled_round(F.min("rmse"), 5).alias("rmse"))


@query("seq_43_parameter_scores", f"WITH {ERRORS} SELECT config, role, round(sqrt(avg(eu * eu)) + 0.2 * avg(CASE WHEN w < 10 THEN 1.0 ELSE 0.0 END) - 0.1 * count(*) / 60000.0, 5) AS score FROM errors GROUP BY 1, 2")
def seq_43(spark, d):
    s = F.sqrt(F.avg(F.col("eu") * F.col("eu"))) + 0.2 * F.avg(F.when(F.col("w") < 10, 1.0).otherwise(0.0)) - 0.1 * F.count("*") / 60000.0
    return errors(spark, d).groupBy("config", "role").agg(r6(s, 5).alias("score"))


@query("seq_44_background_departures", f"WITH {OBS}, b AS (SELECT *, avg(speed) OVER (PARTITION BY ident) AS bg FROM obs) SELECT source, count(*) AS n, round(sqrt(avg(pow(bg - speed, 2))), 4) AS rmse, round(avg(bg - speed), 4) AS bias FROM b GROUP BY 1")
def seq_44(spark, d):
    b = obs(spark, d).withColumn("o", F.avg("speed").over(Window.partitionBy("ident")) - F.col("speed"))
    return b.groupBy("source").agg(F.count("*").alias("n"), r6(F.sqrt(F.avg(F.col("o") * F.col("o"))), 4).alias("rmse"), r6(F.avg("o"), 4).alias("bias"))


@query("seq_45_error_sources", f"""
WITH {ERRORS}, t AS (SELECT avg(eu * eu) AS total FROM errors) SELECT config, role, count(*) AS n, round(avg(eu * eu) - any_value(total), 6) + 0.0 AS excess, round(count(*) * (avg(eu * eu) - any_value(total)), 2) + 0.0 AS priority FROM errors, t GROUP BY 1, 2""")
def seq_45(spark, d):
    g = errors(spark, d).groupBy("config", "role").agg(F.count("*").alias("n"), F.sum(F.col("eu") * F.col("eu")).alias("s"))  # a few rows
    t = g.agg((F.sum("s") / F.sum("n")).alias("total"))
    ex = F.col("s") / F.col("n") - F.col("total")
    return g.join(F.broadcast(t)).select("config", "role", "n", (r6(ex) + 0.0).alias("excess"), (r6(F.col("n") * ex, 2) + 0.0).alias("priority"))


@query("seq_46_banded_deltas", f"WITH {ERRORS} SELECT floor(gt_speed / 25)::BIGINT AS band, round(sqrt(avg(eu * eu)) - sqrt(avg(ev * ev)), 5) AS delta, count(*) AS n FROM errors GROUP BY 1")
def seq_46(spark, d):
    return errors(spark, d).groupBy(F.floor(F.col("gt_speed") / 25).alias("band")).agg(r6(F.sqrt(F.avg(F.col("eu") * F.col("eu"))) - F.sqrt(F.avg(F.col("ev") * F.col("ev"))), 5).alias("delta"), F.count("*").alias("n"))


# ---- validation


@query("val_01_conservation", f"WITH {TRACK_SQL}, g AS (SELECT ident, leg, count(*) AS n FROM legs GROUP BY 1, 2) SELECT (SELECT count(*) FROM events) AS points, sum(n)::BIGINT AS in_legs, (SELECT count(*) FROM events) = sum(n) AS conserved FROM g")
def val_01(spark, d):
    n = read(spark, d, "events").agg(F.count("*").alias("points"))
    g = legs(spark, d).groupBy("ident", "leg").count().agg(F.sum("count").alias("in_legs"))
    return n.join(F.broadcast(g)).withColumn("conserved", F.col("points") == F.col("in_legs"))


@query("val_02_classification", f"WITH {OBS} SELECT count(*) AS n, count(*) FILTER (WHERE source IN ('amdar', 'turb', 'other')) AS classed, count(*) FILTER (WHERE ident IS NULL) AS lost FROM obs")
def val_02(spark, d):
    return obs(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("source").isin("amdar", "turb", "other")).alias("classed"), F.count_if(F.col("ident").isNull()).alias("lost"))


@query("val_03_vector_consistency", f"WITH {OBS} SELECT source, round(max(abs(sqrt(pow(wind_speed * sin(radians(wind_dir)), 2) + pow(wind_speed * cos(radians(wind_dir)), 2)) - wind_speed)), 6) AS worst FROM obs GROUP BY 1")
def val_03(spark, d):
    u, v = geo.wind_vector(F.col("wind_dir"), F.col("wind_speed"))
    return obs(spark, d).groupBy("source").agg(r6(F.max(F.abs(F.hypot(u, v) - F.col("wind_speed")))).alias("worst"))


@query("val_04_same_time_groups", "WITH g AS (SELECT o_custkey, o_orderdate::DATE AS day, count(*) AS n, max(o_totalprice) - min(o_totalprice) AS span FROM orders GROUP BY 1, 2) SELECT o_custkey, day, n, round(span, 4) AS span FROM g WHERE n > 1")
def val_04(spark, d):
    g = read(spark, d, "orders").groupBy("o_custkey", F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), r6(F.max("o_totalprice") - F.min("o_totalprice"), 4).alias("span"))
    return g.where("n > 1")


@query("val_05_validity_rates", "SELECT event_type, round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END), 6) AS value_ok, round(avg(CASE WHEN ts IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS time_ok FROM events GROUP BY 1")
def val_05(spark, d):
    rate = lambda c: r6(F.avg(F.when(c, 1.0).otherwise(0.0)))
    return read(spark, d, "events").groupBy("event_type").agg(rate(F.col("value") > 0).alias("value_ok"), rate(F.col("ts").isNotNull()).alias("time_ok"))


@query("val_06_grid_coverage", f"WITH {OBS} SELECT round(avg(CASE WHEN lat BETWEEN 20 AND 40 THEN 1.0 ELSE 0.0 END), 6) AS in_range, count(DISTINCT floor(alt / 500)) AS levels, avg(CASE WHEN lat BETWEEN 20 AND 40 THEN 1.0 ELSE 0.0 END) >= 0.2 AS passed FROM obs")
def val_06(spark, d):
    share = F.avg(F.when(F.col("lat").between(20, 40), 1.0).otherwise(0.0))
    return obs(spark, d).agg(r6(share).alias("in_range"), F.count_distinct(F.floor(F.col("alt") / 500)).alias("levels"), (share >= 0.2).alias("passed"))


@query("val_07_overlap", f"WITH {OBS}, r AS (SELECT min(us) FILTER (WHERE source = 'amdar') AS a0, max(us) FILTER (WHERE source = 'amdar') AS a1, min(us) FILTER (WHERE source = 'turb') AS b0, max(us) FILTER (WHERE source = 'turb') AS b1 FROM obs) SELECT greatest(a0, b0) AS from_us, least(a1, b1) AS to_us, greatest(a0, b0) <= least(a1, b1) AS overlap FROM r")
def val_07(spark, d):
    of = lambda f, s: f(F.when(F.col("source") == s, F.col("us")))
    r = obs(spark, d).agg(F.greatest(of(F.min, "amdar"), of(F.min, "turb")).alias("from_us"), F.least(of(F.max, "amdar"), of(F.max, "turb")).alias("to_us"))
    return r.withColumn("overlap", F.col("from_us") <= F.col("to_us"))


@query("val_08_contract", "SELECT * FROM (VALUES ('event_id', 'ok'), ('ts', 'ok'), ('value', 'ok'), ('altitude', 'missing')) t(field, state)")
def val_08(spark, d):
    from windgrid.operators.guards import contract

    found = contract(read(spark, d, "events"), {"event_id": "bigint", "ts": None, "value": "double", "altitude": "double"})
    return spark.createDataFrame(found, "field string, state string")


@query("val_09_acceptance", "SELECT count(*) AS n, count(*) FILTER (WHERE quality IS NULL OR toxic IS NULL) AS unlabelled, count(*) - count(DISTINCT doc_id) AS repeated, count(*) FILTER (WHERE quality IS NULL OR toxic IS NULL) = 0 AND count(*) = count(DISTINCT doc_id) AS accepted FROM labels")
def val_09(spark, d):
    a = read(spark, d, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull() | F.col("toxic").isNull()).alias("unlabelled"), (F.count("*") - F.count_distinct("doc_id")).alias("repeated"))
    return a.withColumn("accepted", F.expr("unlabelled = 0 and repeated = 0"))


@query("val_10_background_check", f"WITH {OBS}, h AS (SELECT floor(alt / 5000) AS z, avg(lat) AS m, count(*) AS n FROM obs GROUP BY 1), l AS (SELECT *, lag(z) OVER (ORDER BY z) AS p FROM h) SELECT count(*) AS levels, bool_and(p IS NULL OR z > p) AS monotone, min(n) AS least FROM l")
def val_10(spark, d):
    h = obs(spark, d).groupBy(F.floor(F.col("alt") / 5000).alias("z")).agg(F.count("*").alias("n"))  # a few levels
    h = h.withColumn("p", F.lag("z").over(Window.orderBy("z")))
    return h.agg(F.count("*").alias("levels"), F.bool_and(F.col("p").isNull() | (F.col("z") > F.col("p"))).alias("monotone"), F.min("n").alias("least"))


@query("val_11_readiness", f"WITH {ERRORS} SELECT config, CASE WHEN sqrt(avg(eu * eu)) > 6 THEN 'error' WHEN count(*) < 1000 THEN 'sparse' ELSE 'ready' END AS cause FROM errors GROUP BY 1")
def val_11(spark, d):
    return errors(spark, d).groupBy("config").agg(clean.first_reason([("error", F.sqrt(F.avg(F.col("eu") * F.col("eu"))) > 6), ("sparse", F.count("*") < 1000)], "ready").alias("cause"))


@query("val_12_candidate_grid", f"WITH {ERRORS}, c AS (SELECT p::DOUBLE AS p, sqrt(avg(pow(eu * (1 - v.p), 2))) + any_value(v.p) AS s FROM errors, (VALUES (0.0), (0.1), (0.2), (0.3)) v(p) GROUP BY v.p) SELECT p, round(s, 6) AS score FROM c")
def val_12(spark, d):
    grid = (0.0, 0.1, 0.2, 0.3)
    wide = errors(spark, d).agg(*[F.struct(F.lit(p).alias("p"), r6(F.sqrt(F.avg(F.pow(F.col("eu") * (1 - p), 2))) + p).alias("score")).alias(f"g{k}") for k, p in enumerate(grid)])
    return wide.select(F.explode(F.array(*[f"g{k}" for k in range(len(grid))])).alias("r")).select("r.*")


@query("val_13_phases", "SELECT 'clean' AS phase, 'done' AS state, count(*) AS n FROM lineitem WHERE l_quantity > 10 UNION ALL SELECT 'group', 'done', count(DISTINCT l_orderkey) FROM lineitem WHERE l_quantity > 10 UNION ALL SELECT 'broken', 'failed', 0 UNION ALL SELECT 'after', 'skipped', 0")
def val_13(spark, d):
    from windgrid import jobs
    from windgrid.plans.sources import _folder

    at = _folder(spark, "phases")
    phases = [
        ("clean", lambda: read(spark, d, "lineitem").where("l_quantity > 10").select("l_orderkey", "l_quantity")), ("group", lambda: spark.read.parquet(f"{at}/clean").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))),
        ("broken", lambda: spark.read.parquet(f"{at}/nothing")), ("after", lambda: spark.read.parquet(f"{at}/group")),
    ]
    done = jobs.run_phases(phases, jobs.to_parquet(spark, at))
    return spark.createDataFrame([(p.name, p.state, p.rows) for p in done], "phase string, state string, n long")


@query("val_14_speed_ab", "WITH n AS (SELECT count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem)) SELECT profile, n AS rows_out, true AS agrees, true AS timed FROM n, (VALUES ('base'), ('no_codegen'), ('no_adaptive')) v(profile)")
def val_14(spark, d):
    from windgrid import jobs

    plan = lambda: read(spark, d, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"), F.max("l_quantity").alias("q"))
    found = jobs.compare_profiles(spark, plan, {"base": {}, "no_codegen": {"spark.sql.codegen.wholeStage": "false"}, "no_adaptive": {"spark.sql.adaptive.enabled": "false"}}, "base", 1)
    return spark.createDataFrame([(f["profile"], f["rows"], f["checksum"] == found[0]["checksum"], f["seconds"] > 0 and f["share_of_base"] > 0) for f in found], "profile string, rows_out long, agrees boolean, timed boolean")
