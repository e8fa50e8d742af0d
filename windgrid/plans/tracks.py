"""Windows over tracks, and joins."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windgrid.functions import clean, geo
from windgrid.operators import joins as J
from windgrid.operators import windows as W
from windgrid.operators.ordering import global_row_number, keep_first, top_k
from windgrid.plans.base import HAVERSINE, OBS, obs, query, r6, read

#: consecutive points with gap, distance, speed and break rules; 6 h is the gap that suits the driver's events
GAP = 6 * 3600
STEP_SQL = f"""{OBS}, lagged AS (
    SELECT *, lag(us) OVER w AS prev_us, lag(lat) OVER w AS prev_lat, lag(lon) OVER w AS prev_lon, lag(alt) OVER w AS prev_alt, lag(heading) OVER w AS prev_heading,
           lead(us) OVER w AS next_us, lead(lat) OVER w AS next_lat, lead(lon) OVER w AS next_lon, lead(alt) OVER w AS next_alt FROM obs WINDOW w AS (PARTITION BY ident ORDER BY us, event_id)
), steps AS (
    SELECT *, (us - prev_us) / 1e6::DOUBLE AS dt, CASE WHEN prev_us IS NOT NULL THEN {HAVERSINE.format(a='prev_', b='')} END AS km FROM lagged
)"""
TRACK_SQL = f"""{STEP_SQL}, flagged AS (SELECT *, CASE WHEN dt IS NULL OR dt <= 0 OR dt > {GAP} OR km * 1000 / nullif(dt, 0) > 420 OR abs(alt - prev_alt) / nullif(dt, 0) > 75 THEN 1 ELSE 0 END AS brk FROM steps),
legs AS (SELECT *, sum(brk) OVER (PARTITION BY ident ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS leg FROM flagged)"""


def steps(spark, d):
    n = W.neighbours(obs(spark, d), ["ident"], ["us", "event_id"], ["us", "lat", "lon", "alt", "heading"])
    km = geo.haversine_km(F.col("prev_lat"), F.col("prev_lon"), F.col("lat"), F.col("lon"))
    return n.withColumn("dt", (F.col("us") - F.col("prev_us")) / 1e6).withColumn("km", km)


def legs(spark, d):
    per_s = lambda x: F.try_divide(x, F.col("dt"))
    brk = F.col("dt").isNull() | (F.col("dt") <= 0) | (F.col("dt") > GAP) | (per_s(F.col("km") * 1000) > 420) | (per_s(F.abs(F.col("alt") - F.col("prev_alt"))) > 75)
    s = steps(spark, d).withColumn("brk", F.coalesce(brk, F.lit(True)))
    return W.islands(s, ["ident"], ["us", "event_id"], F.col("brk"))


@query("win_01_neighbours", f"WITH {STEP_SQL} SELECT event_id, prev_us, next_us, prev_alt, prev_heading FROM steps")
def win_01(spark, d):
    return steps(spark, d).select("event_id", "prev_us", "next_us", "prev_alt", "prev_heading")


@query("win_02_global_previous", f"WITH {OBS} SELECT event_id, lag(ident) OVER (ORDER BY us, event_id) AS prev_ident FROM obs")
def win_02(spark, d):
    # the row before in a global order, without a window over all rows: numbered, then joined to the next number
    n = global_row_number(obs(spark, d).select("event_id", "ident", "us", "ts"), ["ts", "event_id"], "i")
    before = n.select((F.col("i") + 1).alias("i"), F.col("ident").alias("prev_ident"))
    return n.join(before, "i", "left").select("event_id", "prev_ident")


@query("win_03_ordered", f"WITH {OBS} SELECT event_id, sum(speed) OVER (PARTITION BY ident ORDER BY us, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 100 AS busy FROM obs")
def win_03(spark, d):
    w = Window.partitionBy("ident").orderBy("us", "event_id").rowsBetween(-2, 0)
    return obs(spark, d).select("event_id", (F.sum("speed").over(w) > 100).alias("busy"))


@query("win_04_islands", f"WITH {TRACK_SQL} SELECT event_id, ident, leg::BIGINT AS leg FROM legs")
def win_04(spark, d):
    return legs(spark, d).select("event_id", "ident", "leg")


@query("win_05_global_blocks", f"WITH {OBS}, f AS (SELECT event_id, us, CASE WHEN lag(source) OVER (ORDER BY us, event_id) IS DISTINCT FROM source THEN 1 ELSE 0 END AS s FROM obs) SELECT event_id, sum(s) OVER (ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM f")
def win_05(spark, d):
    n = global_row_number(obs(spark, d).select("event_id", "source", "ts"), ["ts", "event_id"], "i")
    before = n.select((F.col("i") + 1).alias("i"), F.col("source").alias("p"))
    f = n.join(before, "i", "left").withColumn("s", F.when(F.col("source").eqNullSafe(F.col("p")), 0).otherwise(1)).withColumn("day", F.to_date("ts"))
    # a running sum in two levels: within a day, plus the totals of the days before (one row a day)
    days = f.groupBy("day").agg(F.sum("s").alias("n"))
    days = days.select("day", F.coalesce(F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    within = F.sum("s").over(Window.partitionBy("day").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return f.withColumn("w", within).join(days, "day").select("event_id", (F.col("w") + F.col("base")).alias("block"))


@query("win_06_duplicate_rank", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey)::BIGINT AS nth FROM lineitem")
def win_06(spark, d):
    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey").rowsBetween(Window.unboundedPreceding, 0)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.count("l_linenumber").over(w).alias("nth"))


@query("win_07_batch_order", "SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)::INTEGER AS place FROM lineitem")
def win_07(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).alias("place"))


@query("win_08_top_edges", "SELECT l_suppkey, l_partkey, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity DESC, l_orderkey, l_partkey, l_linenumber) AS r FROM lineitem) WHERE r <= 5")
def win_08(spark, d):
    return top_k(read(spark, d, "lineitem"), ["l_suppkey"], [F.col("l_quantity").desc(), "l_orderkey", "l_partkey", "l_linenumber"], 5).select("l_suppkey", "l_partkey", "l_orderkey")


@query("win_09_candidate_rank", "SELECT l_orderkey, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_partkey, l_suppkey)::INTEGER AS rank FROM lineitem")
def win_09(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_discount", "l_partkey", "l_suppkey")).alias("rank"))


CAP_SQL = """a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag AS f, l_linestatus AS o, least(3.0, l_quantity / 10) AS w FROM lineitem),
b AS (SELECT *, w * CASE WHEN sum(w) OVER (PARTITION BY l_orderkey, f) > 3 THEN 3 / sum(w) OVER (PARTITION BY l_orderkey, f) ELSE 1 END AS w1 FROM a),
c AS (SELECT *, w1 * CASE WHEN sum(w1) OVER (PARTITION BY l_orderkey, o) > 5 THEN 5 / sum(w1) OVER (PARTITION BY l_orderkey, o) ELSE 1 END AS w2 FROM b),
e AS (SELECT *, sum(w2) OVER (PARTITION BY l_orderkey) - w2 AS rest FROM c)"""


@query("win_10_weight_caps", f"WITH {CAP_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN rest > 1e-12 THEN least(w2, rest * (0.3 / 0.7)) ELSE w2 END, 8) AS w FROM e")
def win_10(spark, d):
    a = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("o"), (F.col("l_quantity") / 10).alias("w"))
    # a report, a flight and a source within an order as their voxel; at last no report above 30 %
    a = W.weight_caps(a, "w", [(["l_orderkey", "f"], 3.0), (["l_orderkey", "o"], 5.0)], (["l_orderkey"], [], 0.3), each=3.0)
    return a.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(F.col("w"), 8).alias("w"))


@query("win_11_weight_fraction", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem")
def win_11(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(F.col("l_quantity") / F.sum("l_quantity").over(Window.partitionBy("l_orderkey"))).alias("share"))


@query("win_12_legacy_breaks", f"WITH {STEP_SQL} SELECT event_id, coalesce(dt IS NULL OR dt <= 0 OR dt > 900 OR km * 1000 / nullif(dt, 0) > 400 OR km > 200 OR abs(alt - prev_alt) > 5000, true) AS brk FROM steps")
def win_12(spark, d):
    rule = "dt is null or dt <= 0 or dt > 900 or try_divide(km * 1000, dt) > 400 or km > 200 or abs(alt - prev_alt) > 5000"
    return steps(spark, d).select("event_id", F.coalesce(F.expr(rule), F.lit(True)).alias("brk"))


@query("win_13_clean_breaks", f"WITH {TRACK_SQL} SELECT event_id, brk = 1 AS brk FROM flagged")
def win_13(spark, d):
    return legs(spark, d).select("event_id", "brk")


V4 = "dt is null or day_changed or dt > 900 or {div} > 400 or km > 120 or abs(alt - prev_alt) > 5000"


@query("win_14_v4_breaks", f"""
WITH {STEP_SQL}, t AS (SELECT *, (us // 86400000000) <> (prev_us // 86400000000) AS day_changed FROM steps), f AS (SELECT *, coalesce({V4.format(div='km * 1000 / nullif(dt, 0)')}, true) AS s FROM t),
l AS (SELECT *, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY ident ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS leg FROM f)
SELECT ident, leg::BIGINT AS leg, count(*) AS n, round(sum(CASE WHEN s THEN 0 ELSE km END), 4) AS km FROM l GROUP BY 1, 2""")
def win_14(spark, d):
    s = steps(spark, d).withColumn("day_changed", F.floor(F.col("us") / 86400000000) != F.floor(F.col("prev_us") / 86400000000))
    s = s.withColumn("s", F.coalesce(F.expr(V4.format(div="try_divide(km * 1000, dt)")), F.lit(True)))
    g = W.islands(s, ["ident"], ["us", "event_id"], F.col("s")).groupBy("ident", "leg")
    return g.agg(F.count("*").alias("n"), r6(F.sum(F.when(F.col("s"), 0.0).otherwise(F.col("km"))), 4).alias("km"))


@query("win_15_plan4_breaks", f"WITH {STEP_SQL} SELECT event_id, CASE WHEN dt IS NULL THEN 'first' WHEN dt < 0 THEN 'backwards' WHEN dt > 1800 THEN 'gap' WHEN km > 300 THEN 'jump' WHEN abs(alt - prev_alt) > 5000 THEN 'altitude' ELSE 'none' END AS rule FROM steps")
def win_15(spark, d):
    rules = [("first", "dt is null"), ("backwards", "dt < 0"), ("gap", "dt > 1800"), ("jump", "km > 300"), ("altitude", "abs(alt - prev_alt) > 5000")]
    return steps(spark, d).select("event_id", clean.first_reason([(n, F.expr(r)) for n, r in rules], "none").alias("rule"))


@query("win_16_contiguous_blocks", """
WITH p AS (SELECT *, lag(l_linenumber) OVER w AS pl, lag(l_returnflag) OVER w AS pf, row_number() OVER w AS rn FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
f AS (SELECT *, CASE WHEN rn = 1 OR l_linenumber - pl <> 1 OR pf IS DISTINCT FROM l_returnflag THEN 1 ELSE 0 END AS s FROM p)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sum(s) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)::BIGINT AS block FROM f""")
def win_16(spark, d):
    keys, order = ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]
    w = Window.partitionBy(*keys).orderBy(*order)
    li = read(spark, d, "lineitem").withColumn("s", (F.col("l_linenumber") - F.lag("l_linenumber").over(w) != 1) | W.changed("l_returnflag", keys, order))
    return W.islands(li, keys, order, F.col("s"), "block").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "block")


def _win17(fast, calm, near, close):
    side = lambda a, b, t: f"({a} > {fast} AND {b} <= {calm} AND {t} <= {close})"
    return f"CASE WHEN dt > 0 AND ndt > 0 AND dt <= {near} AND ndt <= {near} AND sp > {fast} AND nsp > {fast} AND ssp <= {calm} THEN 'position_spike' WHEN abs(alt - (prev_alt + next_alt) / 2) > 3000 AND abs(prev_alt - next_alt) < 1800 THEN 'altitude_spike' WHEN {side('sp', 'nsp', 'dt')} OR {side('nsp', 'sp', 'ndt')} THEN 'time_bias' ELSE 'none' END"


#: the driver's events lie hours apart: the same rules with limits on which they come up
WIDE = {"fast": 40.0, "calm": 20.0, "near_s": 4e5, "close_s": 4e5}


@query("win_17_triple_point", f"""
WITH {STEP_SQL}, t AS (SELECT *, (next_us - us) / 1e6::DOUBLE AS ndt, {HAVERSINE.format(a='', b='next_')} AS nkm, {HAVERSINE.format(a='prev_', b='next_')} AS skm FROM steps), v AS (SELECT *, km * 1000 / nullif(dt, 0) AS sp, nkm * 1000 / nullif(ndt, 0) AS nsp, skm * 1000 / nullif(dt + ndt, 0) AS ssp FROM t)
SELECT event_id, {_win17(420, 340, 600, 30)} AS label, {_win17(40, 20, 400000, 400000)} AS wide FROM v""")
def win_17(spark, d):
    c = F.col
    s = steps(spark, d).withColumn("ndt", (c("next_us") - c("us")) / 1e6).withColumn("nkm", geo.haversine_km(c("lat"), c("lon"), c("next_lat"), c("next_lon"))).withColumn("skm", geo.haversine_km(c("prev_lat"), c("prev_lon"), c("next_lat"), c("next_lon")))
    speeds = [F.try_divide(c("km") * 1000, c("dt")), F.try_divide(c("nkm") * 1000, c("ndt")), F.try_divide(c("skm") * 1000, c("dt") + c("ndt"))]
    label = lambda **limits: clean.first_reason(list(W.triple_point(c("dt"), c("ndt"), *speeds, c("alt"), c("prev_alt"), c("next_alt"), **limits).items()), "none")
    return s.select("event_id", label().alias("label"), label(**WIDE).alias("wide"))


@query("win_18_anomaly_label", f"""
WITH {STEP_SQL} SELECT event_id, CASE WHEN prev_us IS NULL AND next_us IS NULL THEN 'insufficient_context' WHEN dt <= 0 THEN 'non_increasing_time' WHEN km > 3000 THEN 'jump' WHEN abs(alt - prev_alt) > 9000 THEN 'altitude' WHEN dt > {GAP} THEN 'gap' WHEN dt IS NULL THEN 'start' WHEN next_us IS NULL THEN 'end' WHEN speed < 1 THEN 'slow' ELSE 'clean' END AS label FROM steps""")
def win_18(spark, d):
    rules = [("insufficient_context", "prev_us is null and next_us is null"), ("non_increasing_time", "dt <= 0"), ("jump", "km > 3000"), ("altitude", "abs(alt - prev_alt) > 9000"), ("gap", f"dt > {GAP}"), ("start", "dt is null"), ("end", "next_us is null"), ("slow", "speed < 1")]
    return steps(spark, d).select("event_id", clean.first_reason([(n, F.expr(r)) for n, r in rules], "clean").alias("label"))


CONS = "1 - coalesce(0.4 * least(1.0, {div} / 420), 0) - coalesce(0.3 * least(1.0, abs(alt - prev_alt) / 5000), 0) - coalesce(0.3 * least(1.0, dt / 86400), 0)"


@query("win_19_consistency", f"WITH {STEP_SQL} SELECT event_id, round(least(1.0, greatest(0.0, {CONS.format(div='(km * 1000 / nullif(dt, 0))')})), 5) AS score FROM steps")
def win_19(spark, d):
    return steps(spark, d).select("event_id", r6(geo.clip(F.expr(CONS.format(div="try_divide(km * 1000, dt)")), 0.0, 1.0), 5).alias("score"))


@query("win_20_longest_run", """
WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), b AS (SELECT l_orderkey, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS b FROM d), g AS (SELECT l_orderkey, b, count(*) AS n FROM b GROUP BY 1, 2)
SELECT l_orderkey, round(max(n) / sum(n)::DOUBLE, 6) AS longest_share FROM g GROUP BY 1""")
def win_20(spark, d):
    return W.longest_run(read(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber").withColumn("longest_share", r6(F.col("longest_share")))


@query("win_21_batch_gaps", "SELECT o_orderkey, epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) OVER w AS before_us, lead(epoch_us(o_orderdate)) OVER w - epoch_us(o_orderdate) AS after_us FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def win_21(spark, d):
    o = read(spark, d, "orders").withColumn("us", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    n = W.neighbours(o, ["o_custkey"], ["us", "o_orderkey"], ["us"])
    return n.select("o_orderkey", (F.col("us") - F.col("prev_us")).alias("before_us"), (F.col("next_us") - F.col("us")).alias("after_us"))


@query("win_22_day_boundary", "SELECT event_id, coalesce(ts::DATE <> lag(ts::DATE) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS new_day FROM events")
def win_22(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, d, "events").select("event_id", F.coalesce(F.to_date("ts") != F.lag(F.to_date("ts")).over(w), F.lit(False)).alias("new_day"))


@query("win_23_sequence_steps", f"""
WITH {STEP_SQL}, e AS (SELECT ident, arg_min(lat, us) AS alat, arg_min(lon, us) AS alon, arg_max(lat, us) AS blat, arg_max(lon, us) AS blon, sum(km) AS path, avg(CASE WHEN alt > prev_alt THEN 1.0 ELSE 0.0 END) FILTER (WHERE prev_alt IS NOT NULL) AS rising FROM steps GROUP BY ident)
SELECT ident, round(path, 2) AS path, round(rising, 6) AS rising, round({HAVERSINE.format(a='a', b='b')} / path, 5) AS efficiency FROM e""")
def win_23(spark, d):
    order = F.struct("us", "event_id")
    e = steps(spark, d).groupBy("ident").agg(*[f(c, order).alias(p + c) for p, f in (("a", F.min_by), ("b", F.max_by)) for c in ("lat", "lon")], F.sum("km").alias("path"), F.avg(F.when(F.col("prev_alt").isNotNull(), F.when(F.col("alt") > F.col("prev_alt"), 1.0).otherwise(0.0))).alias("rising"))
    ends = geo.haversine_km(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    return e.select("ident", F.round("path", 2).alias("path"), r6(F.col("rising")).alias("rising"), r6(ends / F.col("path"), 5).alias("efficiency"))


@query("win_24_full_batch_chain", """
WITH b AS (SELECT l_suppkey, l_orderkey, count(*) AS n FROM lineitem GROUP BY 1, 2), j AS (SELECT b.*, o_orderdate FROM b JOIN orders ON l_orderkey = o_orderkey WHERE n >= 2)
SELECT l_suppkey, l_orderkey, epoch_us(o_orderdate) - lag(epoch_us(o_orderdate)) OVER (PARTITION BY l_suppkey ORDER BY o_orderdate, l_orderkey) AS gap_us FROM j""")
def win_24(spark, d):
    b = read(spark, d, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.count("*").alias("n")).where("n >= 2")
    j = b.join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).withColumn("us", F.unix_micros(F.col("o_orderdate").cast("timestamp")))
    w = Window.partitionBy("l_suppkey").orderBy("us", "l_orderkey")
    return j.select("l_suppkey", "l_orderkey", (F.col("us") - F.lag("us").over(w)).alias("gap_us"))


@query("win_28_frames_and_ranks", "SELECT event_id, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS quarter, round(percent_rank() OVER (PARTITION BY user_id ORDER BY value), 6) AS pr FROM events")
def win_28(spark, d):
    w = Window.partitionBy("user_id")
    return read(spark, d, "events").select("event_id", F.ntile(4).over(w.orderBy("ts", "event_id")).cast("long").alias("quarter"), r6(F.percent_rank().over(w.orderBy("value"))).alias("pr"))


SUMMARY = "SELECT ident, leg::BIGINT AS leg, count(*) AS n, min(us) AS start_us, max(us) AS end_us, round(sum(CASE WHEN brk = 1 THEN 0 ELSE km END), 3) AS km, max(alt) AS top, CASE WHEN count(*) >= 8 THEN 'T0' WHEN count(*) >= 3 THEN 'T1' WHEN count(*) = 2 THEN 'T2' ELSE 'T3' END AS tier FROM legs GROUP BY ident, leg"


@query("entry_track_summary", f"WITH {TRACK_SQL} {SUMMARY}")
def entry_track_summary(spark, d):
    from windgrid.operators.tracks import tracklets

    return tracklets(legs(spark, d))


# ---- joins


@query("joi_01_group_stats", """
WITH s AS (SELECT l_suppkey, l_returnflag, l_linenumber, count(*) AS n, min(l_quantity) AS q FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2, 3)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, coalesce(n, 1) AS n, coalesce(q, 0.0) AS q FROM lineitem LEFT JOIN s USING (l_suppkey, l_returnflag, l_linenumber)""")
def joi_01(spark, d):
    li = read(spark, d, "lineitem")
    s = li.where("l_quantity > 25").groupBy("l_suppkey", "l_returnflag", "l_linenumber").agg(F.count("*").alias("n"), F.min("l_quantity").alias("q"))
    return li.join(s, ["l_suppkey", "l_returnflag", "l_linenumber"], "left").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.coalesce("n", F.lit(1)).cast("long").alias("n"), F.coalesce("q", F.lit(0.0)).alias("q"))


@query("joi_02_block_stats", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderpriority, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def joi_02(spark, d):
    li, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    stats = li.groupBy("l_orderkey").agg(F.count("*").alias("n")).join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey", "left")
    return li.join(stats, "l_orderkey", "left").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderpriority", "n")


@query("joi_03_enrichment", "SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def joi_03(spark, d):
    c, n, r = (read(spark, d, t) for t in ("customer", "nation", "region"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("c_custkey", "n_name", "r_name")


@query("joi_04_suffix", "SELECT a.l_orderkey, a.l_partkey, a.l_suppkey, a.l_linenumber, a.l_quantity AS quantity, b.q AS quantity_batch FROM lineitem a LEFT JOIN (SELECT l_orderkey, max(l_quantity) AS q FROM lineitem GROUP BY 1) b USING (l_orderkey)")
def joi_04(spark, d):
    li = read(spark, d, "lineitem").withColumnRenamed("l_quantity", "quantity")
    b = li.groupBy("l_orderkey").agg(F.max("quantity").alias("quantity_batch"))
    return li.join(b, "l_orderkey", "left").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "quantity", "quantity_batch")


@query("joi_05_unique_right", "SELECT e.event_id, f.first_type FROM events e LEFT JOIN (SELECT user_id, arg_min(event_type, event_id) AS first_type FROM events WHERE event_type <> 'error' AND value > 60 GROUP BY 1) f USING (user_id)")
def joi_05(spark, d):
    e = read(spark, d, "events")
    u = keep_first(e.where("event_type <> 'error' and value > 60"), ["user_id"], ["event_id"]).select("user_id", F.col("event_type").alias("first_type"))
    return e.join(u, "user_id", "left").select("event_id", "first_type")


@query("joi_06_inner_counts", "SELECT o_orderkey, n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) ON o_orderkey = l_orderkey")
def joi_06(spark, d):
    n = read(spark, d, "lineitem").where("l_discount > 0.05D").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return read(spark, d, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "n")


@query("joi_07_semi", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value > 300)")
def joi_07(spark, d):
    e = read(spark, d, "events")
    return e.join(e.where("value > 300").select("user_id"), "user_id", "left_semi").select("event_id")


@query("joi_08_in_list", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (1, 3, 5, 7)")
def joi_08(spark, d):
    return read(spark, d, "supplier").where(F.col("s_nationkey").isin(1, 3, 5, 7)).select("s_suppkey", "s_name")


ASOF = f"""{OBS}, l AS (SELECT event_id, ident, us, alt FROM obs WHERE source = 'turb'), r AS (SELECT event_id AS rid, ident, us AS rus, alt AS ralt FROM obs WHERE source = 'amdar'),
n AS (SELECT l.event_id, l.us, l.alt, r.rid, r.rus, r.ralt, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(l.us - r.rus), r.rus, r.rid) AS k FROM l LEFT JOIN r ON l.ident = r.ident)"""


@query("joi_09_asof_nearest", f"WITH {ASOF} SELECT event_id, CASE WHEN abs(us - rus) <= 36000000000 THEN rid END AS near_id, CASE WHEN abs(us - rus) <= 36000000000 THEN us - rus END AS dt, CASE WHEN abs(us - rus) <= 36000000000 THEN alt - ralt END AS dalt FROM n WHERE k = 1")
def joi_09(spark, d):
    o = obs(spark, d)
    left = o.where("source = 'turb'").select("event_id", "ident", "us", "alt")
    right = o.where("source = 'amdar'").select(F.col("event_id").alias("rid"), "ident", F.col("us").alias("rus"), F.col("alt").alias("ralt"))
    m = J.asof_nearest(left, right, ["ident"], "us", "rus", "rid", 36e9)
    return m.select("event_id", F.col("match.rid").alias("near_id"), (F.col("us") - F.col("match.rus")).alias("dt"), (F.col("alt") - F.col("match.ralt")).alias("dalt"))


#: batches and legs with names of two kinds, some missing and some wrong; the driver's events lie far apart, so limits are wide
JOI10 = f"""{TRACK_SQL}, g AS (SELECT ident * 100000 + leg AS leg_id, ident AS tail, ident % 20 AS flight, min(us) // 1000000 AS start_s, max(us) // 1000000 AS stop_s, min(lat) AS lat_a, max(lat) AS lat_b, min(lon) AS lon_a, max(lon) AS lon_b, min(alt) AS alt_a, max(alt) AS alt_b, arg_max(alt, us) - arg_min(alt, us) AS climb FROM legs GROUP BY ident, leg),
b AS (SELECT event_id AS batch, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 13 = 0 THEN ident + 100000 ELSE ident END AS tail, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN ident % 20 + 1 ELSE ident % 20 END AS flight, us // 1000000 AS end_s, lag(us // 1000000) OVER (PARTITION BY ident ORDER BY us, event_id) AS previous_s, 1 + event_id % 4 AS n, lat, lon, alt - 300 AS low_m, alt + 300 AS high_m, CASE event_id % 3 WHEN 0 THEN 'ASC' WHEN 1 THEN 'DES' ELSE 'LVR' END AS phase FROM obs WHERE source = 'turb'),
h AS (SELECT b.*, EXISTS (SELECT 1 FROM g WHERE g.tail = b.tail AND g.flight = b.flight) AS has_i, EXISTS (SELECT 1 FROM g WHERE g.tail = b.tail) AS has_t, EXISTS (SELECT 1 FROM g WHERE g.flight = b.flight) AS has_f FROM b),
p AS (SELECT h.*, g.tail AS g_tail, g.flight AS g_flight, g.leg_id, g.start_s, g.stop_s, g.alt_a, g.alt_b, CASE WHEN climb > 1000 THEN 'ASC' WHEN climb < -1000 THEN 'DES' ELSE 'LVR' END AS leg_phase, (lat_a + lat_b) / 2 AS g_lat, (lon_a + lon_b) / 2 AS g_lon FROM h JOIN g ON CASE WHEN has_i THEN g.tail = h.tail AND g.flight = h.flight WHEN has_t THEN g.tail = h.tail WHEN has_f THEN g.flight = h.flight ELSE false END),
q AS (SELECT *, {HAVERSINE.format(a='', b='g_')} AS km FROM p),
v AS (SELECT *, CASE WHEN tail IS NOT NULL AND tail <> g_tail THEN 'identity_conflict' WHEN start_s > end_s + 60 OR stop_s < end_s - 86400 OR stop_s < previous_s - 7200 THEN 'time_failed' WHEN km > 2500 + greatest(5.0, n * 4.0) THEN 'geometry_failed' WHEN high_m + 1500 < alt_a OR low_m - 1500 > alt_b THEN 'altitude_failed' WHEN phase IN ('ASC', 'DES') AND leg_phase IN ('ASC', 'DES') AND phase <> leg_phase THEN 'phase_failed' ELSE 'candidate' END AS verdict,
CASE WHEN tail IS NULL THEN 'ID-D' WHEN flight = g_flight THEN 'ID-A' WHEN flight IS NULL THEN 'ID-C' ELSE 'ID-B' END AS grade FROM q)"""


def _leg_candidates(spark, d):
    order = F.struct("us", "event_id")
    second = lambda c: F.expr(f"{c} div 1000000")
    g = legs(spark, d).groupBy("ident", "leg").agg(F.min("us").alias("a"), F.max("us").alias("b"), *[f(c).alias(f"{c}_{n}") for c in ("lat", "lon", "alt") for n, f in (("a", F.min), ("b", F.max))], (F.max_by("alt", order) - F.min_by("alt", order)).alias("climb"))
    g = g.select((F.col("ident") * 100000 + F.col("leg")).alias("leg_id"), F.col("ident").alias("tail"), (F.col("ident") % 20).alias("flight"), second("a").alias("start_s"), second("b").alias("stop_s"), "lat_a", "lat_b", "lon_a", "lon_b", "alt_a", "alt_b", F.when(F.col("climb") > 1000, "ASC").when(F.col("climb") < -1000, "DES").otherwise("LVR").alias("leg_phase"))
    b = obs(spark, d).where("source = 'turb'").withColumn("end_s", second("us"))
    b = b.select(
        F.col("event_id").alias("batch"), F.expr("case when event_id % 11 = 0 then null when event_id % 13 = 0 then ident + 100000 else ident end").alias("tail"), F.expr("case when event_id % 7 = 0 then null when event_id % 5 = 0 then ident % 20 + 1 else ident % 20 end").alias("flight"),
        "end_s", F.lag("end_s").over(Window.partitionBy("ident").orderBy("us", "event_id")).alias("previous_s"), (1 + F.col("event_id") % 4).alias("n"), "lat", "lon", (F.col("alt") - 300).alias("low_m"), (F.col("alt") + 300).alias("high_m"), F.expr("elt(1 + event_id % 3, 'ASC', 'DES', 'LVR')").alias("phase"),
    )
    return J.leg_candidates(b, g, 86400, envelope_km=2500.0, padding_s=86400)


@query("joi_10_interval_candidates", f"WITH {JOI10} SELECT batch, leg_id::BIGINT AS leg_id, grade, round(km, 4) AS km, round(km + CASE grade WHEN 'ID-A' THEN 0 WHEN 'ID-B' THEN 2 WHEN 'ID-C' THEN 5 ELSE 8 END, 4) AS score FROM v WHERE verdict = 'candidate'")
def joi_10(spark, d):
    return _leg_candidates(spark, d)[0].select("batch", "leg_id", "grade", r6(F.col("km"), 4).alias("km"), r6(F.col("score"), 4).alias("score"))


@query("joi_10_rejections", f"WITH {JOI10} SELECT verdict, count(*) AS n FROM v GROUP BY 1 UNION ALL SELECT 'no_identity_candidate', count(*) FROM h WHERE NOT has_i AND NOT has_t AND coalesce(NOT has_f, true) HAVING count(*) > 0")
def joi_10_counts(spark, d):
    return _leg_candidates(spark, d)[1]


@query("joi_11_tiered_lookup", """
WITH r AS (SELECT s_nationkey AS n, s_suppkey % 3 AS g, min(s_suppkey) AS s FROM supplier GROUP BY 1, 2), c AS (SELECT c_custkey, c_nationkey AS n, c_custkey % 3 AS g FROM customer),
t AS (SELECT c_custkey, s, 1 AS tier FROM c JOIN r USING (n, g) UNION ALL SELECT c_custkey, s, 2 FROM c JOIN r USING (n)), m AS (SELECT *, min(tier) OVER (PARTITION BY c_custkey) AS mt FROM t)
SELECT c_custkey, s, tier FROM m WHERE tier = mt""")
def joi_11(spark, d):
    r = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n"), (F.col("s_suppkey") % 3).alias("g")).agg(F.min("s_suppkey").alias("s"))
    c = read(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("n"), (F.col("c_custkey") % 3).alias("g"))
    return J.tiered(c, r, [["n", "g"], ["n"]], ["c_custkey"]).select("c_custkey", "s", "tier")


@query("joi_12_candidate_trim", f"""
WITH {OBS}, b AS (SELECT event_id, ident, us, lag(us) OVER (PARTITION BY ident ORDER BY us, event_id) AS prev FROM obs WHERE source = 'turb'), c AS (SELECT event_id AS cid, ident, us AS cus, alt FROM obs WHERE source = 'amdar'),
j AS (SELECT b.event_id, cid, alt, count(*) OVER (PARTITION BY b.event_id) AS n, row_number() OVER (PARTITION BY b.event_id ORDER BY alt, cid) AS r FROM b JOIN c ON b.ident = c.ident AND cus <= us + 60000000 AND cus >= coalesce(prev, us - 86400000000) - 3600000000)
SELECT event_id, cid FROM j WHERE n >= 2 AND r <= 3 AND alt <= 14000""")
def joi_12(spark, d):
    o = obs(spark, d)
    prev = F.lag("us").over(Window.partitionBy("ident").orderBy("us", "event_id"))
    b = o.where("source = 'turb'").select("event_id", "ident", "us", prev.alias("prev")).withColumn("low", F.coalesce("prev", F.col("us") - 86400000000) - 3600000000).withColumn("high", F.col("us") + 60000000)
    c = o.where("source = 'amdar'").select(F.col("event_id").alias("cid"), "ident", F.col("us").alias("cus"), "alt")
    j = J.interval_join(c, b, ["ident"], "cus", "low", "high", 86400 * 1_000_000)
    w = Window.partitionBy("event_id")
    j = j.withColumn("n", F.count("*").over(w)).withColumn("r", F.row_number().over(w.orderBy("alt", "cid")))
    return j.where("n >= 2 and r <= 3 and alt <= 14000").select("event_id", "cid")


@query("joi_13_nearest_cells", f"""
WITH {OBS}, c AS (SELECT event_id, ts::DATE AS day, floor((54.2::DOUBLE - lat) / 5.0)::BIGINT AS y, floor((lon - 73.0::DOUBLE) / 5.0)::BIGINT AS x, source FROM obs),
j AS (SELECT a.event_id AS a, b.event_id AS b, (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) AS d2 FROM c a JOIN c b ON a.day = b.day WHERE a.source = 'turb' AND b.source = 'amdar'),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS k FROM j) SELECT a, b, d2, k::INTEGER AS k FROM r WHERE k <= 3""")
def joi_13(spark, d):
    from windgrid.operators.nearest import nearest_cells

    step = obs(spark, d).select("event_id", F.to_date("ts").alias("day"), F.floor((54.2 - F.col("lat")) / 5.0).alias("y"), F.floor((F.col("lon") - 73.0) / 5.0).alias("x"), "source")
    a = step.where("source = 'turb'").select(F.col("event_id").alias("a"), "day", "y", "x")
    b = step.where("source = 'amdar'").select(F.col("event_id").alias("b"), "day", "y", "x")
    return nearest_cells(a, b, ["day"], "a", "b", 3)


@query("joi_14_neighbour_box", """
WITH o AS (SELECT DISTINCT l_suppkey % 40 AS z, l_partkey % 40 AS y, l_orderkey % 20 AS x FROM lineitem), m AS (SELECT i, j, k FROM range(-1, 2) a(i), range(-1, 2) b(j), range(-1, 2) c(k) WHERE NOT (i = 0 AND j = 0 AND k = 0))
SELECT a.z, a.y, a.x, count(*) AS n FROM (SELECT * FROM o, m) a JOIN o b ON b.z = a.z + a.i AND b.y = a.y + a.j AND b.x = a.x + a.k GROUP BY 1, 2, 3""")
def joi_14(spark, d):
    o = read(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("z"), (F.col("l_partkey") % 40).alias("y"), (F.col("l_orderkey") % 20).alias("x")).distinct()
    return J.offset_join(o, o, [], J.box(1, 1, 1)).groupBy("z", "y", "x").agg(F.count("*").alias("n"))


@query("joi_15_pairs_in_reach", f"""
WITH {OBS}, c AS (SELECT event_id, ident, us, lat, lon, alt FROM obs)
SELECT a.event_id AS a, b.event_id AS b, round({HAVERSINE.format(a='a.', b='b.')}, 4) AS km FROM c a JOIN c b ON a.ident <> b.ident AND abs(a.us - b.us) <= 600000000 WHERE abs(a.alt - b.alt) <= 2000 AND {HAVERSINE.format(a='a.', b='b.')} <= 1500""")
def joi_15(spark, d):
    from windgrid.operators.nearest import pairs_in_time

    c = obs(spark, d).select("event_id", "ident", "us", "lat", "lon", "alt")
    p = pairs_in_time(c, "us", 600_000_000)
    km = geo.haversine_km(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    p = p.where("a.ident <> b.ident and abs(a.alt - b.alt) <= 2000").withColumn("km", km).where("km <= 1500")
    return p.select(F.col("a.event_id").alias("a"), F.col("b.event_id").alias("b"), r6(F.col("km"), 4).alias("km"))


@query("joi_16_successors", f"""
WITH {TRACK_SQL}, g AS (SELECT ident, leg, min(us) / 1e6::DOUBLE AS a, max(us) / 1e6::DOUBLE AS b FROM legs GROUP BY 1, 2), s AS (
SELECT ident, leg, 1 AS hop, lead(leg, 1) OVER w AS nxt, lead(a, 1) OVER w - b AS gap FROM g WINDOW w AS (PARTITION BY ident ORDER BY a, leg)
UNION ALL SELECT ident, leg, 2, lead(leg, 2) OVER w, lead(a, 2) OVER w - b FROM g WINDOW w AS (PARTITION BY ident ORDER BY a, leg) UNION ALL SELECT ident, leg, 3, lead(leg, 3) OVER w, lead(a, 3) OVER w - b FROM g WINDOW w AS (PARTITION BY ident ORDER BY a, leg))
SELECT ident, leg::BIGINT AS leg, hop, nxt::BIGINT AS to_leg, round(gap, 3) AS gap FROM s WHERE gap BETWEEN 1 AND 86400""")
def joi_16(spark, d):
    g = legs(spark, d).groupBy("ident", "leg").agg((F.min("us") / 1e6).alias("a"), (F.max("us") / 1e6).alias("b"))
    return J.successors(g, ["ident"], ["a", "leg"], ["leg", "a"], 3, 86400.0, "a", "b").select("ident", "leg", "hop", "to_leg", F.round("gap", 3).alias("gap"))


@query("joi_17_bridges", f"""
WITH {TRACK_SQL}, g AS (SELECT ident, leg, min(us) AS a, max(us) AS b, arg_min(lat, us) AS slat, arg_min(lon, us) AS slon, arg_max(lat, us) AS elat, arg_max(lon, us) AS elon FROM legs GROUP BY 1, 2),
n AS (SELECT ident, leg, b, elat, elon, lead(leg) OVER w AS nxt, lead(a) OVER w AS na, lead(slat) OVER w AS nlat, lead(slon) OVER w AS nlon FROM g WINDOW w AS (PARTITION BY ident ORDER BY a, leg))
SELECT ident, leg::BIGINT AS leg, nxt::BIGINT AS to_leg FROM n WHERE na > b AND {HAVERSINE.format(a='e', b='n')} * 1000 / ((na - b) / 1e6) <= 60""")
def joi_17(spark, d):
    from windgrid.operators.tracks import leg_ends

    g = leg_ends(legs(spark, d))
    w = Window.partitionBy("ident").orderBy("start_us", "leg")
    nxt = {f"n_{c}": F.lead(c).over(w) for c in ("leg", "start_us", "start_lat", "start_lon")}
    km = geo.haversine_km(F.col("end_lat"), F.col("end_lon"), F.col("n_start_lat"), F.col("n_start_lon"))
    n = g.withColumns(nxt).where("n_start_us > end_us").where(km * 1000 / ((F.col("n_start_us") - F.col("end_us")) / 1e6) <= 60)
    return n.select("ident", "leg", F.col("n_leg").alias("to_leg"))


@query("joi_18_cross_case", """
WITH f AS (SELECT o_custkey, o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) AS r, o_orderdate FROM orders), g AS (SELECT * FROM f WHERE r = 1)
SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS other FROM g""")
def joi_18(spark, d):
    g = keep_first(read(spark, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"])
    return g.select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("other"))


@query("joi_19_merge_keys", """
WITH a AS (SELECT l_orderkey, l_linenumber, arg_max(l_discount, l_partkey * 1000 + l_suppkey) AS e FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2), b AS (SELECT l_orderkey, l_linenumber, arg_max(l_discount, l_partkey * 1000 + l_suppkey) AS e FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, a.e, b.e AS e_b FROM a JOIN b USING (l_orderkey, l_linenumber)""")
def joi_19(spark, d):
    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_discount").alias("e"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("o"))
    m = J.merge_keys(li.where("l_returnflag <> 'R'"), li.where("l_returnflag = 'R'"), ["l_orderkey", "l_linenumber"], [F.col("o").desc()])
    return m.select("l_orderkey", "l_linenumber", "e", "e_b")


@query("joi_20_prediction_merge", "SELECT doc_id, quality, n_chars FROM labels LEFT JOIN documents USING (doc_id)")
def joi_20(spark, d):
    return read(spark, d, "labels").join(read(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", "left").select("doc_id", "quality", "n_chars")


@query("joi_21_bracket", f"""
WITH {OBS}, l AS (SELECT event_id, ident, us FROM obs WHERE source = 'turb'), r AS (SELECT ident, us AS rus, speed FROM obs WHERE source = 'amdar'),
j AS (SELECT event_id, us, max(rus) FILTER (WHERE rus <= us) AS t0, min(rus) FILTER (WHERE rus >= us) AS t1, arg_max(speed, rus) FILTER (WHERE rus <= us) AS v0, arg_min(speed, rus) FILTER (WHERE rus >= us) AS v1 FROM l LEFT JOIN r USING (ident) GROUP BY 1, 2)
SELECT event_id, t0, t1, round(CASE WHEN t0 = t1 THEN v0 ELSE v0 + (us - t0) / (t1 - t0)::DOUBLE * (v1 - v0) END, 5) AS v FROM j""")
def joi_21(spark, d):
    o = obs(spark, d)
    b = J.bracket(o.where("source = 'turb'").select("event_id", "ident", "us"), o.where("source = 'amdar'").select("ident", F.col("us").alias("rus"), "speed"), ["ident"], "us", "rus", "speed", 86400 * 1_000_000)
    return b.select("event_id", "t0", "t1", r6(F.col("v0") + F.col("alpha") * (F.col("v1") - F.col("v0")), 5).alias("v"))


@query("joi_22_nearest_time", f"""
WITH {OBS}, f AS (SELECT DISTINCT date_trunc('hour', ts) AS frame FROM obs WHERE source = 'other'), n AS (SELECT event_id, frame, abs(us - epoch_us(frame)) AS dt, row_number() OVER (PARTITION BY event_id ORDER BY abs(us - epoch_us(frame)), frame) AS k FROM obs, f WHERE source = 'turb')
SELECT event_id, CASE WHEN dt <= 7200000000 THEN epoch_us(frame) END AS frame_us FROM n WHERE k = 1""")
def joi_22(spark, d):
    o = obs(spark, d)
    f = o.where("source = 'other'").select(F.unix_micros(F.date_trunc("hour", "ts").cast("timestamp")).alias("f")).distinct()
    day = 86400 * 1_000_000
    # frames stand under their own day and the days beside it, so one key finds all within a day
    f = f.withColumn("k", F.explode(F.expr(f"sequence(f div {day} - 1, f div {day} + 1)")))
    left = o.where("source = 'turb'").select("event_id", "us", F.expr(f"us div {day}").alias("k"))
    m = J.asof_nearest(left, f, ["k"], "us", "f", "f", 7.2e9)
    return m.select("event_id", F.col("match.f").alias("frame_us"))


@query("joi_23_axis_sampling", f"""
WITH {OBS}, ax AS (SELECT i, 12.2::DOUBLE + i * 7 AS v FROM range(7) t(i)), n AS (SELECT event_id, i, row_number() OVER (PARTITION BY event_id ORDER BY abs(lat - v), i) AS k FROM obs, ax) SELECT event_id, i FROM n WHERE k = 1""")
def joi_23(spark, d):
    # the axis is a constant of a few values: nearest by a fold over an array, no join at all
    axis = F.array(*[F.struct(F.lit(12.2 + i * 7).alias("v"), F.lit(i).cast("long").alias("i")) for i in range(7)])
    near = F.array_min(F.transform(axis, lambda a: F.struct(F.abs(F.col("lat") - a["v"]).alias("d"), a["i"].alias("i"))))
    return obs(spark, d).select("event_id", near["i"].alias("i"))


@query("joi_24_source_dedupe", """
WITH a AS (SELECT l_orderkey AS k, avg(l_discount) AS u FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_orderkey AS k, avg(l_discount) AS u FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
s AS (SELECT count(b.k) / count(*)::DOUBLE AS share FROM a LEFT JOIN b USING (k)) SELECT k, round(CASE WHEN b.u IS NULL THEN 1.0 WHEN abs(a.u - b.u) >= 0.03 THEN 1.0 WHEN abs(a.u - b.u) >= 0.0105 THEN 0.28 ELSE 0.0 END, 2)::DOUBLE AS w FROM a LEFT JOIN b USING (k), s WHERE share < 0.92""")
def joi_24(spark, d):
    from windgrid.operators.aggregates import mean_in_order
    from windgrid.operators.fusion import dedupe_sources

    # means are held against bounds that discounts meet exactly: they are added in the order of the table
    li = read(spark, d, "lineitem").select("l_returnflag", F.col("l_orderkey").alias("k"), F.col("l_discount").alias("u"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    a, b = (mean_in_order(li.where(F.col("l_returnflag") == f), ["k"], "u", ["file", "row"]) for f in "RA")
    return dedupe_sources(a, b, ["k"], "u", 0.03)


@query("joi_25_anti", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def joi_25(spark, d):
    return read(spark, d, "orders").join(read(spark, d, "lineitem").where("l_quantity > 30"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("joi_26_broadcast_small", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def joi_26(spark, d):
    n = read(spark, d, "nation")  # 25 rows, fixed
    return read(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))
