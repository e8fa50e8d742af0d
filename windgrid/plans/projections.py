"""Projections, cleaning and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from windgrid.functions import clean, geo, weights
from windgrid.plans.base import HAVERSINE, OBS, obs, query, r6, read


@query("prj_01_finite_or_null", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity END AS q FROM lineitem""")
def prj_01(spark, d):
    text = F.when(F.col("l_linenumber") % 3 == 0, "n/a").when(F.col("l_linenumber") % 5 == 0, "Infinity").otherwise(F.col("l_quantity").cast("string"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", clean.finite(text).alias("q"))


@query("prj_02_all_finite", """
SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 11 = 0 THEN NULL ELSE value * 2 END AS twice FROM events""")
def prj_02(spark, d):
    e = read(spark, d, "events")
    raw = e.select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"), F.when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value") * 2).alias("twice"))
    return clean.all_finite(raw)


@query("prj_03_required_rows", "SELECT event_id, value, event_type FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0")
def prj_03(spark, d):
    raw = read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"), F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"))
    return clean.require(raw, ["value", "absent"], ["event_type"])


@query("prj_04_first_present", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS label FROM customer")
def prj_04(spark, d):
    c = read(spark, d, "customer").withColumn("segment", F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")))
    return c.select("c_custkey", clean.first_present(c, ["机型", "segment", "c_name"]).alias("label"))


@query("prj_05_altitude_unit", f"""
WITH {OBS}, f AS (SELECT source, CASE WHEN source = 'turb' THEN alt * 3 ELSE alt END AS alt FROM obs)
SELECT source, CASE WHEN median(alt) > 15000 OR avg(CASE WHEN alt > 15000 THEN 1.0 ELSE 0.0 END) > 0.5
       OR avg(CASE WHEN alt BETWEEN 20000 AND 45000 THEN 1.0 ELSE 0.0 END) > 0.20 THEN 'feet' ELSE 'metre' END AS unit FROM f GROUP BY source""")
def prj_05(spark, d):
    o = obs(spark, d).select("source", F.when(F.col("source") == "turb", F.col("alt") * 3).otherwise(F.col("alt")).alias("alt"))
    return o.groupBy("source").agg(clean.altitude_unit(F.col("alt")).alias("unit"))


@query("prj_06_altitude_metres", f"""
WITH {OBS}, f AS (SELECT event_id, source, CASE WHEN source = 'turb' THEN alt * 3 ELSE alt * 2 END AS alt FROM obs),
u AS (SELECT source, CASE WHEN median(alt) > 15000 OR avg(CASE WHEN alt > 15000 THEN 1.0 ELSE 0.0 END) > 0.5
      OR avg(CASE WHEN alt BETWEEN 20000 AND 45000 THEN 1.0 ELSE 0.0 END) > 0.20 THEN 'feet' ELSE 'metre' END AS unit FROM f GROUP BY source)
SELECT event_id, unit, round(CASE WHEN (CASE WHEN unit = 'feet' THEN alt * 0.3048 ELSE alt END) <= 20000 THEN CASE WHEN unit = 'feet' THEN alt * 0.3048 ELSE alt END END, 6) AS metres,
       round(CASE WHEN alt > 15000 AND alt <= 45000 THEN alt * 0.3048 ELSE alt END, 6) AS by_row FROM f JOIN u USING (source)""")
def prj_06(spark, d):
    o = obs(spark, d).select("event_id", "source", F.when(F.col("source") == "turb", F.col("alt") * 3).otherwise(F.col("alt") * 2).alias("alt"))
    units = o.groupBy("source").agg(clean.altitude_unit(F.col("alt")).alias("unit"))  # one row per source
    return o.join(F.broadcast(units), "source").select("event_id", "unit", r6(clean.altitude_metres(F.col("alt"), F.col("unit"))).alias("metres"), r6(clean.altitude_metres_by_row(F.col("alt"))).alias("by_row"))


@query("prj_07_coordinates", """
SELECT event_id, round((event_id * 7919 % 90000000)::DOUBLE / 1000000, 6) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS lat FROM events WHERE event_id * 7919 % 90000000 > 90""")
def prj_07(spark, d):
    e = read(spark, d, "events").where("event_id * 7919 % 90000000 > 90").select("event_id", F.concat(F.when(F.col("event_id") % 2 == 0, "N").otherwise("S"), F.expr("cast(event_id * 7919 % 90000000 as string)")).alias("text"))
    return e.select("event_id", r6(clean.coordinate(F.col("text"), 90.0)).alias("lat"))


@query("prj_08_any_time", """
SELECT o_orderkey, date_trunc('second', o_orderdate) AS t FROM orders""")
def prj_08(spark, d):
    o = read(spark, d, "orders")
    ts = F.col("o_orderdate").cast("timestamp_ntz")
    days = F.format_number(F.expr("(unix_micros(cast(o_orderdate as timestamp)) div 1000000 - unix_seconds(timestamp'1899-12-30 00:00:00')) / 86400D"), 8)
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(ts, "yyyy-MM-dd HH:mm:ss")).when(F.col("o_orderkey") % 3 == 1, F.date_format(ts, "yyyy/MM/dd HH:mm:ss")).otherwise(F.regexp_replace(days, ",", ""))
    return o.select("o_orderkey", clean.any_time(text, ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd HH:mm:ss"]).alias("t"))


@query("prj_09_beijing_to_utc", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN ts ELSE ts - INTERVAL 8 HOURS END AS utc FROM events")
def prj_09(spark, d):
    known = F.when(F.col("event_id") % 4 == 0, F.col("ts"))
    return read(spark, d, "events").select("event_id", F.coalesce(known, F.col("ts") - F.expr("INTERVAL 8 HOURS")).alias("utc"))


@query("prj_10_identity_fill", """
SELECT event_id, CASE WHEN event_type = 'error' THEN 'flight_' || (row_number() OVER (ORDER BY ts, event_id) - 1) ELSE event_type END AS flight, event_type = 'error' AS virtual FROM events""")
def prj_10(spark, d):
    from windgrid.operators.ordering import global_row_number

    e = read(spark, d, "events")
    e = global_row_number(e, ["ts", "event_id"], "row")
    blank = F.col("event_type") == "error"
    return e.select("event_id", F.when(blank, F.concat(F.lit("flight_"), F.col("row").cast("string"))).otherwise(F.col("event_type")).alias("flight"), blank.alias("virtual"))


@query("prj_11_identity_normal", "SELECT c_custkey, regexp_replace(upper(trim(c_name)), '[^A-Z0-9]', '', 'g') AS id FROM customer")
def prj_11(spark, d):
    return read(spark, d, "customer").select("c_custkey", clean.identity(F.col("c_name"), None).alias("id"))


@query("prj_12_identity_missing", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'MISSING' ELSE regexp_replace(upper(trim(p_brand)), '[^A-Z0-9]', '', 'g') END AS id FROM part")
def prj_12(spark, d):
    return read(spark, d, "part").select("p_partkey", clean.identity(F.when(F.col("p_size") % 3 == 0, " -# ").otherwise(F.col("p_brand"))).alias("id"))


@query("prj_13_pruned_window", f"WITH {OBS} SELECT event_id, lat, lon, alt FROM obs WHERE us BETWEEN epoch_us(TIMESTAMP '2024-01-10') AND epoch_us(TIMESTAMP '2024-01-12')")
def prj_13(spark, d):
    return obs(spark, d).where(F.col("ts").between(F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))).select("event_id", "lat", "lon", "alt")


@query("prj_14_domain", f"WITH {OBS} SELECT event_id FROM obs WHERE lat BETWEEN 20 AND 40 AND lon BETWEEN 80 AND 120 AND alt BETWEEN 0 AND 12000")
def prj_14(spark, d):
    from windgrid.operators.voxels import inside

    return inside(obs(spark, d), (20, 40), (80, 120), (0, 12000)).select("event_id")


VOXEL = "floor((54.2::DOUBLE - lat) / 0.5)::BIGINT AS y, floor((lon - 73.0::DOUBLE) / 0.5)::BIGINT AS x, floor(alt / 500)::BIGINT AS z"


@query("prj_15_voxelize_floor", f"WITH {OBS} SELECT event_id, {VOXEL} FROM obs WHERE lat <= 54.2 AND floor((54.2::DOUBLE - lat) / 0.5) < 84 AND floor((lon - 73.0::DOUBLE) / 0.5) BETWEEN 0 AND 123 AND floor(alt / 500) BETWEEN 0 AND 30")
def prj_15(spark, d):
    from windgrid.operators.voxels import Grid, voxelize

    return voxelize(obs(spark, d), Grid()).select("event_id", "y", "x", "z")


@query("prj_16_voxelize_truncate", f"WITH {OBS} SELECT event_id, trunc((54.2::DOUBLE - lat) / 0.5)::BIGINT AS y, trunc((lon - 80.0::DOUBLE) / 0.5)::BIGINT AS x, trunc(alt / 500)::BIGINT AS z FROM obs WHERE lon > 79.5")
def prj_16(spark, d):
    o = obs(spark, d).where("lon > 79.5D")
    return o.select("event_id", ((54.2 - F.col("lat")) / 0.5).cast("long").alias("y"), ((F.col("lon") - 80.0) / 0.5).cast("long").alias("x"), (F.col("alt") / 500).cast("long").alias("z"))


@query("prj_17_voxel_centre", f"WITH {OBS}, v AS (SELECT DISTINCT {VOXEL} FROM obs) SELECT z, y, x, round(54.2::DOUBLE - (y + 0.5) * 0.5, 6) AS lat, round(73.0::DOUBLE + (x + 0.5) * 0.5, 6) AS lon, (z * 500)::DOUBLE AS alt FROM v")
def prj_17(spark, d):
    from windgrid.operators.voxels import Grid, centre, voxelize

    return centre(voxelize(obs(spark, d), Grid(), bounded=False).select("z", "y", "x").distinct(), Grid()).select("z", "y", "x", r6(F.col("lat")).alias("lat"), r6(F.col("lon")).alias("lon"), "alt")


@query("prj_18_linear_index", f"WITH {OBS}, v AS (SELECT DISTINCT {VOXEL} FROM obs), i AS (SELECT z * 84 * 124 + y * 124 + x AS idx FROM v WHERE y BETWEEN 0 AND 83 AND x BETWEEN 0 AND 123) SELECT idx, idx // (84 * 124) AS z, (idx // 124) % 84 AS y, idx % 124 AS x FROM i")
def prj_18(spark, d):
    from windgrid.operators.voxels import Grid, from_index, to_index, voxelize

    g = Grid()
    v = voxelize(obs(spark, d), g).select("z", "y", "x").distinct().select(to_index(g).alias("idx"))
    return v.select("idx", *[c.alias(n) for n, c in zip("zyx", from_index(F.col("idx"), g), strict=True)])


FRAME_SQL = "TIMESTAMP '2024-01-15 12:00:00'"


@query("prj_19_current_context", f"""
WITH {OBS}, w AS (SELECT event_id, trunc((us - epoch_us({FRAME_SQL})) / 60000000.0::DOUBLE)::BIGINT AS minutes FROM obs)
SELECT event_id, minutes, CASE WHEN abs(minutes) <= 5 THEN 'current' ELSE 'context' END AS part FROM w WHERE abs(minutes) <= 360""")
def prj_19(spark, d):
    minutes = F.expr("timestampdiff(MINUTE, timestamp'2024-01-15 12:00:00', cast(ts as timestamp))")
    o = obs(spark, d).select("event_id", minutes.alias("minutes")).where(F.abs("minutes") <= 360)
    return o.select("event_id", "minutes", F.when(F.abs("minutes") <= 5, "current").otherwise("context").alias("part"))


@query("prj_20_label_support", f"WITH {OBS} SELECT event_id, CASE WHEN event_id % 3 = 0 AND source = 'turb' THEN 'label' ELSE 'support' END AS part FROM obs")
def prj_20(spark, d):
    role = F.when(F.col("event_id") % 3 == 0, "strict_candidate")
    label = F.coalesce((role == "strict_candidate") & (F.lower("source") == "turb"), F.lit(False))
    return obs(spark, d).select("event_id", F.when(label, "label").otherwise("support").alias("part"))


REJECT = [("invalid_speed", "wind_speed > 140"), ("amdar_speed", "source = 'amdar' and wind_speed >= 120"), ("other_speed", "source = 'other' and wind_speed >= 100"), ("low_slow", "alt < 100 and wind_speed < 1")]
REJECT_SQL = "CASE " + " ".join(f"WHEN {r} THEN '{n}'" for n, r in REJECT) + " ELSE 'kept' END"


@query("prj_21_hard_reject", f"WITH {OBS} SELECT event_id, {REJECT_SQL} AS reason FROM obs")
def prj_21(spark, d):
    return obs(spark, d).select("event_id", clean.first_reason([(n, F.expr(r)) for n, r in REJECT]).alias("reason"))


@query("prj_22_reject_counts", f"WITH {OBS} SELECT {REJECT_SQL} AS reason, count(*) AS n FROM obs GROUP BY 1")
def prj_22(spark, d):
    return obs(spark, d).groupBy(clean.first_reason([(n, F.expr(r)) for n, r in REJECT]).alias("reason")).agg(F.count("*").alias("n"))


def _band_sql(x, bounds, names):
    return "CASE " + " ".join(f"WHEN {x} < {b} THEN '{n}'" for b, n in zip(bounds, names, strict=False)) + f" ELSE '{names[-1]}' END"


@query("prj_23_bands", f"WITH {OBS} SELECT {_band_sql('alt', *clean.ALTITUDE_BANDS)} AS altitude, {_band_sql('wind_speed', *clean.SPEED_BANDS)} AS speed, count(*) AS n FROM obs GROUP BY 1, 2")
def prj_23(spark, d):
    return obs(spark, d).groupBy(clean.band(F.col("alt"), *clean.ALTITUDE_BANDS).alias("altitude"), clean.band(F.col("wind_speed"), *clean.SPEED_BANDS).alias("speed")).agg(F.count("*").alias("n"))


@query("prj_24_cut", "SELECT CASE WHEN p_size < 10 THEN '[0,10)' WHEN p_size < 25 THEN '[10,25)' ELSE '[25,51)' END AS bin, count(*) AS n FROM part GROUP BY 1")
def prj_24(spark, d):
    return read(spark, d, "part").groupBy(clean.band(F.col("p_size"), [10, 25], ["[0,10)", "[10,25)", "[25,51)"]).alias("bin")).agg(F.count("*").alias("n"))


@query("prj_25_reasons", f"WITH {OBS} SELECT event_id, concat_ws(';', " + ", ".join(f"CASE WHEN {r} THEN '{n}' END" for n, r in REJECT) + ") AS reasons FROM obs")
def prj_25(spark, d):
    return obs(spark, d).select("event_id", clean.reasons([(n, F.expr(r)) for n, r in REJECT]).alias("reasons"))


@query("prj_26_column_audit", "SELECT * FROM (VALUES ('event_id', true), ('value', true), ('wind_dir', false)) AS t(name, present)")
def prj_26(spark, d):
    e = read(spark, d, "events")
    return spark.createDataFrame([(c, c in e.columns) for c in ("event_id", "value", "wind_dir")], "name string, present boolean")


# ---- scalar functions

PAIR = f"{OBS}, s AS (SELECT *, 30.0::DOUBLE AS lat0, 100.0::DOUBLE AS lon0 FROM obs)"


@query("fun_01_haversine", f"WITH {PAIR} SELECT event_id, round({HAVERSINE.format(a='', b='').replace('lat - lat', 'lat0 - lat').replace('cos(radians(lat)) * cos(radians(lat))', 'cos(radians(lat)) * cos(radians(lat0))').replace('lon - lon', 'lon0 - lon')}, 4) AS km FROM s")
def fun_01(spark, d):
    return obs(spark, d).select("event_id", r6(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(30.0), F.lit(100.0)), 4).alias("km"))


@query("fun_02_haversine_table", f"WITH {PAIR}, p AS (SELECT DISTINCT ident, lat0, lon0, 12.2::DOUBLE + ident % 40 AS lat, 73.0::DOUBLE + ident % 60 AS lon FROM s) SELECT ident, round({HAVERSINE.format(a='', b='').replace('lat - lat', 'lat0 - lat').replace('cos(radians(lat)) * cos(radians(lat))', 'cos(radians(lat)) * cos(radians(lat0))').replace('lon - lon', 'lon0 - lon')}, 4) AS km FROM p")
def fun_02(spark, d):
    p = obs(spark, d).select("ident").distinct().select("ident", (12.2 + F.col("ident") % 40).alias("lat"), (73.0 + F.col("ident") % 60).alias("lon"))
    return p.select("ident", r6(geo.haversine_km(F.col("lat"), F.col("lon"), F.lit(30.0), F.lit(100.0)), 4).alias("km"))


@query("fun_03_angle_difference", f"WITH {OBS} SELECT event_id, abs((((heading - wind_dir + 180) % 360) + 360) % 360 - 180) AS diff FROM obs")
def fun_03(spark, d):
    return obs(spark, d).select("event_id", geo.angle_difference(F.col("heading"), F.col("wind_dir")).alias("diff"))


@query("fun_04_wind_vector", f"WITH {OBS} SELECT event_id, round(-wind_speed * sin(radians(wind_dir)), 6) + 0.0 AS u, round(-wind_speed * cos(radians(wind_dir)), 6) + 0.0 AS v FROM obs")
def fun_04(spark, d):
    u, v = geo.wind_vector(F.col("wind_dir"), F.col("wind_speed"))
    return obs(spark, d).select("event_id", (r6(u) + 0.0).alias("u"), (r6(v) + 0.0).alias("v"))


@query("fun_05_motion_vector", f"WITH {OBS} SELECT event_id, round(speed / 3.6 * sin(radians(heading)), 6) + 0.0 AS u, round(speed / 3.6 * cos(radians(heading)), 6) + 0.0 AS v FROM obs")
def fun_05(spark, d):
    u, v = geo.motion_vector(F.col("heading"), F.col("speed") / 3.6)
    return obs(spark, d).select("event_id", (r6(u) + 0.0).alias("u"), (r6(v) + 0.0).alias("v"))


@query("fun_06_direction_error", f"""
WITH {OBS}, x AS (SELECT event_id, wind_speed * sin(radians(wind_dir)) AS tu, wind_speed * cos(radians(wind_dir)) AS tv, speed * sin(radians(heading)) AS u, speed * cos(radians(heading)) AS v FROM obs)
SELECT event_id, CASE WHEN sqrt(tu * tu + tv * tv) >= 5.00001 AND sqrt(u * u + v * v) >= 1.00001 THEN round(abs((((degrees(atan2(u, v)) - degrees(atan2(tu, tv)) + 180) % 360) + 360) % 360 - 180), 4) END AS err
FROM x WHERE abs(sqrt(tu * tu + tv * tv) - 5) > 0.001 AND abs(sqrt(u * u + v * v) - 1) > 0.001""")
def fun_06(spark, d):
    (tu, tv), (u, v) = geo.motion_vector(F.col("wind_dir"), F.col("wind_speed")), geo.motion_vector(F.col("heading"), F.col("speed"))
    o = obs(spark, d).select("event_id", tu.alias("tu"), tv.alias("tv"), u.alias("u"), v.alias("v")).where((F.abs(F.hypot("tu", "tv") - 5) > 0.001) & (F.abs(F.hypot("u", "v") - 1) > 0.001))
    return o.select("event_id", r6(geo.direction_error(F.col("u"), F.col("v"), F.col("tu"), F.col("tv")), 4).alias("err"))


@query("fun_07_local_plane", f"""
WITH {OBS} SELECT event_id, round((lon - 100) * 111.320 * cos(radians(30.0::DOUBLE)), 6) AS east, round((lat - 30) * 110.574, 6) AS north,
round((lon - 100) * 111.32 * greatest(0.1, cos(radians(30.0::DOUBLE))), 6) AS east2, round((lat - 30) * 111.32, 6) AS north2 FROM obs""")
def fun_07(spark, d):
    e, n = geo.local_km(F.col("lat"), F.col("lon"), F.lit(30.0), F.lit(100.0))
    e2, n2 = geo.local_km(F.col("lat"), F.col("lon"), F.lit(30.0), F.lit(100.0), 111.32, 111.32, 0.1)
    return obs(spark, d).select("event_id", r6(e).alias("east"), r6(n).alias("north"), r6(e2).alias("east2"), r6(n2).alias("north2"))


@query("fun_08_on_segment", f"""
WITH {OBS}, f AS (SELECT event_id, lon, lat, coalesce(least(1.0, greatest(0.0, ((lon - 80) * 40 + (lat - 20) * 20) / 2000.0::DOUBLE)), 0.0) AS f FROM obs)
SELECT event_id, round(f, 6) AS fraction, round(sqrt(pow(lon - (80 + f * 40), 2) + pow(lat - (20 + f * 20), 2)), 6) AS across FROM f""")
def fun_08(spark, d):
    f, x = geo.on_segment(F.col("lon"), F.col("lat"), F.lit(80.0), F.lit(20.0), F.lit(120.0), F.lit(40.0))
    return obs(spark, d).select("event_id", r6(f).alias("fraction"), r6(x).alias("across"))


@query("fun_09_reachable", f"""
WITH {OBS} SELECT event_id, (event_id % 2000) <= 1800 AND speed <= 5 + 0.30 * greatest(30.0, event_id % 2000) AND abs(alt - 7000) <= 500 + 30 * greatest(30.0, event_id % 2000) AS ok FROM obs""")
def fun_09(spark, d):
    return obs(spark, d).select("event_id", geo.reachable((F.col("event_id") % 2000).cast("double"), F.col("speed"), F.col("alt") - 7000).alias("ok"))


@query("fun_10_half_life", f"WITH {OBS} SELECT event_id, round(pow(0.5, abs(alt / 100 - 60) / 30.0), 6) AS c FROM obs")
def fun_10(spark, d):
    return obs(spark, d).select("event_id", r6(weights.half_life(F.col("alt") / 100 - 60, 30.0)).alias("c"))


@query("fun_11_decay", f"WITH {OBS} SELECT event_id, round(exp(-0.05 * abs(alt / 100 - 60)), 6) AS c FROM obs")
def fun_11(spark, d):
    return obs(spark, d).select("event_id", r6(weights.decay(F.col("alt") / 100 - 60, 0.05)).alias("c"))


@query("fun_12_space_confidence", f"WITH {OBS} SELECT event_id, round(least(1.0, greatest(0.02, exp(-0.5 * pow((lon - 100) / 10, 2) - 0.5 * pow((alt - 7000) / 2500, 2)))), 6) AS c FROM obs")
def fun_12(spark, d):
    return obs(spark, d).select("event_id", r6(weights.space_confidence(F.col("lon") - 100, F.col("alt") - 7000, 10.0, 2500.0)).alias("c"))


@query("fun_13_blended_weight", f"""
WITH {OBS}, f AS (SELECT event_id, source, exp(-0.5 * pow((event_id % 900) / 360.0, 2)) AS t, least(1.0, greatest(0.0, 1 - abs(lon - 100) / 30)) AS s, least(1.0, greatest(0.0, 1 - abs(alt - 7000) / 2500)) AS h, least(1.0, greatest(0.0, 1 - speed / 400)) AS q FROM obs)
SELECT event_id, round(least(1.0, greatest(0.0, 0.35 * t + 0.15 * s + 0.25 * h + 0.25 * q + CASE WHEN source = 'turb' THEN 0.10 ELSE 0 END)), 6) AS w FROM f""")
def fun_13(spark, d):
    t, s = weights.gaussian((F.col("event_id") % 900) / 360.0), weights.linear_confidence(F.col("lon") - 100, 30.0)
    h, q = weights.linear_confidence(F.col("alt") - 7000, 2500.0), weights.linear_confidence(F.col("speed"), 400.0)
    bonus = F.when(F.col("source") == "turb", 0.10).otherwise(0.0)
    return obs(spark, d).select("event_id", r6(geo.clip(0.35 * t + 0.15 * s + 0.25 * h + 0.25 * q + bonus, 0.0, 1.0)).alias("w"))


@query("fun_14_speed_taper", f"""
WITH {OBS}, f AS (SELECT event_id, source, least(1.0, greatest(0.0, (wind_speed - 70) / 25)) AS x FROM obs)
SELECT event_id, CASE WHEN source = 'turb' THEN 1.0 ELSE round(0.1 + 0.9 * 0.5 * (1 + cos(3.141592653589793 * x)), 6) END AS f FROM f""")
def fun_14(spark, d):
    return obs(spark, d).select("event_id", F.when(F.col("source") == "turb", 1.0).otherwise(r6(weights.speed_taper(F.col("wind_speed")))).alias("f"))


@query("fun_15_instrument_sigma", f"WITH {OBS} SELECT event_id, CASE WHEN source = 'amdar' THEN CASE WHEN alt >= 9000 THEN 3.0 ELSE 2.5 END WHEN source = 'turb' THEN CASE WHEN alt >= 9000 THEN 2.5 ELSE 2.0 END ELSE CASE WHEN alt >= 9000 THEN 5.0 ELSE 4.0 END END::DOUBLE AS sigma FROM obs")
def fun_15(spark, d):
    high = F.col("alt") >= 9000
    pick = lambda a, b: F.when(high, a).otherwise(b)
    return obs(spark, d).select("event_id", F.when(F.col("source") == "amdar", pick(3.0, 2.5)).when(F.col("source") == "turb", pick(2.5, 2.0)).otherwise(pick(5.0, 4.0)).alias("sigma"))


SIGMA = "least(18.0, greatest(1.0, sqrt(2.25 + 0.5 * pow(wind_speed / 10, 2) + pow((lon - 100) / 80, 2) + pow((alt - 7000) / 1200, 2))))"


@query("fun_16_representativeness", f"WITH {OBS} SELECT event_id, round({SIGMA}, 6) AS sigma FROM obs")
def fun_16(spark, d):
    return obs(spark, d).select("event_id", r6(weights.representativeness_sigma(F.col("wind_speed") / 10, F.col("lon") - 100, F.col("alt") - 7000)).alias("sigma"))


@query("fun_17_error_factor", f"WITH {OBS} SELECT event_id, round(least(4.0, greatest(0.05, pow(8 / {SIGMA}, 2))), 6) AS f FROM obs")
def fun_17(spark, d):
    return obs(spark, d).select("event_id", r6(weights.error_factor(weights.representativeness_sigma(F.col("wind_speed") / 10, F.col("lon") - 100, F.col("alt") - 7000))).alias("f"))


@query("fun_18_density_confidence", "SELECT l_orderkey, round(1 - exp(-count(*) / 3.0), 6) AS c FROM lineitem GROUP BY 1")
def fun_18(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(r6(weights.density_confidence(F.count("*"))).alias("c"))


@query("fun_19_log_mean", f"WITH {OBS} SELECT event_id, round(exp(0.5 * ln(least(1.0, greatest(1e-6, alt / 15000))) + 0.3 * ln(least(1.0, greatest(1e-6, wind_speed / 150))) + 0.2 * ln(least(1.0, greatest(1e-6, heading / 360)))), 6) AS m FROM obs")
def fun_19(spark, d):
    return obs(spark, d).select("event_id", r6(weights.log_mean([F.col("alt") / 15000, F.col("wind_speed") / 150, F.col("heading") / 360], [0.5, 0.3, 0.2])).alias("m"))


@query("fun_20_steps", "SELECT l_orderkey, (CASE WHEN count(*) <= 1 THEN 1.0 WHEN count(*) <= 3 THEN 0.9 WHEN count(*) <= 6 THEN 0.7 ELSE 0.5 END)::DOUBLE AS f FROM lineitem GROUP BY 1")
def fun_20(spark, d):
    return read(spark, d, "lineitem").groupBy("l_orderkey").agg(weights.steps(F.count("*"), [1, 3, 6], [1.0, 0.9, 0.7, 0.5]).alias("f"))


@query("fun_21_row_extremes", f"WITH {OBS} SELECT event_id, greatest(lat, CASE WHEN event_id % 2 = 0 THEN lon END) AS high, least(lat, CASE WHEN event_id % 3 = 0 THEN alt END) AS low FROM obs")
def fun_21(spark, d):
    return obs(spark, d).select("event_id", F.greatest("lat", F.when(F.col("event_id") % 2 == 0, F.col("lon"))).alias("high"), F.least("lat", F.when(F.col("event_id") % 3 == 0, F.col("alt"))).alias("low"))


@query("fun_22_clip", f"WITH {OBS} SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN least(5000.0, greatest(1000.0, alt)) END AS alt FROM obs")
def fun_22(spark, d):
    return obs(spark, d).select("event_id", geo.clip(F.when(F.col("event_id") % 5 != 0, F.col("alt")), 1000.0, 5000.0).alias("alt"))


@query("fun_23_interval", "SELECT event_id, least(ts - to_milliseconds((event_id % 500) * 10), date_trunc('hour', ts)) AS t FROM events")
def fun_23(spark, d):
    return read(spark, d, "events").select("event_id", F.least(F.col("ts") - F.make_dt_interval(secs=((F.col("event_id") % 500) / 100).cast("decimal(18,6)")), F.date_trunc("hour", "ts").cast("timestamp_ntz")).alias("t"))


@query("fun_24_sigmoid_logit", f"WITH {OBS} SELECT event_id, round(1 / (1 + exp(-least(40.0, greatest(-40.0, lon - 100)))), 6) AS s, round(ln(least(1 - 1e-6, greatest(1e-6, alt / 15000)) / (1 - least(1 - 1e-6, greatest(1e-6, alt / 15000)))), 5) AS l, round(ln(1 + speed), 6) AS g FROM obs")
def fun_24(spark, d):
    return obs(spark, d).select("event_id", r6(weights.sigmoid(F.col("lon") - 100)).alias("s"), r6(weights.logit(F.col("alt") / 15000), 5).alias("l"), r6(F.log1p("speed")).alias("g"))


@query("fun_25_huber", f"WITH {OBS} SELECT event_id, round(CASE WHEN abs(lon - 100) <= 4 THEN 0.5 * pow(lon - 100, 2) ELSE 4 * (abs(lon - 100) - 2) END, 6) AS h FROM obs")
def fun_25(spark, d):
    return obs(spark, d).select("event_id", r6(weights.huber(F.col("lon") - 100, 4.0)).alias("h"))


@query("fun_26_gaspari_cohn", f"""
WITH {OBS}, x AS (SELECT event_id, abs(lon - 100) / 10 AS x FROM obs)
SELECT event_id, round(CASE WHEN x <= 1 THEN 1 - 5/3.0::DOUBLE * pow(x, 2) + 0.625 * pow(x, 3) + 0.5 * pow(x, 4) - 0.25 * pow(x, 5)
WHEN x < 2 THEN 4 - 5 * x + 5/3.0::DOUBLE * pow(x, 2) + 0.625 * pow(x, 3) - 0.5 * pow(x, 4) + pow(x, 5) / 12.0::DOUBLE - 2 / (3 * x) ELSE 0 END, 5) + 0.0 AS k FROM x""")
def fun_26(spark, d):
    return obs(spark, d).select("event_id", (r6(weights.gaspari_cohn((F.col("lon") - 100) / 10), 5) + 0.0).alias("k"))


@query("fun_27_gaussian_kernel", f"WITH {OBS} SELECT event_id, round(exp(-0.5 * (pow((lat - 30) / 5, 2) + pow((lon - 100) / 5, 2) + pow((alt - 7000) / 3000, 2))), 6) AS k FROM obs")
def fun_27(spark, d):
    return obs(spark, d).select("event_id", r6(weights.gaussian((F.col("lat") - 30) / 5, (F.col("lon") - 100) / 5, (F.col("alt") - 7000) / 3000)).alias("k"))


@query("fun_28_pressure_altitude", "SELECT p_partkey, round(44330 * (1 - pow(p_retailprice / 1013.25, 0.1903)), 4) AS m FROM part WHERE p_retailprice > 1")
def fun_28(spark, d):
    return read(spark, d, "part").where("p_retailprice > 1").select("p_partkey", r6(geo.pressure_altitude(F.col("p_retailprice")), 4).alias("m"))


@query("fun_29_vertical_speed", f"WITH {OBS} SELECT event_id, round(-((lon - 100) / 100) / ((20000 + alt * 3) / (287.05 * (220 + lat)) * 9.80665), 6) + 0.0 AS w FROM obs")
def fun_29(spark, d):
    return obs(spark, d).select("event_id", (r6(geo.vertical_speed((F.col("lon") - 100) / 100, 20000 + F.col("alt") * 3, 220 + F.col("lat"))) + 0.0).alias("w"))


@query("fun_30_radial_velocity", f"WITH {OBS} SELECT event_id, round((wind_speed * (lon - 100.0005) + speed * (lat - 30.0005)) / sqrt(pow(lon - 100.0005, 2) + pow(lat - 30.0005, 2)), 5) + 0.0 AS vr FROM obs")
def fun_30(spark, d):
    return obs(spark, d).select("event_id", (r6(geo.radial_velocity(F.col("wind_speed"), F.col("speed"), F.col("lon") - 100.0005, F.col("lat") - 30.0005), 5) + 0.0).alias("vr"))


@query("fun_31_gross_error", f"""
WITH {OBS}, x AS (SELECT event_id, ln(0.95::DOUBLE) - 0.5 * pow((lon - 100) / 5, 2) - ln(5.0::DOUBLE) - 0.9189385332046727 - ln(0.05 / 60.0::DOUBLE) AS g FROM obs)
SELECT event_id, round(1 / (1 + exp(-least(40.0, greatest(-40.0, g)))), 6) AS p FROM x""")
def fun_31(spark, d):
    return obs(spark, d).select("event_id", r6(weights.good_posterior(F.col("lon") - 100, F.lit(5.0), 0.05, 60.0)).alias("p"))


@query("fun_32_buddy_factor", f"WITH {OBS}, x AS (SELECT event_id, abs(lon - 100) / (2 * sqrt(25 + pow(wind_speed / 10, 2))) AS r FROM obs) SELECT event_id, CASE WHEN r <= 1 THEN 1.0 ELSE round(exp(-0.5 * pow(r - 1, 2)), 6) END AS f FROM x")
def fun_32(spark, d):
    return obs(spark, d).select("event_id", r6(weights.buddy_factor(F.col("lon") - 100, F.lit(5.0), F.col("wind_speed") / 10)).alias("f"))


@query("fun_33_softmax", """
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 10 AS c, greatest(0.05, stddev_pop(l_quantity / 10) OVER (PARTITION BY l_orderkey)) AS t FROM lineitem),
e AS (SELECT *, exp((min(c) OVER (PARTITION BY l_orderkey) - c) / t) AS e FROM c)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(e / sum(e) OVER (PARTITION BY l_orderkey), 5) AS p FROM e""")
def fun_33(spark, d):
    from windgrid.operators.windows import softmax

    li = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 10).alias("c"))
    return softmax(li, ["l_orderkey"], "c", "p").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r6(F.col("p"), 5).alias("p"))


@query("fun_34_height_sigma", f"WITH {OBS} SELECT event_id, (CASE WHEN alt <= 3000 THEN 2.0 WHEN alt <= 6000 THEN 2.4 WHEN alt <= 9000 THEN 2.8 WHEN alt <= 12000 THEN 3.2 ELSE 3.6 END)::DOUBLE AS sigma FROM obs")
def fun_34(spark, d):
    return obs(spark, d).select("event_id", weights.steps(F.col("alt"), [3000, 6000, 9000, 12000], [2.0, 2.4, 2.8, 3.2, 3.6]).alias("sigma"))


@query("fun_35_cyclic", "SELECT event_id, round(sin(2 * 3.141592653589793 * hour(ts) / 24), 6) + 0.0 AS s, round(cos(2 * 3.141592653589793 * hour(ts) / 24), 6) + 0.0 AS c FROM events")
def fun_35(spark, d):
    s, c = weights.cyclic(F.hour("ts"), 24.0)
    return read(spark, d, "events").select("event_id", (r6(s) + 0.0).alias("s"), (r6(c) + 0.0).alias("c"))


@query("fun_36_relative_error", f"WITH {OBS} SELECT event_id, round(speed / greatest(wind_speed, 1e-6), 4) AS rel, round(speed / greatest(wind_speed, 10.0), 6) AS rel10 FROM obs WHERE wind_speed > 0.005")
def fun_36(spark, d):
    return obs(spark, d).where("wind_speed > 0.005D").select("event_id", r6(F.col("speed") / F.greatest("wind_speed", F.lit(1e-6)), 4).alias("rel"), r6(F.col("speed") / F.greatest("wind_speed", F.lit(10.0))).alias("rel10"))


@query("fun_37_strings", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d%H%M%S') || '_' || lower(trim(o_orderpriority)) || CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE '' END AS k, length(o_orderpriority)::INTEGER AS n FROM orders")
def fun_37(spark, d):
    key = F.concat(F.date_format("o_orderdate", "yyyyMMddHHmmss"), F.lit("_"), F.lower(F.trim("o_orderpriority")), F.when(F.col("o_orderkey") % 4 != 0, ""))
    return read(spark, d, "orders").select("o_orderkey", key.alias("k"), F.length("o_orderpriority").alias("n"))


@query("fun_38_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS dumped FROM events")
def fun_38(spark, d):
    return read(spark, d, "events").select("event_id", F.from_json("props", "k long").getField("k").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("dumped"))


@query("fun_39_arrays", "SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ',') AS kinds, array_to_string(list_sort(list(event_id))[1:3], ',') AS first_ids FROM events GROUP BY user_id")
def fun_39(spark, d):
    e = read(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("k"), F.sort_array(F.collect_list("event_id")).alias("i"))
    return e.select("user_id", F.array_join("k", ",").alias("kinds"), F.array_join(F.transform(F.slice("i", 1, 3), lambda x: x.cast("string")), ",").alias("first_ids"))


@query("fun_40_count_map", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id")
def fun_40(spark, d):
    n = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    return m.select("user_id", F.coalesce(F.try_element_at("m", F.lit("click")), F.lit(0)).cast("long").alias("clicks"), F.size("m").cast("long").alias("kinds"))
