"""Order, limits, samples and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windgrid.operators import ordering as O
from windgrid.plans.base import OBS, obs, query, read

HASH = "(({k} * 2654435761) % 4294967296)"


@query("srt_01_multi_key", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority ASC, o_totalprice DESC, o_orderkey)::INTEGER AS place FROM orders QUALIFY place <= 100")
def srt_01(spark, d):
    top = read(spark, d, "orders").orderBy(F.asc_nulls_first("o_orderpriority"), F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(100)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy("o_orderpriority", F.col("o_totalprice").desc(), "o_orderkey")).alias("place"))


@query("srt_02_group_head", "SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS r FROM lineitem) WHERE r <= 3")
def srt_02(spark, d):
    return O.top_k(read(spark, d, "lineitem"), ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey"], 3).select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query("srt_03_keep_first", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def srt_03(spark, d):
    return O.keep_first(read(spark, d, "events"), ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query("srt_04_sparse_top", """
WITH m AS (SELECT l_suppkey, l_partkey, max(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY s DESC, l_partkey) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n FROM m)
SELECT l_suppkey, l_partkey, s FROM r WHERE r <= least(n, greatest(3, round(n * 0.05)))""")
def srt_04(spark, d):
    m = read(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.max("l_extendedprice").alias("s"))
    w = Window.partitionBy("l_suppkey")
    m = m.withColumn("r", F.row_number().over(w.orderBy(F.col("s").desc(), "l_partkey"))).withColumn("n", F.count("*").over(w))
    return m.where("r <= least(n, greatest(3, round(n * 0.05D)))").select("l_suppkey", "l_partkey", "s")


@query("srt_05_neighbour_top", f"""
WITH {OBS}, p AS (SELECT a.event_id AS a, b.event_id AS b, abs(a.us - b.us) AS dt FROM obs a JOIN obs b ON a.ident = b.ident AND a.event_id <> b.event_id), r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dt, b) AS r FROM p)
SELECT a, b, (CASE WHEN r <= 1 THEN 1.0 WHEN r <= 3 THEN 0.5 ELSE 0 END)::DOUBLE AS edge FROM r WHERE r <= 4""")
def srt_05(spark, d):
    o = obs(spark, d).select("ident", "event_id", "us")
    # the 4 nearest in time are among the 4 on either side
    w = Window.partitionBy("ident").orderBy("us", "event_id")
    near = {f"{f.__name__}{k}": f(F.struct("event_id", "us"), k).over(w) for f in (F.lag, F.lead) for k in range(1, 5)}
    o = o.withColumns(near)
    p = o.select(F.col("event_id").alias("a"), "us", F.explode(F.array_compact(F.array(*near))).alias("n")).select("a", F.col("n.event_id").alias("b"), F.abs(F.col("us") - F.col("n.us")).alias("dt"))
    r = p.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("dt", "b"))).where("r <= 4")
    return r.select("a", "b", F.when(F.col("r") <= 1, 1.0).when(F.col("r") <= 3, 0.5).otherwise(0.0).alias("edge"))


@query("srt_06_tiered_selection", """
WITH o AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1), t AS (SELECT c_nationkey, c_custkey, c_acctbal, coalesce(n, 0) AS n, CASE WHEN c_acctbal > 9000 AND coalesce(n, 0) > 0 THEN 1 WHEN c_acctbal > 8000 THEN 2 ELSE 3 END AS tier FROM customer LEFT JOIN o ON o_custkey = c_custkey WHERE c_nationkey <> 7 OR c_acctbal < 0),
g AS (SELECT *, count(*) FILTER (WHERE tier < 3) OVER (PARTITION BY c_nationkey) AS hits FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN hits = 0 THEN 0 ELSE tier END, CASE WHEN hits > 0 AND tier = 1 THEN -n ELSE 0 END, c_acctbal DESC, c_custkey) AS r FROM g)
SELECT c_nationkey, c_custkey, CASE WHEN hits = 0 THEN 'fallback' WHEN tier = 1 THEN 'eligible' ELSE 'backfill' END AS origin FROM r WHERE r <= 8 AND (hits = 0 OR tier < 3)""")
def srt_06(spark, d):
    n = read(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    t = read(spark, d, "customer").where("c_nationkey <> 7 or c_acctbal < 0").join(n, "c_custkey", "left").na.fill(0, ["n"])
    return O.tiered_selection(t, ["c_nationkey"], (F.col("c_acctbal") > 9000) & (F.col("n") > 0), F.col("c_acctbal") > 8000, "n", "c_acctbal", "c_custkey", 8, 8).select("c_nationkey", "c_custkey", "origin")


@query("srt_07_hash_sample", f"SELECT event_id FROM events ORDER BY {HASH.format(k='event_id')}, event_id LIMIT 200")
def srt_07(spark, d):
    return O.hash_sample(read(spark, d, "events"), F.col("event_id"), 200).select("event_id")


@query("srt_08_sample_per_split", f"SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY {HASH.format(k='event_id')}, event_id) AS r FROM events) WHERE r <= 50")
def srt_08(spark, d):
    h = F.pmod(F.col("event_id") * 2654435761, F.lit(4294967296))
    return O.top_k(read(spark, d, "events"), ["event_type"], [h, "event_id"], 50).select("event_type", "event_id")


@query("srt_09_stratified", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part) SELECT p_partkey, p_brand FROM r ORDER BY r > 4, r, p_brand, p_partkey LIMIT 150""")
def srt_09(spark, d):
    return O.stratified(read(spark, d, "part"), ["p_brand"], ["p_partkey"], 150, 4).select("p_partkey", "p_brand")


@query("srt_10_hash_slices", f"SELECT {HASH.format(k='user_id')} % 25 AS slice, count(*) AS n FROM events GROUP BY 1")
def srt_10(spark, d):
    return read(spark, d, "events").groupBy(O.hash_slice(F.col("user_id"), 25).alias("slice")).agg(F.count("*").alias("n"))


@query("srt_11_representatives", """
WITH m AS (SELECT o_custkey, avg(o_totalprice) AS a FROM orders GROUP BY 1), r AS (SELECT o.*, row_number() OVER (PARTITION BY o.o_custkey ORDER BY abs(o_totalprice - a), o_orderkey) AS r FROM orders o JOIN m USING (o_custkey)) SELECT o_custkey, o_orderkey FROM r WHERE r = 1""")
def srt_11(spark, d):
    o = read(spark, d, "orders").withColumn("a", F.avg("o_totalprice").over(Window.partitionBy("o_custkey")))
    return o.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(F.abs(F.col("o_totalprice") - F.col("a")), "o_orderkey")).alias("o_orderkey"))


@query("srt_12_frame_subset", "WITH f AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS i FROM (SELECT DISTINCT date_trunc('hour', ts) AS frame FROM events)) SELECT frame, i FROM f WHERE i >= 100 AND i < 250 AND i % 5 = 0")
def srt_12(spark, d):
    f = read(spark, d, "events").select(F.date_trunc("hour", "ts").alias("frame")).distinct()
    return O.global_row_number(f, ["frame"], "i").where("i >= 100 and i < 250 and i % 5 = 0").select("frame", "i")


# ---- set operations


@query("set_01_union_diagonal", "SELECT c_custkey AS key, c_name AS name, NULL::DOUBLE AS price, c_acctbal AS balance FROM customer UNION ALL SELECT p_partkey, p_name, p_retailprice, NULL FROM part")
def set_01(spark, d):
    a = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    b = read(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set_02_union_relaxed", "SELECT n_nationkey::BIGINT AS key, n_name AS name FROM nation UNION ALL SELECT s_suppkey, s_name FROM supplier")
def set_02(spark, d):
    a = read(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))
    return a.unionByName(read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))


@query("set_03_union_keep_first", """
SELECT user_id, 'base' AS origin FROM events WHERE user_id % 3 = 0 GROUP BY user_id UNION ALL SELECT user_id, 'extra' FROM events WHERE user_id % 3 <> 0 AND user_id % 2 = 0 GROUP BY user_id""")
def set_03(spark, d):
    e = read(spark, d, "events").select("user_id").distinct()
    both = e.where("user_id % 3 = 0").select("user_id", F.lit(0).alias("p"), F.lit("base").alias("origin")).unionByName(e.where("user_id % 2 = 0").select("user_id", F.lit(1).alias("p"), F.lit("extra").alias("origin")))
    return O.keep_first(both, ["user_id"], ["p"]).select("user_id", "origin")


@query("set_04_difference", "SELECT DISTINCT date_trunc('hour', ts) AS frame FROM events EXCEPT SELECT DISTINCT date_trunc('hour', ts) FROM events WHERE event_type = 'purchase'")
def set_04(spark, d):
    f = read(spark, d, "events").withColumn("frame", F.date_trunc("hour", "ts"))
    return f.select("frame").distinct().join(f.where("event_type = 'purchase'").select("frame").distinct(), "frame", "left_anti")


@query("set_05_intersection", "SELECT user_id FROM events WHERE event_type = 'error' INTERSECT SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100")
def set_05(spark, d):
    e = read(spark, d, "events")
    return e.where("event_type = 'error'").select("user_id").intersect(e.where("event_type = 'signup' and value > 100").select("user_id"))


@query("set_06_except_all", "SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def set_06(spark, d):
    li = read(spark, d, "lineitem")
    return li.where("l_returnflag = 'R'").select("l_suppkey").exceptAll(li.where("l_returnflag = 'A'").select("l_suppkey"))


@query("win_25_every_kth", f"WITH {OBS}, r AS (SELECT ident, event_id, row_number() OVER (PARTITION BY ident ORDER BY us, event_id) - 1 AS p FROM obs) SELECT ident, event_id FROM r WHERE p % 5 = 4")
def win_25(spark, d):
    return O.every_kth(obs(spark, d), ["ident"], ["us", "event_id"], 5).select("ident", "event_id")


@query("win_26_spread_holdout", f"""
WITH {OBS}, r AS (SELECT ident, event_id, row_number() OVER (PARTITION BY ident ORDER BY us, event_id) - 1 AS i, count(*) OVER (PARTITION BY ident) AS n FROM obs), h AS (SELECT *, least(n, greatest(1, ceil(n * 0.2)))::BIGINT AS h FROM r)
SELECT ident, event_id, CASE WHEN h = 1 THEN i = 0 ELSE list_contains(list_transform(range(h), lambda k: round_even(k * (n - 1) / (h - 1)::DOUBLE, 0)::BIGINT), i) END AS held FROM h""")
def win_26(spark, d):
    return O.spread_holdout(obs(spark, d), ["ident"], ["us", "event_id"], 0.2).select("ident", "event_id", "held")


@query("win_27_chronological_split", """
WITH t AS (SELECT frame, row_number() OVER (ORDER BY frame) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date_trunc('hour', ts) AS frame FROM events))
SELECT frame, CASE WHEN i < round_even(n * 0.7, 0) THEN 'train' WHEN i < round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'validation' ELSE 'test' END AS split FROM t""")
def win_27(spark, d):
    f = read(spark, d, "events").select(F.date_trunc("hour", "ts").alias("frame")).distinct()
    return O.chronological_split(f, "frame", 0.7, 0.15).select("frame", "split")
