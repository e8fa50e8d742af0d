"""Sources and sinks as queries over the driver's tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import functions as F

from windgrid.operators.ordering import global_row_number
from windgrid.plans.base import OBS, obs, query, read
from windgrid.sources import tables as S


def _folder(spark, name: str) -> str:
    """A folder for a round trip, in the place that all executors share; a local one only where none is named."""
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="windgrid-src-")
        atexit.register(shutil.rmtree, folder, True)
        base = "file://" + folder
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("src_01_manifest_shards", "SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS c_acctbal FROM customer")
def src_01(spark, d):
    c, at = read(spark, d, "customer"), _folder(spark, "shards")
    c.where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_acctbal").write.parquet(f"{at}/a.parquet")
    c.where("c_custkey % 2 = 1").select("c_custkey", "c_name").write.parquet(f"{at}/b.parquet")
    S.write_manifest(spark, at, ["elsewhere/a.parquet", "b.parquet", "absent.parquet"])
    return S.read_manifest(spark, at).select("c_custkey", "c_name", "c_acctbal")


@query("src_02_lazy_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_shipdate >= TIMESTAMP '1996-01-01'")
def src_02(spark, d):
    return read(spark, d, "lineitem").where((F.col("l_quantity") > 45) & (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz"))).select("l_orderkey", "l_quantity")


@query("src_03_projected_read", "SELECT p_partkey, p_size::DOUBLE AS p_size FROM part")
def src_03(spark, d):
    return read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"))


@query("src_04_schema_only", "SELECT * FROM (VALUES ('n_nationkey', 'int'), ('n_name', 'string'), ('n_regionkey', 'int')) t(name, kind)")
def src_04(spark, d):
    return spark.createDataFrame(read(spark, d, "nation").dtypes, "name string, kind string")


@query("src_06_workbook_kind", "SELECT * FROM (VALUES ('x/location_2026.xlsx', 'location'), ('AMDAR-7.xlsx', 'amdar'), ('turb.xlsx', 'turb'), ('other.xlsx', 'generic')) t(path, kind)")
def src_06(spark, d):
    return spark.createDataFrame([(p, S.workbook_kind(p)) for p in ("x/location_2026.xlsx", "AMDAR-7.xlsx", "turb.xlsx", "other.xlsx")], "path string, kind string")


@query("src_07_csv_numbers", "SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier")
def src_07(spark, d):
    at = _folder(spark, "csv")
    text = F.when(F.col("s_suppkey") % 3 == 0, "n/a").otherwise(F.col("s_acctbal").cast("string"))
    read(spark, d, "supplier").select("s_suppkey", "s_name", text.alias("s_acctbal")).write.option("header", True).csv(at)
    return S.read_csv_numbers(spark, at, ["s_acctbal"]).select("s_suppkey", "s_name", "s_acctbal")


@query("src_08_index_merge", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS origin FROM orders")
def src_08(spark, d):
    o = read(spark, d, "orders").select("o_orderkey")
    return S.latest_wins(o.withColumn("origin", F.lit("old")), o.where("o_orderkey % 3 = 0").withColumn("origin", F.lit("new")), ["o_orderkey"])


@query("src_10_time_in_name", "SELECT event_id, date_trunc('second', ts) AS t FROM events WHERE event_id % 9 <> 0")
def src_10(spark, d):
    name = F.concat(F.lit("a_b_c_d_e_f_g_"), F.when(F.col("event_id") % 9 != 0, F.date_format("ts", "yyyyMMddHHmmss")).otherwise("bad"), F.lit("_x.png"))
    return read(spark, d, "events").select("event_id", S.time_in_name(name).alias("t")).where("t is not null")


@query("src_11_image_blocks", """
WITH p AS (SELECT l_suppkey AS frame, l_partkey % 40 AS y, l_orderkey % 40 AS x, CASE WHEN l_quantity > 20 THEN l_quantity ELSE 0 END AS value FROM lineitem), b AS (SELECT frame, y // 4 AS y, x // 4 AS x, round(avg(value), 6) AS mean, max(value) AS top FROM p GROUP BY 1, 2, 3 HAVING max(value) > 0)
SELECT frame, z, y, x, mean, top FROM b, range(3) r(z)""")
def src_11(spark, d):
    p = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("frame"), (F.col("l_partkey") % 40).alias("y"), (F.col("l_orderkey") % 40).alias("x"), F.when(F.col("l_quantity") > 20, F.col("l_quantity")).otherwise(0.0).alias("value"))
    return S.image_blocks(p, 4, 3).select("frame", F.col("z").cast("long").alias("z"), "y", "x", F.round("mean", 6).alias("mean"), "top")


@query("src_12_frame_read", f"WITH {OBS} SELECT event_id, ts::DATE AS frame FROM obs WHERE ts::DATE = DATE '2024-01-10'")
def src_12(spark, d):
    at = _folder(spark, "frames")
    S.write_frames(obs(spark, d).select("event_id", F.to_date("ts").alias("frame")), at)
    return spark.read.parquet(at).where("frame = date'2024-01-10'").select("event_id", "frame")


@query("src_17_nearest_cycle", "SELECT event_id, (floor(epoch_us(ts) / 1e6 / 21600 + 0.5) * 21600)::BIGINT AS cycle, round((epoch_us(ts) / 1e6 - floor(epoch_us(ts) / 1e6 / 21600 + 0.5) * 21600) / 3600)::BIGINT AS hour FROM events")
def src_17(spark, d):
    cycle, hour = S.nearest_cycle(F.col("ts"))
    return read(spark, d, "events").select("event_id", cycle.alias("cycle"), hour.alias("hour"))


@query("src_18_level_merge", "SELECT l_suppkey, l_linenumber, coalesce(max(l_quantity) FILTER (WHERE l_returnflag = 'A'), max(l_quantity)) AS q FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2")
def src_18(spark, d):
    li = read(spark, d, "lineitem")
    a, b = (li.where(F.col("l_returnflag") == f).groupBy("l_suppkey", "l_linenumber").agg(F.max("l_quantity").alias("q")) for f in "AR")
    return S.level_merge(a, b, ["l_suppkey", "l_linenumber"])


@query("src_20_parquet_sink", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def src_20(spark, d):
    at = _folder(spark, "sink")
    s = read(spark, d, "supplier").join(read(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"))
    s.write.option("compression", "zstd").parquet(at)
    return spark.read.parquet(at)


@query("src_21_concatenating_sink", "SELECT count(*) AS n, sum(l_linenumber)::BIGINT AS s FROM lineitem")
def src_21(spark, d):
    at, li = _folder(spark, "concat"), read(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    for k in range(2):
        li.where(F.col("l_orderkey") % 2 == k).write.mode("append").parquet(at)
    return spark.read.parquet(at).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("s"))


@query("src_22_frame_archive", f"WITH {OBS} SELECT ts::DATE AS frame, count(*) AS n FROM obs GROUP BY 1")
def src_22(spark, d):
    at = _folder(spark, "archive")
    S.write_frames(obs(spark, d).select("event_id", F.to_date("ts").alias("frame")), at)
    return spark.read.parquet(at).groupBy("frame").agg(F.count("*").alias("n"))


@query("src_23_sparse_field", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount FROM lineitem WHERE l_discount <> 0")
def src_23(spark, d):
    return S.sparse(read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount"), "l_discount", 0.0)


@query("src_24_dense_restore", """
WITH c AS (SELECT l_suppkey AS frame, l_linenumber % 3 AS z, l_partkey % 4 AS y, l_orderkey % 5 AS x, max(l_quantity) AS v FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2, 3, 4), f AS (SELECT DISTINCT frame FROM c), g AS (SELECT frame, z, y, x FROM f, range(3) a(z), range(4) b(y), range(5) e(x))
SELECT frame, z, y, x, coalesce(v, -1.0) AS v FROM g LEFT JOIN c USING (frame, z, y, x)""")
def src_24(spark, d):
    c = read(spark, d, "lineitem").where("l_quantity > 45").groupBy(F.col("l_suppkey").alias("frame"), (F.col("l_linenumber") % 3).cast("long").alias("z"), (F.col("l_partkey") % 4).alias("y"), (F.col("l_orderkey") % 5).alias("x")).agg(F.max("l_quantity").alias("v"))
    return S.densify(c, c.select("frame").distinct(), (3, 4, 5), "v", -1.0)


@query("src_25_training_split", "WITH f AS (SELECT frame, row_number() OVER (ORDER BY frame) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date_trunc('hour', ts) AS frame FROM events)) SELECT frame, CASE WHEN (i - 1) / n::DOUBLE <= 0.70 THEN 'train' WHEN (i - 1) / n::DOUBLE <= 0.85 THEN 'validation' ELSE 'test' END AS split FROM f")
def src_25(spark, d):
    f = read(spark, d, "events").select(F.date_trunc("hour", "ts").alias("frame")).distinct()
    n = f.count()
    share = F.col("i") / n
    return global_row_number(f, ["frame"], "i").select("frame", F.when(share <= 0.70, "train").when(share <= 0.85, "validation").otherwise("test").alias("split"))


@query("src_26_reports", "SELECT user_id, '{\"clicks\":' || count(*) FILTER (WHERE event_type = 'click') || ',\"n\":' || count(*) || '}' AS report FROM events GROUP BY 1")
def src_26(spark, d):
    g = read(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count("*").alias("n"))
    return g.select("user_id", F.to_json(F.struct("clicks", "n")).alias("report"))


@query("src_28_point_lookup", f"WITH {OBS} SELECT event_id, speed, wind_speed FROM obs WHERE floor(alt / 500) = 7 AND floor((54.2::DOUBLE - lat) / 5.0) = 3 AND floor((lon - 73.0::DOUBLE) / 5.0) = 4")
def src_28(spark, d):
    return obs(spark, d).where((F.floor(F.col("alt") / 500) == 7) & (F.floor((54.2 - F.col("lat")) / 5.0) == 3) & (F.floor((F.col("lon") - 73.0) / 5.0) == 4)).select("event_id", "speed", "wind_speed")




@query("src_05_workbook_sheets", "SELECT s_nationkey AS sheet, s_suppkey, s_acctbal FROM supplier WHERE s_nationkey BETWEEN 3 AND 9")
def src_05(spark, d):
    # a workbook lands as one shard per sheet; offset and limit choose sheets in order
    at, s = _folder(spark, "workbook"), read(spark, d, "supplier").select(F.col("s_nationkey").alias("sheet"), "s_suppkey", "s_acctbal")
    s.write.option("compression", "zstd").partitionBy("sheet").parquet(at)
    return spark.read.schema(s.schema).parquet(at).where(F.col("sheet").between(3, 9)).select("sheet", "s_suppkey", "s_acctbal")


@query("src_09_file_discovery", "SELECT * FROM (VALUES (20240101000000), (20240101000600)) t(stamp)")
def src_09(spark, d):
    at = _folder(spark, "radar")
    name = F.concat(F.lit("a_b_c_d_e_f_g_"), F.col("s").cast("string"))
    stamps = spark.createDataFrame([(20240101000000,), (20240101000600,)], "s long")
    stamps.select(name.alias("n"), F.col("s").cast("string").alias("value")).write.partitionBy("n").text(at)
    found = S.files(spark, at, "*.txt").select(F.regexp_extract("path", r"n=([^/]+)/", 1).alias("n"))
    return found.select(F.date_format(S.time_in_name(F.col("n")), "yyyyMMddHHmmss").cast("long").alias("stamp"))


@query("src_13_level_stack", "SELECT l_linenumber AS level, l_suppkey % 5 AS y, l_partkey % 5 AS x, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY 1, 2, 3")
def src_13(spark, d):
    # decoded levels land as a long table, whatever the container was
    return read(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("level"), (F.col("l_suppkey") % 5).alias("y"), (F.col("l_partkey") % 5).alias("x")).agg(F.round(F.avg("l_quantity"), 6).alias("v"))


@query("src_14_axis_order", f"WITH {OBS}, a AS (SELECT DISTINCT floor(lat)::BIGINT AS lat FROM obs) SELECT lat, row_number() OVER (ORDER BY lat) - 1 AS i FROM a")
def src_14(spark, d):
    from windgrid.operators.ordering import global_row_number

    a = obs(spark, d).select(F.floor("lat").alias("lat")).distinct()
    return global_row_number(a, ["lat"], "i", F.floor(F.col("lat") / 10)).select("lat", F.col("i").cast("long").alias("i"))


@query("src_15_path_resolution", "SELECT * FROM (VALUES ('b.parquet')) t(name)")
def src_15(spark, d):
    at = _folder(spark, "paths")
    read(spark, d, "region").write.parquet(f"{at}/b.parquet")
    found = S.resolve(spark, at, ["absent.parquet", "elsewhere/b.parquet"])
    return spark.createDataFrame([(p.rsplit("/", 1)[-1],) for p in found], "name string")


@query("src_16_byte_ranges", "SELECT * FROM (VALUES (0, 99), (250, NULL)) t(low, high)")
def src_16(spark, d):
    ranges = S.byte_ranges("1:0:d:U:500 mb:x\n2:100:d:V:500 mb:x\n3:250:d:U:500 mb:x", {"U"}, {"500 mb"})
    return spark.createDataFrame(ranges, "low int, high int")


@query("src_27_prefix_rewrite", "SELECT p_partkey, 'data/new/' || p_name AS path FROM part")
def src_27(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.concat(F.lit("/old/"), "p_name").alias("path"))
    return p.select("p_partkey", F.regexp_replace("path", "^/old/", "data/new/").alias("path"))
