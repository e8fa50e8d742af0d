"""Edge rules on small fixtures, with expectations worked out by hand."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from windgrid.functions import clean, geo, weights
from windgrid.operators import fusion, ordering, sequences, windows
from windgrid.operators.joins import asof_nearest, bracket, interval_join
from windgrid.operators.voxels import Grid, voxelize
from windgrid.sources import tables


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_finite_and_clip(spark):
    row = one(spark, *[clean.finite(F.lit(x)).alias(n) for n, x in (("a", "1.5"), ("b", "x"), ("c", "NaN"), ("d", "Infinity"))], geo.clip(F.lit(None).cast("double"), 0.0, 1.0).alias("e"))
    assert tuple(row) == (1.5, None, None, None, None)


def test_angles_and_vectors(spark):
    u, v = geo.wind_vector(F.lit(270.0), F.lit(10.0))
    row = one(spark, geo.angle_difference(F.lit(350.0), F.lit(10.0)), geo.angle_difference(F.lit(10.0), F.lit(350.0)), geo.angle_difference(F.lit(0.0), F.lit(180.0)), u, v)
    assert row[:3] == (20.0, 20.0, 180.0)
    assert row[3] == pytest.approx(10.0) and row[4] == pytest.approx(0.0, abs=1e-9)


def test_units(spark):
    row = one(spark, clean.altitude_metres_by_row(F.lit(31000.0)), clean.altitude_metres_by_row(F.lit(45001.0)), clean.coordinate(F.lit("N28203089"), 90.0), clean.coordinate(F.lit("E109399986"), 180.0), clean.coordinate(F.lit("30.5"), 90.0), clean.identity(F.lit(" b-12.3x ")), clean.identity(F.lit(" ")))
    assert row[0] == pytest.approx(9448.8) and row[1] == 45001.0
    assert row[2] == pytest.approx(28.203089) and row[3] == pytest.approx(109.399986) and row[4] == 30.5
    assert row[5:] == ("B123X", "MISSING")


def test_beijing_day(spark):
    t = F.lit("2024-05-02 00:30:00").cast("timestamp_ntz") - F.expr("INTERVAL 8 HOURS")
    assert one(spark, t)[0] == dt.datetime(2024, 5, 1, 16, 30)


def test_break_at_exactly_the_gap(spark):
    p = spark.createDataFrame([(1, 0), (1, 900), (1, 1801)], "k int, t int")
    gap = F.col("t") - F.lag("t").over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("k").orderBy("t"))
    legs = windows.islands(p.withColumn("g", gap), ["k"], ["t"], F.col("g") > 900).orderBy("t").collect()
    assert [r["leg"] for r in legs] == [1, 1, 2]


def test_gaspari_cohn_ends(spark):
    row = one(spark, *[weights.gaspari_cohn(F.lit(x)) for x in (0.0, 1.0, 2.0, 2.5)])
    assert row[0] == 1.0 and row[1] == pytest.approx(5 / 24) and row[2] == 0.0 and row[3] == 0.0


def test_voxel_edges(spark):
    p = spark.createDataFrame([(54.2, 73.0, 0.0), (12.2, 100.0, 0.0), (54.3, 80.0, 0.0), (30.0, 135.0, 0.0), (30.0, 80.0, 15000.0), (30.0, 80.0, 15500.0)], "lat double, lon double, alt double")
    found = {(r["lat"], r["lon"], r["alt"]) for r in voxelize(p, Grid()).collect()}
    assert found == {(54.2, 73.0, 0.0), (30.0, 80.0, 15000.0)}


def test_holdout_counts(spark):
    for n, want in ((1, [0]), (2, [0]), (5, [0]), (13, [0, 6, 12])):
        df = spark.createDataFrame([(0, i) for i in range(n)], "k int, i int")
        held = ordering.spread_holdout(df, ["k"], ["i"], 0.2).where("held").orderBy("i").collect()
        assert [r["i"] for r in held] == want


def test_asof(spark):
    left = spark.createDataFrame([("a", 10), ("a", 100), ("b", 5), (None, 1)], "k string, t long")
    right = spark.createDataFrame([("a", 8, 1), ("a", 12, 2), ("a", 10, 9), ("b", 50, 3), (None, 1, 4)], "k string, s long, i int")
    got = {(r["k"], r["t"]): r["match"]["i"] if r["match"] else None for r in asof_nearest(left, right, ["k"], "t", "s", "i", 20).collect()}
    assert got == {("a", 10): 9, ("a", 100): None, ("b", 5): None, (None, 1): None}
    tie = asof_nearest(left.where("t = 10"), right.where("i < 3"), ["k"], "t", "s", "i").first()
    assert tie["match"]["i"] == 1  # of equal distances the earlier


def test_bracket_and_interval(spark):
    left = spark.createDataFrame([("a", 15)], "k string, t long")
    right = spark.createDataFrame([("a", 10, 1.0), ("a", 20, 3.0)], "k string, s long, v double")
    r = bracket(left, right, ["k"], "t", "s", "v").first()
    assert (r["t0"], r["v0"], r["t1"], r["v1"], r["alpha"]) == (10, 1.0, 20, 3.0, 0.5)
    spans = spark.createDataFrame([("a", 0, 15), ("a", 16, 30)], "k string, low long, high long")
    assert [(x["low"], x["high"]) for x in interval_join(left, spans, ["k"], "t", "low", "high", 7).collect()] == [(0, 15)]


def test_weight_caps_and_single_group(spark):
    df = spark.createDataFrame([(0, "a", 10.0)], "v int, f string, w double")
    alone = windows.weight_caps(df, "w", [(["v"], 30.0)], (["v"], ["f"], 0.3)).first()
    assert alone["w"] == 10.0
    two = windows.weight_caps(df.union(spark.createDataFrame([(0, "b", 1.0)], df.schema)), "w", [], (["v"], ["f"], 0.3)).collect()
    assert {r["f"]: round(r["w"], 6) for r in two}["a"] == pytest.approx(3 / 7, abs=1e-6)


def test_leak_is_refused(spark):
    rows = spark.createDataFrame([(0, 0, 0, 0, 1.0, 2.0, "wind"), (0, 0, 0, 1, 1.0, 2.0, "wind")], "frame int, z int, y int, x int, u double, v double, role string")
    held = rows.where("x = 1")
    fusion.guard(rows.where("x = 0"), held, {"wind"})
    with pytest.raises(fusion.Leak):
        fusion.guard(rows, held, {"wind"})
    with pytest.raises(fusion.Leak):
        fusion.guard(rows.where("x = 0").withColumn("role", F.lit("motion")), held, {"wind"})


def test_accumulation_conserves_weight(spark):
    o = spark.createDataFrame([(0, 1, 2, 3, "current", 3.0, 4.0, 2.0)], "frame int, z int, y int, x int, role string, u double, v double, w double")
    acc = fusion.accumulate(o, 1, 1, 1, 1.0, 1.0)
    assert acc.count() == 27
    centre = acc.where("z = 1 and y = 2 and x = 3").first()
    assert centre["cur_w"] == 2.0 and centre["cur_wu"] == 6.0 and centre["ctx_w"] == 0.0


def brute_drop(cost, penalty):
    n, m = cost.shape
    best = math.inf

    def walk(i, j, total):
        nonlocal best
        if total >= best:
            return
        if i == n:
            best = total
            return
        walk(i + 1, j, total + penalty)
        for k in range(j, m):
            walk(i + 1, k, total + cost[i, k])

    walk(0, 0, 0.0)
    return best


def test_alignment_against_all_paths():
    rng = np.random.default_rng(1)
    for _ in range(60):
        cost = rng.random((rng.integers(1, 5), rng.integers(1, 5)))
        for penalty in (0.1, 0.5, 10.0):
            total, path = sequences.drop_alignment(cost, penalty)
            hit = path >= 0
            assert total == pytest.approx(brute_drop(cost, penalty))
            assert total == pytest.approx(cost[np.nonzero(hit)[0], path[hit]].sum() + penalty * (~hit).sum())
            assert (np.diff(path[hit]) >= 0).all()
        full, path = sequences.monotone_path(cost)
        assert full == pytest.approx(brute_drop(cost, 1e9))
        assert full == pytest.approx(cost[np.arange(len(cost)), path].sum())


def test_equal_cost_is_a_match():
    assert sequences.drop_alignment(np.array([[0.5]]), 0.5)[1].tolist() == [0]


def test_isotonic_steps():
    upper, value = sequences.pool_adjacent(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0.0, 1.0, 0.0, 1.0]))
    assert value.tolist() == [0.0, 0.5, 1.0] and upper.tolist() == [1.0, 3.0, 4.0]
    assert sequences.step_lookup(upper, value, np.array([0.0, 1.5, 3.0, 9.0])).tolist() == [0.0, 0.5, 0.5, 1.0]


def test_corruptions_repeat():
    p = np.arange(30, dtype=float).reshape(10, 3)
    for kind in sequences.CORRUPTIONS:
        assert np.array_equal(sequences.corrupt(p, kind, 7), sequences.corrupt(p, kind, 7))
    assert np.array_equal(sequences.corrupt(p, "time_bias", 7), p)


def test_smoother_keeps_a_constant():
    x, spread = sequences.smooth(np.arange(5.0), np.full(5, 3.0), 1e-6, 0.1)
    assert np.allclose(x, 3.0) and (spread > 0).all()


def test_sources(spark, tmp_path):
    assert tables.byte_ranges("1:0:d:U:500 mb:x\n2:100:d:V:500 mb:x\n3:250:d:U:500 mb:x", {"U"}, {"500 mb"}) == [(0, 99), (250, None)]
    assert tables.rewrite_prefix({"a": ["/old/x", "y"]}, "/old", "/new") == {"a": ["/new/x", "y"]}
    with pytest.raises(ValueError):
        tables.diagonal_union([])
    (tmp_path / "f_1.bin").write_bytes(b"x")
    assert tables.files(spark, str(tmp_path), "*.bin").count() == 1
