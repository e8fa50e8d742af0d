"""Smoother, bridges, corruption and calibration against values worked out by hand or by another way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windgrid.operators import calibration, corruption, smoothing


def test_two_points_by_hand():
    # noise 1, process 2e-6, one second: spread 1 + 2e-6 + 2e-6, gain near a half
    got = smoothing.filtered(np.array([0.0, 1.0]), np.array([0.0, 2.0]), np.ones(2), 2e-6)
    spread = 1 + 2e-6 + 2e-6
    gain = spread / (spread + 1)
    assert got[1] == pytest.approx([2 * gain, min(0.8, 2 * gain) * 2, (1 - gain) * spread])


def test_constant_speed_is_kept():
    t = np.arange(0, 600, 10.0)
    found = smoothing.smooth_states(t, 0.2 * t, np.full(60, 1e-4), 2e-6)
    assert np.abs(found[20:40, 0] - 0.2 * t[20:40]).max() < 0.1 and (found[:, 2] > 0).all()
    assert smoothing.smooth_states(t[:0], t[:0], t[:0], 1e-6).shape == (0, 3)


def test_equal_times_step_by_a_second():
    same, second = (smoothing.filtered(np.array([0.0, dt]), np.array([0.0, 1.0]), np.ones(2), 0.08) for dt in (0.0, 1.0))
    assert np.array_equal(same, second)


def test_tracklets_across_batches(spark):
    rows = [(k, i, float(i * 60), 30 + 0.01 * i, 100.0 + k, 9000.0 + i, 0.7) for k in range(40) for i in range(1 + k % 7)]
    points = spark.createDataFrame(rows, "k int, i int, t double, lat double, lon double, alt double, score double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        got = {(r["k"], r["i"]): r for r in smoothing.smoothed_tracklets(points, ["k"], ["i"], "t", "lat", "lon", "alt", "score").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert len(got) == len(rows)
    for k in range(40):
        own = [r for r in rows if r[0] == k]
        t, z = np.array([r[2] for r in own]), np.array([r[5] for r in own])
        want = smoothing.smooth_states(t, z, np.full(len(own), (20 + 180 * 0.3) ** 2), 0.08)
        assert [got[k, i]["s_alt"] for i in range(len(own))] == pytest.approx(want[:, 0])
        assert [got[k, i]["v_up"] for i in range(len(own))] == pytest.approx(want[:, 1])


def test_bridges_at_the_limits(spark):
    columns = ["lat", "lon", "alt", "v_east", "v_north", "v_up", "var_across", "var_alt"]
    still = dict.fromkeys(columns, 0.0) | {"lat": 30.0, "lon": 100.0, "alt": 9000.0, "var_across": 0.01, "var_alt": 400.0}
    leg = lambda n, a, b, **o: {"k": 1, "leg": n, "start_t": a, "end_t": b} | {f"{p}_{c}": v for p in ("start", "end") for c, v in (still | o).items()}
    rows = [leg(1, 0.0, 100.0), leg(2, 100.0, 200.0), leg(3, 201.0, 300.0), leg(4, 2101.0, 2200.0, alt=9000.0 + 12 * (800 + (1.5 * 1801) ** 2) ** 0.5), leg(5, 4002.0, 4100.0)]
    e = smoothing.bridge_edges(spark.createDataFrame(rows), ["k"], "leg", 1800.0)
    got = {(r["leg"], r["to_leg"]): r for r in e.collect()}
    assert (1, 2) not in got and (2, 3) in got  # a gap of 0, and of 1
    assert (3, 4) not in got and (4, 5) not in got  # 1801 and 1802 are too far
    assert got[2, 3]["prior"] == pytest.approx(np.exp(-0.001)) and got[2, 3]["physical"] and got[1, 3]["hop"] == 2


@pytest.mark.parametrize("kind", corruption.KINDS)
@pytest.mark.parametrize("n", [1, 2, 3, 10, 41])
def test_corruption_kinds(kind, n):
    seen = set()
    for case in range(5):
        order, shift = corruption.plan(n, kind, corruption.seed_of(case, kind))
        moved = (shift != 0).any(axis=1)
        seen.add(tuple(order))
        gone = n - len(order)
        assert len(set(order)) == len(order) and (len(order) or (kind, n) == ("point_missing", 1))
        if kind.startswith("drop_"):
            assert gone == min(n - 1, max(1, round(n * int(kind[5:]) / 100))) and (np.diff(order) > 0).all()
        elif kind in ("point_missing", "continuous_gap"):
            assert gone == (1 if kind == "point_missing" else min(n - 1, -(-3 * n // 10)))
            left_out = np.setdiff1d(np.arange(n), order)
            assert (np.diff(left_out) == 1).all()
        elif kind in ("point_outlier", "block_outlier"):
            assert moved.sum() == (1 if kind == "point_outlier" else min(n, max(2, -(-3 * n // 10)))) and set(np.abs(shift[moved]).ravel()) == {1.0}
            assert (np.diff(np.nonzero(moved)[0]) == 1).all()
        elif kind == "reverse":
            assert order.tolist() == list(range(n))[::-1]
        elif kind == "local_swap":
            assert (np.sort(order) == np.arange(n)).all() and (order != np.arange(n)).sum() == (2 if n >= 3 else 0)
        elif kind in ("clean", "receiver_time_bias"):
            assert order.tolist() == list(range(n)) and not moved.any()
    assert kind not in ("random_order", "drop_30") or n < 10 or len(seen) > 1


def test_descent_against_a_plain_one():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, 2)), rng.integers(0, 2, 50).astype(float)
    model = calibration.Logit.fit(x, y, steps=3, rate=0.1, ridge=0.5)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    w, b = [0.0, 0.0], np.log(y.mean() / (1 - y.mean()))
    for _ in range(3):
        p = [1 / (1 + np.exp(-(w[0] * r[0] + w[1] * r[1] + b))) for r in z]
        g = [sum((pi - yi) * r[k] for pi, yi, r in zip(p, y, z, strict=True)) / 50 + 0.5 * w[k] for k in (0, 1)]
        b -= 0.1 * sum(pi - yi for pi, yi in zip(p, y, strict=True)) / 50
        w = [w[k] - 0.1 * g[k] for k in (0, 1)]
    assert model.weights.tolist() == pytest.approx(w) and model.bias == pytest.approx(b)
    flat = calibration.Logit.fit(np.ones((4, 1)), np.array([0.0, 1, 1, 1]))
    assert flat.weights.tolist() == [0.0] and 1 / (1 + np.exp(-flat.score(np.ones((1, 1)))[0])) == pytest.approx(0.75)
    line = calibration.Sharpness.fit(np.array([-2.0, -1, 1, 2]) * 5, np.array([0.0, 0, 1, 1]))
    assert line.slope > 0 and abs(line.shift) < 0.2


def test_quantiles_against_numpy(spark):
    from windgrid.operators import quantiles

    rng = np.random.default_rng(4)
    rows = [(int(g), float(v), float(w)) for g, n in enumerate((1, 2, 7, 3000)) for v, w in zip(np.round(rng.normal(size=n), 2), rng.integers(1, 9, n), strict=True)] + [(None, 1.0, 1.0), (None, 4.0, 2.0), (3, None, 1.0), (9, None, 1.0)]
    df = spark.createDataFrame(rows, "g int, x double, w double")
    wanted = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.95, "e": 1.0}
    linear = {r["g"]: r for r in quantiles.quantiles(df, ["g"], "x", wanted).collect()}
    nearest = {r["g"]: r for r in quantiles.quantiles(df, ["g"], "x", wanted, "nearest").collect()}
    middle = {r["g"]: r["m"] for r in quantiles.weighted_median(df, ["g"], "x", "w", "m").collect()}
    for g in (None, 0, 1, 2, 3):
        own = sorted((r[1], r[2]) for r in rows if r[0] == g and r[1] is not None)
        x, w = np.array([v for v, _ in own]), np.cumsum([k for _, k in own])
        for n, q in wanted.items():
            assert linear[g][n] == pytest.approx(np.quantile(x, q))
            assert nearest[g][n] == x[int(np.floor((len(x) - 1) * q + 0.5))]
        assert middle[g] == x[np.argmax(w >= w[-1] / 2 - 1e-9)]
    assert 9 not in linear
    assert quantiles.quantiles(df, [], "x", {"m": 0.5}).first()["m"] == pytest.approx(np.median([r[1] for r in rows if r[1] is not None]))
    assert quantiles.quantiles(df.limit(0), ["g"], "x", wanted).count() == 0
    both = quantiles.with_quantiles(df, ["g"], [F.count("*").alias("n")], F.col("x"), {"m": 0.5})
    assert {r["g"]: (r["n"], r["m"]) for r in both.collect()}[9] == (1, None)


def test_brackets_by_bucket(spark):
    from windgrid.operators import joins

    rng = np.random.default_rng(8)
    right = spark.createDataFrame([(int(k), int(t), float(i)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 40), rng.choice(5000, 40, replace=False), strict=True))], "k int, s long, v double")
    left = spark.createDataFrame([(int(k), int(t)) for k, t in zip(rng.integers(0, 4, 60), rng.integers(-500, 6000, 60), strict=True)] + [(None, 5)], "k int, t long")
    plain, bucketed = (sorted(map(str, joins.bracket(left, right, ["k"], "t", "s", "v", width).collect())) for width in (None, 300))
    assert plain == bucketed and len(plain) == 60
    wide, narrow = (sorted(map(str, joins.asof_nearest(left, right, ["k"], "t", "s", "v", tolerance).collect())) for tolerance in (1e9, 250))
    for a, b in zip(wide, narrow, strict=True):
        assert a == b or "match=None" in b


def test_nearest_cells_far_away(spark):
    from windgrid.operators.nearest import nearest_cells

    rng = np.random.default_rng(9)
    a = [(i, 1, int(y), int(x)) for i, (y, x) in enumerate(rng.integers(0, 300, (30, 2)))]
    b = [(i, 1, int(y), int(x)) for i, (y, x) in enumerate(rng.integers(0, 60, (25, 2)))]
    got = nearest_cells(spark.createDataFrame(a, "a long, g int, y long, x long"), spark.createDataFrame(b, "b long, g int, y long, x long"), ["g"], "a", "b", 3).collect()
    for i, _, y, x in a:
        want = sorted(((y - v) ** 2 + (x - u) ** 2, j) for j, _, v, u in b)[:3]
        assert sorted((r["d2"], r["b"]) for r in got if r["a"] == i) == want


def test_pairs_over_pole_and_date_line(spark):
    from windgrid.operators.nearest import pairs_on_sphere

    points = spark.createDataFrame([(1, 10.0, 179.9), (2, 10.0, -179.9), (3, 89.5, 0.0), (4, 89.5, 180.0), (5, 40.0, 100.0)], "k int, lat double, lon double")
    got = {(r["a"]["k"], r["b"]["k"]) for r in pairs_on_sphere(points, "k", "lat", "lon", 600.0).collect()}
    assert {(1, 2), (2, 1), (3, 4), (4, 3)} <= got and not any(5 in p for p in got)


def test_time_never_passes_the_end(spark):
    from windgrid.operators import uncertainty

    rng = np.random.default_rng(10)
    rows = [(10**15, int(n), int(rng.integers(1, n + 1)), float(p) if rng.random() < 0.8 else None, float(g) if rng.random() < 0.8 else None, float(h), float(v), str(rng.choice(["ASC", "DES", "LVR", "x"])), bool(rng.random() < 0.5), 50.0, 2.0, 300.0, 10**15 + int(rng.integers(-(10**10), 10**10))) for n, p, g, h, v in zip(rng.integers(1, 12, 200), rng.uniform(0, 5000, 200), rng.uniform(-100, 9000, 200), rng.uniform(0, 1e6, 200), rng.uniform(0, 9000, 200), strict=True)]
    df = spark.createDataFrame(rows, "us long, n int, nth int, prior_s double, gap_s double, hspan_m double, vspan_m double, phase string, accepted boolean, sampling_s double, cross_km double, vertical_m double, estimate_us long")
    for r in uncertainty.row_times(df).collect():
        assert r["q10_us"] <= r["q50_us"] <= r["q90_us"] <= r["us"]
        assert r["accepted"] or 300 <= r["uncertainty_s"] <= 3600
        assert not r["accepted"] or r["uncertainty_s"] <= 300


def test_phases_and_profiles(spark, tmp_path):
    from windgrid import jobs

    lines = []
    done = jobs.run_phases([("a", lambda: spark.range(3)), ("b", lambda: spark.read.parquet(f"{tmp_path}/none")), ("c", lambda: spark.range(1))], jobs.to_parquet(spark, str(tmp_path)), lines.append)
    assert [(p.name, p.state, p.rows) for p in done] == [("a", "done", 3), ("b", "failed", 0), ("c", "skipped", 0)] and len(lines) == 4 and done[1].detail
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = jobs.compare_profiles(spark, lambda: spark.range(100).selectExpr("id % 7 as k"), {"base": {}, "two": {"spark.sql.shuffle.partitions": "2"}}, "base", 10)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before and found[0]["checksum"] == found[1]["checksum"] and found[0]["share_of_base"] == 1.0


def test_rejections_are_counted_by_the_first_rule(spark):
    from windgrid.operators import joins

    leg = dict(leg_id=1, tail=7, flight=70, start_s=1000, stop_s=5000, lat_a=30.0, lat_b=30.0, lon_a=100.0, lon_b=100.0, alt_a=9000.0, alt_b=9000.0, leg_phase="ASC")
    ok = dict(tail=7, flight=70, end_s=2000, previous_s=None, n=1, lat=30.0, lon=100.0, low_m=9000.0, high_m=9000.0, phase="ASC")
    changes = [
        {}, {"flight": 71}, {"flight": None}, {"tail": None}, {"tail": 8}, {"tail": 8, "flight": 99}, {"end_s": 939}, {"end_s": 940}, {"end_s": 12200}, {"end_s": 12201}, {"previous_s": 12200}, {"previous_s": 12201},
        {"lat": 30.75}, {"lat": 30.8}, {"low_m": 10500.0, "high_m": 10600.0}, {"low_m": 10501.0, "high_m": 10600.0}, {"phase": "DES"}, {"phase": "LVR"},
    ]
    batches = spark.createDataFrame([(i, *(ok | c).values()) for i, c in enumerate(changes)], "batch int, tail int, flight int, end_s long, previous_s long, n int, lat double, lon double, low_m double, high_m double, phase string")
    legs = spark.createDataFrame([tuple(leg.values())], "leg_id int, tail int, flight int, start_s long, stop_s long, lat_a double, lat_b double, lon_a double, lon_b double, alt_a double, alt_b double, leg_phase string")
    found, counts = joins.leg_candidates(batches, legs)
    assert {r["batch"]: r["grade"] for r in found.collect()} == {0: "ID-A", 1: "ID-B", 2: "ID-C", 3: "ID-D", 7: "ID-A", 8: "ID-A", 10: "ID-A", 12: "ID-A", 14: "ID-A", 17: "ID-A"}
    assert {r["verdict"]: r["n"] for r in counts.collect()} == {"candidate": 10, "identity_conflict": 1, "no_identity_candidate": 1, "time_failed": 3, "geometry_failed": 1, "altitude_failed": 1, "phase_failed": 1}
