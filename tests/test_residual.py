"""The residual network against its loss by definition and finite differences; features of bare points."""

import numpy as np
import pytest

from windgrid.operators import residual as R


def plain_loss(model, x, y, gate, weight, how):
    total = 0.0
    delta, sigma = model(x)
    for i in range(len(x)):
        for j in range(2):
            fix = gate[i] * delta[i, j]
            miss, s = fix - y[i, j], min(max(sigma[i, j], 0.25), 40.0)
            huber = 0.5 * miss**2 / how.beta if abs(miss) < how.beta else abs(miss) - 0.5 * how.beta
            nll = min(max(0.5 * ((miss / s) ** 2 + 2 * np.log(s)), -2), 20)
            total += weight[i] * huber / len(x) + how.likelihood * nll / (2 * len(x)) + how.size * (fix / model.cap) ** 2 / (2 * len(x))
    return total


def case(seed=1, rows=7):
    rng = np.random.default_rng(seed)
    return R.network(5, 6, 2, 3.0, seed), rng.normal(size=(rows, 5)), rng.normal(0, 4, (rows, 2)), rng.random(rows), rng.random(rows)


def test_loss_and_gradient():
    model, *data = case()
    how = R.Loss(likelihood=0.5, size=0.3)
    loss, found = model.gradient(*data, how)
    assert loss == pytest.approx(plain_loss(model, *data, how))
    rng = np.random.default_rng(2)
    for p, g in zip(model.parameters(), found, strict=True):
        assert p.shape == g.shape
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in p.shape)
            kept, e = p[at], 1e-5
            p[at] = kept + e
            up = plain_loss(model, *data, how)
            p[at] = kept - e
            down = plain_loss(model, *data, how)
            p[at] = kept
            assert g[at] == pytest.approx((up - down) / (2 * e), abs=1e-7, rel=1e-4)


def test_fit_learns_and_stays_within_the_cap():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    y = np.stack([np.sin(x[:, 0]) * 2, x[:, 1] * x[:, 2]], axis=1)
    one = np.ones(600)
    model = R.network(4, 24, 2, 3.0, 0)
    before = model.gradient(x, y, one, one, R.Loss())[0]
    first = model.layers[0][0].copy()
    R.fit(model, x, y, one, one, epochs=60, rate=3e-3)
    after = model.gradient(x, y, one, one, R.Loss())[0]
    delta, sigma = model(x)
    assert after < 0.25 * before and np.abs(model.layers[0][0] - first).max() > 0.01  # the hidden layers learn too
    assert np.abs(delta).max() <= 3 and sigma.min() >= 0.25
    assert np.corrcoef(delta[:, 0], y[:, 0])[0, 1] > 0.95


def test_features_of_bare_points(spark):
    df = spark.createDataFrame([(1, "2024-03-01 06:30:00", None, 13000.0), (2, "2024-03-01 18:00:00", float("nan"), 100.0)], "id long, t string, recon_confidence double, alt_m double").selectExpr("id", "timestamp(t) as t", "recon_confidence", "alt_m")
    f = R.features(df, ["id"], "t", (10, 10, 10), 20000.0)
    assert len(f.columns) == 65
    a, b = f.orderBy("id").collect()
    # distance 99 is far, no confidence, no support: 0.23 + 0.18 + 0.16, and 0.06 above 12 km
    assert a["representation_risk_score"] == pytest.approx(0.63) and b["representation_risk_score"] == pytest.approx(0.57)
    assert a["sigma_rep_proxy_mps"] == pytest.approx(2 + 22 * 0.63 + 4) and a["nearest_source_unknown"] == 1 and a["recon_confidence"] == 0 == b["recon_confidence"]
    assert b["hour_sin"] == pytest.approx(-1) and b["residual_gate_initial"] == pytest.approx((1 - 0.8 * 0.57) * 0.05 * 0.45)
