"""The pairwise fit against its definition, the border as a quantile, and held-out accuracy on the driver's tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windgrid.llm import quality
from windgrid.llm.queries import QUERIES
from windgrid.llm.scratch import table


def test_loss_and_gradient():
    rng = np.random.default_rng(0)
    good, bad, w = rng.normal(size=(9, 4)), rng.normal(size=(9, 4)), rng.normal(size=4)

    def plain(w):
        return np.mean([-np.log(1 / (1 + np.exp(-(g @ w - b @ w)))) for g, b in zip(good, bad, strict=True)]) + 0.01 * sum(w**2) / 2

    assert quality.loss(w, good - bad, 0.01) == pytest.approx(plain(w))
    for k in range(4):
        e = np.eye(4)[k] * 1e-6
        assert quality.gradient(w, good - bad, 0.01)[k] == pytest.approx((plain(w + e) - plain(w - e)) / 2e-6, abs=1e-7)


def test_fit_is_near_the_least_loss():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    y = (x @ [1.0, -2.0, 0.0] + rng.normal(size=400) > 0).astype(int)
    model = quality.fit(x, y, pairs=4000)
    z = np.clip((x - model.mean) / model.spread, -8, 8)
    every = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, 3)
    found = quality.loss(model.weights, every, 1e-4)
    assert all(found <= quality.loss(model.weights + step, every, 1e-4) + 2e-3 for step in rng.normal(size=(200, 3)) * 0.3)
    assert model.weights[0] > 0 > model.weights[1]


@pytest.mark.parametrize("q", [0.1, 0.5, 0.9])
def test_border_at_a_quantile(q):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(500, 2)), rng.integers(0, 2, 500)
    model = quality.fit(x, y, pairs=1000, steps=50, quantile=q)
    assert model.quantile == pytest.approx(q, abs=0.003)
    assert np.mean(model.score(x) < quality.THRESHOLD) == pytest.approx(q, abs=0.01)
    assert 0 < quality.fit(x, y, pairs=1000, steps=50).quantile <= 1


def test_order_of_tasks_changes_nothing(spark):
    rows = [(i, " ".join("word" if i % 3 else "WORD!!" for _ in range(20 + i % 9)), int(i % 3 > 0)) for i in range(90)]
    d = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    labels = d.select("doc_id", "quality")
    one, two = quality.train(d.repartition(5), labels, F.lit(True)), quality.train(d.orderBy(F.desc("doc_id")).coalesce(1), labels, F.lit(True))
    assert np.array_equal(one.weights, two.weights) and one.border == two.border


def test_held_out_texts_of_the_tables(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    rows = QUERIES["op2_bradley_terry_quality"](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").select("quality", "predicted", "score").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    assert np.mean([np.mean(np.array(bad) < s) for s in good]) > 0.9  # a better document is scored higher
    right = [np.mean([r["predicted"] == k for r in rows if r["quality"] == k]) for k in (0, 1)]
    assert min(right) > 0.8, right
