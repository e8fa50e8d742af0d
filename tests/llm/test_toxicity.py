"""The positive-unlabelled fit against plain versions of its risk, and on the driver's tables."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from windgrid.llm import sampling, toxicity
from windgrid.llm.queries import QUERIES
from windgrid.llm.scratch import table


def rows(rng, n, places=12, scale=None):
    return toxicity.Rows([np.nonzero(rng.random(places) < 0.3)[0] for _ in range(n)], np.linspace(0.5, 2, places) if scale is None else scale, rng.integers(1, 4, n))


def plain_risk(x, p, u, prior, decay):
    """The risk of the docstring, text by text."""

    def mean(r, sign):
        total = n = 0.0
        for i in range(r.rows):
            g = x[-1] + sum(x[k] * r.scale[k] for k in r.word[r.at == i])
            total, n = total + r.times[i] * np.log1p(np.exp(-sign * g)), n + r.times[i]
        return total / n

    return prior * mean(p, 1) + max(0.0, mean(u, -1) - prior * mean(p, -1)) + decay * (x[:-1] ** 2).sum() / 2


@pytest.mark.parametrize("seed", range(4))
def test_risk_and_gradient(seed):
    rng = np.random.default_rng(seed)
    p, u, x = rows(rng, 9), rows(rng, 25), rng.normal(size=13)
    value, rest, g = toxicity.risk(x, p, *toxicity.of_sample(x, u), 0.2, 0.01)
    assert value == pytest.approx(plain_risk(x, p, u, 0.2, 0.01))
    if rest > 0:
        for k in range(13):
            e = np.eye(13)[k] * 1e-6
            assert g[k] == pytest.approx((plain_risk(x + e, p, u, 0.2, 0.01) - plain_risk(x - e, p, u, 0.2, 0.01)) / 2e-6, abs=1e-6)


def test_below_zero_the_step_leads_back_up():
    rng = np.random.default_rng(1)
    p, u = toxicity.Rows([np.arange(12)] * 9, np.ones(12)), rows(rng, 25)
    x, prior = np.append(np.ones(12), -2.0), 0.9  # toxic texts score so high that the difference falls below zero
    _, rest, g = toxicity.risk(x, p, *toxicity.of_sample(x, u), prior, 0.0)
    assert rest < 0
    _, after, _ = toxicity.risk(x - 1e-3 * g, p, *toxicity.of_sample(x - 1e-3 * g, u), prior, 0.0)
    assert after > rest


def test_passes_bring_the_fit_to_all_texts():
    """A start on a poor sample ends where a descent on all texts ends."""
    rng = np.random.default_rng(3)
    scale = np.ones(12)
    p, u = rows(rng, 60, scale=scale), rows(rng, 4000, scale=scale)
    part = toxicity.Rows([u.word[u.at == i] for i in range(300)], scale, u.times[:300])
    want, start = toxicity.descend(p, u, 0.2), toxicity.descend(p, part, 0.2)
    got = toxicity.fit_to_all(p, part, lambda x: toxicity.of_sample(x, u), 0.2)
    assert np.abs(got - want).max() < 0.3 * np.abs(start - want).max()


def test_sums_over_tasks(spark):
    rng = np.random.default_rng(5)
    u, x = rows(rng, 40), rng.normal(size=13)
    cells = [(bytearray(u.word[u.at == i].astype("<u4").tobytes()), int(u.times[i])) for i in range(u.rows)]
    table_ = spark.createDataFrame(cells, "places binary, n long").repartition(5)
    loss, g = toxicity._over_all(table_, x, u.scale, int(u.n))
    want_loss, want = toxicity.of_sample(x, u)
    assert loss == pytest.approx(want_loss, abs=1e-5) and np.abs(g - want).max() < 1e-5
    assert toxicity._over_all(table_.coalesce(1), x, u.scale, int(u.n))[0] == loss  # to the last bit


def test_cut():
    p, u = np.zeros(60 * toxicity.BINS, int), np.zeros(60 * toxicity.BINS, int)
    p[1100:1110], u[1100:1110], u[700:720] = 5, 5, 100
    at = toxicity.cut(p, u) * toxicity.BINS + 30 * toxicity.BINS
    assert 720 <= at <= 1102
    assert toxicity.cut(p, p) <= 1110 / toxicity.BINS  # nothing to part


def test_words_and_codes():
    assert toxicity.codes(None) == toxicity.codes("") == toxicity.codes("12 ...") == set()
    assert toxicity.codes("Ab aB \ud800x") == {zlib.crc32(b"ab"), zlib.crc32("\ud800x".encode("utf-8", "surrogatepass"))} or toxicity.codes("Ab aB") == {zlib.crc32(b"ab")}
    look = toxicity.Lookup({zlib.crc32(b"a"): 1.5}, 0.0, most=2)
    assert [look[w] for w in "abcdabcd"] == [1.5, 0, 0, 0] * 2 and len(look) <= 2


@pytest.mark.parametrize("count", [13, 12_001, 10**9, 4_000_000_001, 10**11, 10**12])
def test_samples_are_never_empty(spark, count):
    """The bound of the hash stays above zero whatever the count, and takes about its share of a real table."""
    share = 12_000 / count
    kept = spark.range(200_000).where(sampling.picked(F.col("id"), 12_000, count)).count()
    assert kept == 200_000 if count <= 12_000 else abs(kept - 200_000 * share) <= 6 * np.sqrt(200_000 * share) + 1
    bound = sampling.STEPS * 12_000 // count
    assert bound > 0 and bound / sampling.STEPS == pytest.approx(min(1.0, share) if count > 12_000 else share)


def test_held_out_texts_of_the_tables(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    found = QUERIES["op6_pu_toxicity"](spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").select("toxic", "predicted", "score").collect()
    hits = sum(r["toxic"] == r["predicted"] == 1 for r in found)
    false, missed = sum(r["predicted"] > r["toxic"] for r in found), sum(r["predicted"] < r["toxic"] for r in found)
    assert 2 * hits / (2 * hits + false + missed) > 0.85 and false <= 0.01 * len(found)
    clean, toxic = ([r["score"] for r in found if r["toxic"] == k] for k in (0, 1))
    assert np.mean([np.mean(np.array(clean) < s) for s in toxic]) > 0.95


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, "x", 3), (2, "", "y", 4), (2, "", "y", 4), (None, "a b", "z", 5), (3, "word " * 30_000, "w", 6)], "doc_id long, text string, label string, n int")
    labels = spark.createDataFrame([(1, 1), (2, None), (2, 0), (2, 1), (None, 1)], "doc_id long, toxic int")
    for labels_ in (labels, labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1")):
        model = toxicity.train(docs, labels_, F.lit(True))
        got = toxicity.score(docs.withColumn("score", F.lit("own")), model)
        assert got.count() == 5 and set(got.columns) == {"doc_id", "text", "label", "n", "score", "predicted"} and got.where("score is null or isnan(score)").count() == 0
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), labels, F.lit(True))).count() == 0
