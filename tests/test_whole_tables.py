"""Queries without SQL read whole tables: no key that the method can use is left out."""

import os

import pytest
from pyspark.sql import functions as F

from windgrid.plans.base import obs, read
from windgrid.plans.queries import QUERIES


@pytest.mark.parametrize("name", ["seq_07_monotone_points", "seq_08_viterbi_segments", "seq_09_order_hypotheses", "seq_10_partial_alignment", "seq_11_drop_alignment", "seq_12_stability"])
def test_every_batch_is_aligned(spark, sf, name):
    want = {r[0] for r in read(spark, sf, "lineitem").groupBy("l_orderkey").count().where("count >= 3").collect()}
    got = [r["l_orderkey"] for r in QUERIES[name](spark, sf).select("l_orderkey").collect()]
    assert set(got) == want and len(got) == len(want) and any(k % 20 for k in want)


def test_every_track_is_corrupted(spark, sf):
    from windgrid.operators.sequences import CORRUPTIONS

    sf = os.path.join(os.path.dirname(sf), "sf0.01")  # sf0.001 has 15 identities
    want = {r[0] for r in obs(spark, sf).select("ident").distinct().collect()}
    got = QUERIES["seq_13_corruptions"](spark, sf).groupBy("ident").agg(F.count_distinct("kind").alias("kinds")).collect()
    assert {r["ident"] for r in got} == want and {r["kinds"] for r in got} == {len(CORRUPTIONS)} and max(want) > 30
