"""Near-duplicates at the pipeline's limit of 0.80, against brute force."""

import random

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from windgrid.llm import near_dedup

from .test_operators import brute_components, versions


def test_bounds():
    assert (near_dedup.keys_for(85), near_dedup.run_sketch_for(85)) == (12, 48)
    assert (near_dedup.keys_for(80), near_dedup.run_sketch_for(80)) == (15, 61)
    assert all(near_dedup._run_widths(n, 85) == [min(3, n)] for n in range(1, 49))
    assert [n for n in range(1, 62) if len(near_dedup._run_widths(n, 80)) > 1] == [4, 5]


@pytest.mark.parametrize("gone", range(5))
def test_small_sets_share_a_run(gone):
    five = np.arange(10, 15, dtype="<u4")
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([five.tobytes(), np.delete(five, gone).tobytes()])], names=["rep", "sketch"])
    out = pa.Table.from_batches(near_dedup._runs(80)([batch])).to_pylist()
    assert {r["key"] for r in out if r["rep"] == 1} & {r["key"] for r in out if r["rep"] == 2}


def test_at_80(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHORT", 4)  # so that runs and crowds are needed
    rows = versions(5, 90, 11)
    rng = random.Random(2)
    for k in range(40):  # sets of 4 and of 5 values
        words = [rng.choice("abcdef") for _ in range(9)]
        rows += [(1000 + 2 * k, " ".join(words)), (1001 + 2 * k, " ".join(words[: 8]))]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()
    want = brute_components(rows, 80)
    assert want != brute_components(rows, 85)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_stage_drops_copies_from_80(spark):
    words = [f"w{k}" for k in range(100)]
    less = [*words[:50], "x", *words[51:70], "y", *words[71:]]  # 86 shared of 106: 0.81
    rows = [(1, " ".join(words)), (2, " ".join(less)), (3, "z " * 30), (4, " ".join(f"v{k}" for k in range(40)))]
    kept = corpus_pipeline.without_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r["doc_id"] for r in kept.collect()} == {1, 3, 4}
