"""The global index of the Hamming search: many parts, odd rows, clashing names, and how much it shuffles."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from windgrid.llm import hamming
from windgrid.llm.scratch import Scratch


def brute(rows, queries, k):
    out = []
    for q, c in queries:
        best = sorted((((c ^ e) & (2**64 - 1)).bit_count(), i) for i, e in rows)[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(best)]
    return sorted(out)


def answers(df):
    assert df.columns == ["query_id", "rank", "id", "distance"]
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def codes():
    rng = np.random.default_rng(11)
    base = rng.integers(-(2**62), 2**62, 600)
    base[100:300] = base[0] ^ (1 << rng.integers(0, 62, 200)) ^ (1 << rng.integers(0, 62, 200))  # a crowd that shares segments
    base[300:360] = base[1]  # copies
    return [(i, int(c)) for i, c in enumerate(base)]


@pytest.mark.parametrize(("k", "cell"), [(1, 4096), (5, 7), (40, 64)])
def test_parts_of_long_lists(spark, codes, k, cell):
    rows = spark.createDataFrame(codes, "id long, code long")
    asked = [(i, c) for i, c in codes if i % 40 == 0]
    found = hamming.top_k(rows, spark.createDataFrame(asked, "query_id long, code long"), k, cell)
    assert answers(found) == brute(codes, asked, k)


def test_clashing_columns_repeats_and_nulls(spark):
    rows = [(1, 5), (1, 5), (2, 7), (3, None), (None, 5), (4, -1)]
    r = spark.createDataFrame(rows, "id long, code long").withColumns({c: F.lit(9) for c in ("rank", "distance", "q", "ids", "segment", "bound", "query_id")})
    q = spark.createDataFrame([(8, 5), (8, 5), (9, -1), (10, None), (None, 5)], "query_id long, code long").withColumns({c: F.lit(9) for c in ("id", "rank", "distance", "q", "ids", "value", "part")})
    known = [(1, 5), (1, 5), (2, 7), (4, -1)]
    assert answers(hamming.top_k(r, q, 3)) == brute(known, [(8, 5), (8, 5), (9, -1)], 3)
    assert answers(hamming.top_k(r, q, 10)) == brute(known, [(8, 5), (8, 5), (9, -1)], 10)  # fewer than k
    assert answers(hamming.top_k(r.limit(0), q, 3)) == answers(hamming.top_k(r, q.limit(0), 3)) == []


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 10**6, 10**9, 10**12])
def test_segments_cover_all_bits(n):
    cuts = hamming.segments(n)
    assert [a for a, _ in cuts] == np.cumsum([0, *(w for _, w in cuts)])[:-1].tolist() and sum(w for _, w in cuts) == 64
    assert max(w for _, w in cuts) <= 32
    assert sorted(sum((hamming.masks(6, r) for r in range(7)), [])) == list(range(64))


def test_each_pair_is_met_once_and_postings_are_linear(spark, codes, tmp_path):
    """All radii together meet every pair once; what a query posts does not depend on how many rows there are."""
    scratch = Scratch(spark, "test-hamming")
    few, queries = codes[:60], spark.createDataFrame([(codes[0][1], 64), (codes[5][1], 64)], "q long, bound int")
    entries = spark.createDataFrame([(c, [i]) for c, i in {c: i for i, c in few}.items()], "code long, ids array<long>")
    index = hamming.Index(entries, scratch)
    met = [r for radius in range(max(w for _, w in index.cuts) + 1) for r in index.found(queries, radius).collect()]
    assert len(met) == 2 * entries.count() == len({(r["q"], tuple(r["ids"])) for r in met})
    blocks = hamming.Index(entries, scratch, cell=4)
    for radius in range(3):
        want = 2 * sum(len(hamming.masks(w, radius)) for _, w in index.cuts)
        assert index.posted(queries, radius).count() == want <= blocks.posted(queries, radius).count() <= want + 2 * entries.count()
