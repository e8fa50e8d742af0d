"""Near-duplicates where ids repeat, and crowds of versions that no pivot settles, against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import brute_components, versions
from windgrid.llm import near_dedup

A, B = (" ".join(f"{c}{k}" for k in range(40)) for c in "ab")


def groups(spark, rows, **options):
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    return sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got)


def test_rows_of_one_id_are_one_document(spark):
    rows = [(5, A), (5, B), (6, A + " x"), (7, B + " y")]
    want = [(5, 72, 5, True), (5, 72, 5, True), (6, 37, 6, True), (7, 37, 7, True)]  # the common set of id 5 is like neither
    for order in (rows, rows[::-1], [rows[1], rows[3], rows[0], rows[2]]):
        assert groups(spark, order) == want
    more = rows + [(8, A + " " + B), (5, None), (9, A), (6, A + " x")]
    want = groups(spark, more)
    assert want == groups(spark, more[::-1])
    found = {i: (n, c) for i, n, c, _ in want}
    assert found[8] == (76, 5) and found[5] == (72, 5) and found[9] == (36, 6) and found[6] == (37, 6)


def test_one_row_of_an_id_stays(spark):
    rows = [(1, "some words of a text that stays", "x", 1), (1, "some words of a text that stays", "a", 2), (1, "other words", "y", 3), (None, "free", "z", 4), (None, "free", "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, print int")
    for d in (docs, docs.orderBy("print", ascending=False)):
        got = near_dedup.representatives(d)
        assert got.columns == docs.columns
        assert sorted(got.collect(), key=str) == sorted([docs.where("print = 3").first(), *docs.where("doc_id is null").collect()], key=str)


@pytest.mark.parametrize(("seed", "changes"), [(3, 6), (4, 14)])
def test_crowds_without_pivots(spark, monkeypatch, seed, changes):
    """All is left to the crowd's differences, in many blocks."""
    monkeypatch.setattr(near_dedup, "PIVOT_ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "SHORT", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    rows = versions(seed, 120, changes)
    want = brute_components(rows)
    assert {i: (n, c) for i, n, c, _ in groups(spark, rows)} == want and len({c for _, c in want.values()}) > 5


def test_meetings_find_every_pair_once():
    """The streamed comparison against all pairs, whichever component is the largest."""
    rng = random.Random(7)
    for _ in range(20):
        base = np.array(sorted(rng.sample(range(1, 10**9), 60)), dtype=np.uint64)
        members = []
        for rep in range(1, 25):
            own = np.unique(np.concatenate([np.delete(base, rng.sample(range(60), rng.randrange(1, 6))), np.array(rng.sample(range(2 * 10**9, 2 * 10**9 + 9), 2), dtype=np.uint64)]))
            members.append((rep, own, rng.choice([1, 2, 3, rep])))
        near_dedup_rows = []
        apart = {rep: np.setxor1d(own, base) for rep, own, _ in members}
        cells = {}
        common = np.zeros(near_dedup.COUNTERS, dtype=np.uint32)
        batch = pa.RecordBatch.from_arrays([pa.array([0] * len(members)), pa.array([m[0] for m in members]), pa.array([len(m[1]) for m in members]), pa.array([apart[m[0]].tobytes() for m in members], pa.binary()), pa.array([near_dedup.parity(m[1]) for m in members], pa.binary())], names=["pivot", "rep", "n", "apart", "parity"])
        for r in pa.Table.from_batches(near_dedup._prefixes(85, common)([batch])).to_pylist():
            cells.setdefault(r["value"], []).append(r)
        comp = {rep: c for rep, _, c in members}
        for value, cell in cells.items():
            main = max((sum(comp[x["rep"]] == c for x in cell), c) for c in {comp[x["rep"]] for x in cell})[1]
            for asks in (0, 1):
                near_dedup_rows += [(0, value, 0, asks, x["rep"], x["n"], x["d"], x["place"], comp[x["rep"]], main, x["parity"]) for x in cell if not asks or comp[x["rep"]] != main]
        near_dedup_rows.sort(key=lambda r: r[:4])
        names = ["pivot", "value", "block", "asks", "rep", "n", "d", "place", "comp", "main", "parity"]
        found = [tuple(r.values()) for r in pa.Table.from_batches(near_dedup._meetings(85)([pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in near_dedup_rows])]), near_dedup.PAIR).to_pylist()]
        for i, x, c in members:
            for j, y, e in members:
                both = len(np.intersect1d(x, y))
                if i < j and c != e and 100 * both >= 85 * (len(x) + len(y) - both):
                    assert (i, j) in found
        assert all(comp[a] != comp[b] for a, b in found)
