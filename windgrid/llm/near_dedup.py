"""Near-duplicate groups from bottom-k sketches of one hash function.

A document's set is its distinct shingles of `width` words, each hashed once to 64 bits. Its sketch
is the `SKETCH` smallest values. Of two sets with Jaccard similarity J, each of the smallest values of
their union lies in both with probability J. From that follow the three steps:

1. The smallest values (`keys_for`: 12 at 0.85, 15 at 0.80) are posted to inverted lists. Similar sets share
   none of k with probability (1 - J) ** k, 1.3e-10 at 0.85 and 12 (sets of up to k values are posted whole).
2. The smallest values of the union of two sketches estimate J; a pair is dropped when the estimate is
   so low that a similar pair shows it with probability below `ODDS`.
   Before that, a parity sketch (each value flips one of PARITY bits) bounds how much the sets differ:
   the bits in which two such sketches differ are never more than the values in which the sets do. It
   drops only pairs that cannot be similar.
3. The pairs left are confirmed on the full sets.

Texts with equal sets are one representative from the start. A list is never expanded to all its
pairs. In a few rounds every list links its members to one pivot, the member whose values are the most
common, and confirmed links merge. What still holds several components is settled by its size:

- Lists of up to `SHORT` members are compared pair by pair, across components.
- Members of longer lists are posted again under runs of (mostly) `RUN` values that follow one another in a
  sketch, which documents that merely share a passage seldom have in common; short lists are compared.
- The long lists of runs are crowds of versions of one text. Each member is held against a common pivot, and
  those that are similar to it merge. Then a member x is posted by its difference D to the pivot (what one of
  the two has and the other lacks), since x and y differ by as much as their D do. Sets that are similar differ
  by at most T = (n_x + n_y) * (1 - J) / (1 + J). So their D share at least (|D_x| + |D_y| - T) / 2 values, one
  of them among the first T + 1 of both with enough left behind it (prefix and position filter); if that bound
  is below one, both are near the pivot and meet under a key of their own. That holds for any order of the
  values; rare ones come first, by counts in a sketch of fixed size, so that few members meet under a value.
  Where many do, only those outside the largest component among them go to several tasks.

Defined cases: a null or empty text, or one of white space only, has an empty set and is linked with
nothing; a null doc_id is no document of a group (component_id null, kept false); rows of equal doc_id are
one document, whose set is all that its texts have, and are all returned, with the same values; an empty
table gives no rows; other columns are not read. The order of the rows changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windgrid.llm.components import components
from windgrid.llm.scratch import Scratch, table

WIDTH = 5
#: 100 * |intersection| >= PERCENT * |union|
PERCENT = 85
SKETCH = 128
#: Chances that similar sets share none of their keys, and no run.
KEY_ODDS, RUN_ODDS = 1.3e-10, 4e-10
#: Bits of the parity sketch.
PARITY = 512
#: Chance that the estimate drops a pair that is similar.
ODDS = 1e-7
#: Adjacent values that make a key of a long list (see run_sketch_for and _run_widths).
RUN = 3
#: Members of a list up to which all its pairs are looked at, and of a block of a longer one.
SHORT, BLOCK = 64, 512
PIVOT_ROUNDS = 2
#: Ids of paired documents are sent to every executor up to this many (8 bytes each), and joined by a shuffle beyond.
BROADCAST_ROWS = 500_000

MIX = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts as UTF-8 to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, width: int = WIDTH, most: int = 500_000):
        import xxhash

        self.width, self.most, self.hash, self.kept = width, most, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # bytes: A-Z only, and ASCII white space only
        if not words:
            return np.empty(0, dtype=np.uint64)
        kept = self.kept
        if len(kept) > self.most:
            kept.clear()
        try:
            codes = np.fromiter(map(kept.__getitem__, words), dtype=np.uint64, count=len(words))
        except KeyError:
            for w in words:
                if w not in kept:
                    kept[w] = self.hash(w)
            codes = np.fromiter(map(kept.__getitem__, words), dtype=np.uint64, count=len(words))
        n = len(codes)
        out = np.full(max(1, n - self.width + 1), np.uint64(min(n, self.width)), dtype=np.uint64)
        for k in range(min(n, self.width)):
            out = _mix(out * MIX + codes[k : k + len(out)])
        return np.unique(out)

    def batch(self, batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        """The sets of rows of text and, for documents of several texts, more (the others)."""
        more = batch.column("more").to_pylist() if "more" in batch.schema.names else [None] * batch.num_rows
        for t, others in zip(batch.column("text").cast(pa.binary()), more, strict=True):
            s = self(t.as_py())
            yield np.unique(np.concatenate([s, *(self(x.encode("utf-8", "surrogatepass")) for x in others)])) if others else s


SETS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("print", pa.binary()), ("keys", pa.binary()), ("sketch", pa.binary()), ("parity", pa.binary())])
SETS_SQL = "doc_id long, n long, print binary, keys binary, sketch binary, parity binary"


def parity(s: np.ndarray) -> bytes:
    """Bit i is set if an odd number of values falls on it."""
    return np.packbits(np.bincount((s % np.uint64(PARITY)).astype(np.int64), minlength=PARITY) & 1).tobytes()


def _parities(cells: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype=np.uint64).reshape(len(cells), PARITY // 64)


def most_apart(total, percent: int):
    """The values in which two similar sets of `total` values together may differ at most."""
    return total * (100 - percent) // (100 + percent)


def keys_for(percent: int) -> int:
    """The values that a set posts, so that similar sets share none with probability KEY_ODDS at most."""
    k = 1
    while k < SKETCH and (1 - percent / 100) ** k > KEY_ODDS:
        k += 1
    return k


def run_sketch_for(percent: int) -> int:
    """The smallest values from which runs are taken, so that similar sets have none in common with probability
    RUN_ODDS at most, as far as a sketch goes (48 at 0.85, 61 at 0.80)."""
    p, m, state = percent / 100, 0, [1.0] + [0.0] * (RUN - 1)  # chances by the length of the run at the end
    while m < SKETCH and sum(state) > RUN_ODDS:
        m, state = m + 1, [sum(state) * (1 - p)] + [x * p for x in state[:-1]]
    return m


def _run_widths(n: int, percent: int) -> list[int]:
    """Lengths of the runs that a set of n values posts: RUN, and less where s shared values, parted by d others,
    are sure of a shorter one only; so similar sets that are posted whole always meet."""
    widths = {min(RUN, n)}
    for s in range(1, n + 1):
        for d in range(max(1, n - s), s * (100 - percent) // percent + 1):
            widths.add(min(RUN, -(-s // (d + 1))))
    return sorted(widths)


def _sets(width: int, percent: int):
    """Texts -> size, fingerprint and smallest values of their sets; sketches hold the upper halves of values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        shingle, keys = Shingler(width), keys_for(percent)
        for batch in batches:
            rows = []
            for doc, s in zip(batch.column("doc_id").to_pylist(), shingle.batch(batch), strict=True):
                rows.append((doc, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None, s[:keys].tobytes(), (s[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes(), parity(s)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), SETS.types, strict=True)], schema=SETS)

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, n, keys -> rep, n, key for each of the smallest values."""
    for batch in batches:
        flat = [np.frombuffer(x.as_py(), dtype=np.int64) for x in batch.column("keys")]
        at = pa.array(np.repeat(np.arange(len(flat)), [len(x) for x in flat]))
        yield pa.RecordBatch.from_arrays([batch.column("rep").take(at), batch.column("n").take(at), pa.array(np.concatenate([np.empty(0, np.int64), *flat]))], names=["rep", "n", "key"])


def estimate(a: np.ndarray, b: np.ndarray, k: int = SKETCH) -> tuple[int, int]:
    """How many of the (up to k) smallest values of the union lie in both sketches, and of how many."""
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    first = np.append(True, ~twice) if len(both) else np.empty(0, dtype=bool)
    m = min(k, int(first.sum()))
    if not m:
        return 0, 0
    last = both[np.nonzero(first)[0][m - 1]]
    return int((twice & (both[1:] <= last)).sum()), m


def _least_shared(percent: int, odds: float = ODDS) -> list[int]:
    """For m union values, the count below which a pair at the limit falls with probability under `odds`."""
    from math import comb

    p, out = percent / 100, [0]
    for m in range(1, SKETCH + 1):
        total, c = 0.0, 0
        while c <= m and (total := total + comb(m, c) * p**c * (1 - p) ** (m - c)) < odds:
            c += 1
        out.append(c)
    return out


def _passing(percent: int):
    """Pairs with sizes, parities and sketches -> the pairs that can be similar by all three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = _least_shared(percent)
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = np.bitwise_count(_parities(batch.column("pa").to_pylist()) ^ _parities(batch.column("pb").to_pylist())).sum(axis=1)
            keep = apart <= most_apart(batch.column("na").to_numpy() + batch.column("nb").to_numpy(), percent)
            for k in np.nonzero(keep)[0].tolist():
                both, m = estimate(np.frombuffer(batch.column("ka")[k].as_py(), dtype="<u4"), np.frombuffer(batch.column("kb")[k].as_py(), dtype="<u4"))
                keep[k] = both >= least[m]
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _full(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id, s: the full sets of the documents in ids (one column), built again from their texts, of which each has one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(width)
        for batch in batches:
            sets = [s.tobytes() for s in shingle.batch(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "s"])

    ids = ids.distinct()
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, s binary")


def _confirmed(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs that hold on the full sets."""

    def holds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                a, b = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sets = _full(docs, pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), width)
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a")
    return left.join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b").select("a", "b", "sa", "sb").mapInArrow(holds, "a long, b long")


def _runs(percent: int):
    """rep, sketch -> rep, key for each run of adjacent values (the whole set, if it is smaller)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = run_sketch_for(percent)
        widths = [_run_widths(n, percent) for n in range(most + 1)]
        for batch in batches:
            keys, at = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for i, x in enumerate(batch.column("sketch")):
                s = np.frombuffer(x.as_py(), dtype="<u4")[:most].astype(np.uint64)
                for width in widths[len(s)]:
                    out = np.full(len(s) - width + 1, np.uint64(width), dtype=np.uint64)
                    for k in range(width):
                        out = _mix(out * MIX + s[k : k + len(out)])
                    keys.append(out.view(np.int64))
                    at.append(np.full(len(out), i))
            where = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([batch.column("rep").take(where), pa.array(np.concatenate(keys))], names=["rep", "key"])

    return run


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Rows that agree in their first `keys` columns, from rows sorted by them."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:keys] != held[0][:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _pairs(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for a, b in found:
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=PAIR)


def _short(percent: int):
    """Members of short lists (key, rep, n, comp, sketch, parity) -> pairs of different components that the estimate passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.array(_least_shared(percent))
        yield from _pairs(_compare(g, least, percent) for g in _groups(batches, 1) if len({x[3] for x in g}) > 1)

    return run


def _compare(group: list[tuple], least: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    group = sorted(group, key=lambda x: (x[2], x[1]))
    rep, n, comp = (np.array([x[c] for x in group], dtype=np.int64) for c in (1, 2, 3))
    sketches = [np.frombuffer(x[4], dtype="<u4") for x in group]
    odd = _parities([x[5] for x in group])
    codes = np.zeros((len(group), SKETCH), dtype=np.int64)  # 0: no value
    names = np.unique(np.concatenate(sketches), return_inverse=True)[1] + 1
    at = 0
    for k, x in enumerate(sketches):
        codes[k, : len(x)] = names[at : at + len(x)]
        at += len(x)
    flags = np.zeros(int(names.max()) + 1, dtype=np.int64)
    a, b = [], []
    for k in range(1, len(group)):
        low = int(np.searchsorted(n[:k], -(-percent * n[k] // 100)))
        flags[codes[k]] = 1
        flags[0] = 0
        likely = (flags[codes[low:k]].sum(axis=1) >= least[len(sketches[k])]) & (comp[low:k] != comp[k])
        flags[codes[k]] = 0
        m = np.nonzero(likely)[0] + low
        for m in m[np.bitwise_count(odd[m] ^ odd[k]).sum(axis=1) <= most_apart(n[m] + n[k], percent)]:
            both, of = estimate(sketches[m], sketches[k])
            if both >= least[of]:
                a.append(rep[m])
                b.append(rep[k])
    return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)


#: The key under which a pivot's nearest versions meet.
NEAR = -1
#: Counters of the sketch that orders values by how common they are in the crowds (4 bytes each, sent to every task).
COUNTERS = 1 << 18

DIFFERENCE = "pivot long, rep long, n long, similar boolean, apart binary, parity binary"


def _differences(percent: int):
    """a, b (pivot), both full sets -> a's difference to b, and whether the two are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(batch.column(c) for c in ("a", "b", "sa", "sb")), strict=True):
                s, p = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                apart = np.setxor1d(s, p, assume_unique=True)
                both = (len(s) + len(p) - len(apart)) // 2
                rows.append((b.as_py(), a.as_py(), len(s), 100 * both >= percent * (len(s) + len(p) - both), apart.tobytes(), parity(s)))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in DIFFERENCE.split(", ")])

    return run


def _counter(pivot: int, values: np.ndarray) -> np.ndarray:
    """Places in the sketch for values of one pivot's differences."""
    return (_mix(values ^ np.uint64(pivot & (1 << 64) - 1)) % np.uint64(COUNTERS)).astype(np.int64)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """pivot, apart -> place, n: how many values fall on each counter."""
    total = np.zeros(COUNTERS, dtype=np.int64)
    for batch in batches:
        for pivot, x in zip(batch.column("pivot").to_pylist(), batch.column("apart"), strict=True):
            np.add.at(total, _counter(pivot, np.frombuffer(x.as_py(), dtype=np.uint64)), 1)
    there = np.nonzero(total)[0]
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there])], names=["place", "n"])


def _prefixes(percent: int, common: np.ndarray):
    """Differences -> pivot, value, rep, n, d, place for the first values of each, rare ones first."""
    schema = pa.schema([*((c, pa.int64()) for c in ("pivot", "value", "rep", "n", "d", "place")), ("parity", pa.binary())])

    def out(parts: list[list]) -> pa.RecordBatch:
        *numbers, cells = zip(*parts, strict=True)
        return pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c).astype(np.int64)) for c in numbers), pa.array([x for c in cells for x in c], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, size = [], 0
            for pivot, rep, n, x, odd in zip(*(batch.column(c).to_pylist() for c in ("pivot", "rep", "n", "apart", "parity")), strict=True):
                values = np.frombuffer(x, dtype=np.uint64)
                d, most = len(values), most_apart(n + 100 * n // percent, percent)  # T for the largest partner
                first = values[np.lexsort((values, common[_counter(pivot, values)]))][: most + 1].view(np.int64)
                near = d <= most
                values = np.append(first, np.full(int(near), NEAR, dtype=np.int64))
                places = np.append(np.arange(len(first)), np.zeros(int(near), dtype=np.int64))
                parts.append([np.full(len(values), pivot), values, np.full(len(values), rep), np.full(len(values), n), np.full(len(values), d), places, [odd] * len(values)])
                size += len(values)
                if size >= 10_000:
                    yield out(parts)
                    parts, size = [], 0
            if parts:
                yield out(parts)

    return run


def _meetings(percent: int):
    """Sorted rows (pivot, value, block, asks, rep, n, d, place, comp, main, parity) -> pairs that can still be similar.

    The rows of a block that do not ask are held, about BLOCK of them; those that ask pass by, one at a time.
    """

    class Held:
        def __init__(self, rows: list[tuple]):
            self.rep, self.n, self.d, place, self.comp, main = (np.array([x[c] for x in rows], dtype=np.int64) for c in range(4, 10))
            self.left, self.minor, self.odd = self.d - place, self.comp != main, _parities([x[10] for x in rows])

        def meets(self, row: tuple) -> np.ndarray:
            _, value, _, _, rep, n, d, place, comp, _, odd = row
            most = most_apart(n + self.n, percent)
            shared = -(-(d + self.d - most) // 2)  # values that both differences must have
            fits = shared <= 0 if value == NEAR else (shared > 0) & (np.minimum(d - place, self.left) >= shared)
            m = np.nonzero(fits & (self.comp != comp) & (~self.minor | (self.rep > rep)))[0]  # two that both ask meet once
            return self.rep[m[np.bitwise_count(self.odd[m] ^ _parities([odd])).sum(axis=1) <= most[m]]]

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        cell, rows, held = None, [], None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != cell:
                    cell, rows, held = row[:3], [], None
                if not row[3]:
                    rows.append(row)
                elif rows:
                    held = held or Held(rows)
                    other = held.meets(row)
                    yield np.full(len(other), row[4]), other

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few: list[tuple[np.ndarray, np.ndarray]] = []
        for pair in found(batches):
            if len(pair[0]):
                few.append(pair)
            if sum(len(x) for x, _ in few[-1:]) > 4096 or len(few) >= 1024:
                yield from _pairs([tuple(map(np.concatenate, zip(*few, strict=True)))])
                few = []
        if few:
            yield from _pairs([tuple(map(np.concatenate, zip(*few, strict=True)))])

    return run


class _Search:
    """One run over the representatives: their lists and the components that the links found so far make."""

    def __init__(self, scratch: Scratch, texts: DataFrame, reps: DataFrame, width: int, percent: int):
        self.scratch, self.texts, self.reps, self.width, self.percent = scratch, texts, reps, width, percent
        self.tables = 0
        self.labels: DataFrame | None = None  # node, comp of what is linked; a component has the name of one of its nodes

    def with_comp(self, df: DataFrame, of: str = "rep", name: str = "comp") -> DataFrame:
        if self.labels is None:
            return df.withColumn(name, F.col(of))
        return df.join(self.labels.select(F.col("node").alias(of), F.col("comp").alias("__comp")), of, "left").withColumn(name, F.coalesce("__comp", of)).drop("__comp")

    def merge(self, pairs: DataFrame, step: str) -> None:
        """Confirms pairs (a, b) that the estimate passes, and merges what they link."""
        side = lambda c: self.reps.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"k{c}"), F.col("parity").alias(f"p{c}"))
        likely = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_passing(self.percent), "a long, b long")
        likely = self.scratch.save(likely, f"likely_{step}")
        if not likely.isEmpty():
            self.link(self.scratch.save(_confirmed(self.texts, likely, self.width, self.percent), f"links_{step}"), step)
        self.scratch.drop(f"likely_{step}", f"links_{step}")

    def link(self, links: DataFrame, step: str) -> None:
        """Merges the components of linked pairs (a, b): only what was apart is looked at."""
        edges = self.with_comp(self.with_comp(links, "a", "x"), "b", "y").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        joined = components(edges, self.scratch, step)
        if joined.isEmpty():
            return
        if self.labels is None:
            self.labels = joined
            return
        renamed = self.labels.join(joined.select(F.col("node").alias("comp"), F.col("comp").alias("__new")), "comp", "left").select("node", F.coalesce("__new", "comp").alias("comp"))
        self.labels = self.scratch.save(renamed.unionByName(joined.join(self.labels.select("node"), "node", "left_anti")), f"labels_{step}")

    def pivot_round(self, lists: DataFrame, round_: int) -> None:
        """Links every list to its most common member, and later to the most common one of another component."""
        state = self.scratch.save(self.with_comp(lists).select("key", "rep", "n", "fame", "comp"), f"state_{round_}")
        best = F.max(F.struct("fame", "rep", "n", "comp")).alias("p")
        if round_:
            first = self.scratch.save(state.groupBy("key").agg(best).select("key", F.col("p.comp").alias("done")), f"first_{round_}")
            # written before they are aggregated by key again: the rows of a very common key are read by many tasks
            state = self.scratch.save(state.join(first, "key").where("comp <> done").drop("done"), f"others_{round_}")
            if state.isEmpty():
                return
        pivots = self.scratch.save(state.groupBy("key").agg(best), f"pivots_{round_}")
        fits = (F.col("n") * 100 >= F.col("p.n") * self.percent) & (F.col("p.n") * 100 >= F.col("n") * self.percent)
        pairs = state.join(pivots, "key").where((F.col("comp") != F.col("p.comp")) & fits)
        self.merge(pairs.select(F.least("rep", "p.rep").alias("a"), F.greatest("rep", "p.rep").alias("b")).distinct(), f"pivot_{round_}")
        self.scratch.drop(f"state_{round_}", f"others_{round_}")

    def mixed(self, lists: DataFrame) -> DataFrame:
        """lists (key, rep, ...) of more than one component, with comp and the size m."""
        named = self.with_comp(lists.drop("m"))
        size = named.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key", "m")
        self.tables += 1
        return named.join(self.scratch.save(size, f"mixed_{self.tables}"), "key")

    def rest(self, lists: DataFrame) -> None:
        """All pairs that are still open: short lists, short lists of runs, crowds."""
        open_ = self.scratch.save(self.mixed(lists.select("key", "rep")), "open")
        if open_.isEmpty():
            return
        short, long_ = open_.where(F.col("m") <= SHORT).select("key", "rep", "comp"), open_.where(F.col("m") > SHORT)
        crowd = None
        if not long_.isEmpty():
            long_ = long_.select("rep").distinct().join(self.reps.select("rep", "sketch"), "rep")
            runs = self.mixed(self.scratch.save(long_.mapInArrow(_runs(self.percent), "rep long, key long").distinct(), "runs"))
            runs = self.scratch.save(runs.select("key", "rep", "comp", "m"), "open_runs")
            short = short.unionByName(runs.where(F.col("m") <= SHORT).select("key", "rep", "comp"))
            crowd = runs.where(F.col("m") > SHORT).select("key", "rep", "m")
        short = short.join(self.reps.select("rep", "n", "sketch", "parity"), "rep").select("key", "rep", "n", "comp", "sketch", "parity")
        near = short.repartition("key").sortWithinPartitions("key").mapInArrow(_short(self.percent), "a long, b long")
        self.merge(self.scratch.save(near.distinct(), "near"), "near")
        if crowd is not None and not crowd.isEmpty():
            self.crowds(crowd)
        self.scratch.drop("open", "runs", "open_runs", "near")

    def crowds(self, crowd: DataFrame) -> None:
        """All pairs that are still open among the members (key, rep, m) of long lists of runs."""
        # one pivot for a crowd: the most common member (by its crowds) that any member has in any of its crowds
        crowd = self.scratch.save(crowd.join(crowd.groupBy("rep").agg(F.sum("m").alias("fame")), "rep").select("key", "rep", "fame"), "crowd")
        best = self.scratch.save(crowd.groupBy("key").agg(F.max(F.struct("fame", "rep")).alias("p")), "crowd_best")
        own = crowd.join(best, "key").groupBy("rep").agg(F.max("p").alias("p"))
        chosen = self.scratch.save(crowd.select("key", "rep").join(own, "rep").groupBy("key").agg(F.max("p").alias("p")), "crowd_pivots")
        asked = self.scratch.save(crowd.join(chosen, "key").select(F.col("rep").alias("a"), F.col("p.rep").alias("b")).distinct(), "asked")
        sets = _full(self.texts, asked.select(F.col("a").alias("doc_id")).union(asked.select("b")), self.width)
        sets = self.scratch.save(sets, "crowd_sets")
        sets_a, sets_b = (sets.select(F.col("doc_id").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
        apart = asked.join(sets_a, "a").join(sets_b, "b").select("a", "b", "sa", "sb").mapInArrow(_differences(self.percent), DIFFERENCE)
        apart = self.scratch.save(apart, "apart")
        self.link(apart.where("similar and rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")), "crowd")
        # crowds that are one component by now are done
        open_ = self.with_comp(apart.select("pivot", "rep")).groupBy("pivot").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("pivot")
        open_ = self.scratch.save(open_, "open_crowds")
        if open_.isEmpty():
            return
        apart = apart.join(open_, "pivot", "left_semi")
        common = np.zeros(COUNTERS, dtype=np.uint32)
        counted = apart.select("pivot", "apart").mapInArrow(_common, "place int, n long").groupBy("place").agg(F.least(F.sum("n"), F.lit(2**31)).alias("n")).toArrow()
        common[counted["place"].to_numpy()] = counted["n"].to_numpy()
        first = apart.select("pivot", "rep", "n", "apart", "parity").mapInArrow(_prefixes(self.percent, common), "pivot long, value long, rep long, n long, d long, place long, parity binary")
        first = self.scratch.save(self.with_comp(first), "first")
        by_comp = first.groupBy("pivot", "value", "comp").agg(F.count("*").alias("k"))
        cells = by_comp.groupBy("pivot", "value").agg(F.sum("k").alias("m"), F.count("*").alias("comps"), F.max(F.struct("k", "comp")).alias("main")).where("comps > 1")
        cells = self.scratch.save(cells.select("pivot", "value", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"), F.col("main.comp").alias("main")), "cells")
        rows = first.join(cells, ["pivot", "value"])
        base = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")).withColumn("asks", F.lit(0))
        asking = rows.where("comp <> main").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("asks", F.lit(1))
        met = base.unionByName(asking).select("pivot", "value", "block", "asks", "rep", "n", "d", "place", "comp", "main", "parity")
        far = met.repartition("pivot", "value", "block").sortWithinPartitions("pivot", "value", "block", "asks").mapInArrow(_meetings(self.percent), "a long, b long")
        self.merge(far.distinct(), "far")
        self.scratch.drop("crowd", "asked", "crowd_sets", "apart", "first")


def _one_set_each(docs: DataFrame, sets: DataFrame, scratch: Scratch, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Texts, one row per doc_id, and sets of all rows, where rows of one doc_id have the common set of their texts."""
    several = sets.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    several = scratch.save(several, "several")
    texts = docs.where("doc_id is not null").withColumn("more", F.lit(None).cast("array<string>"))
    if several.isEmpty():
        return texts, sets
    joint = docs.join(several, "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_set("text")).alias("more"))
    joint = scratch.save(joint.select("doc_id", F.lit(None).cast("string").alias("text"), "more"), "joint")
    common = scratch.save(joint.mapInArrow(_sets(width, percent), SETS_SQL), "joint_sets")
    rows = sets.select("doc_id").join(common, "doc_id").select(*sets.columns)
    sets = scratch.save(sets.join(several, "doc_id", "left_anti").unionByName(rows), "whole_sets")
    return texts.join(several, "doc_id", "left_anti").unionByName(joint), sets


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = scratch.save(docs.mapInArrow(_sets(width, percent), SETS_SQL), "sets")
    texts, sets = _one_set_each(docs, sets, scratch, width, percent)
    known = sets.where("doc_id is not null and print is not null")
    reps = known.groupBy("print").agg(F.min(F.struct("doc_id", "n", "keys", "sketch", "parity")).alias("x"))
    reps = scratch.save(reps.select("print", F.col("x.doc_id").alias("rep"), "x.n", "x.keys", "x.sketch", "x.parity"), "reps")
    posted = scratch.save(reps.select("rep", "n", "keys").mapInArrow(_postings, "rep long, n long, key long"), "posted")
    # what is counted per key is written before it meets the rows again: then both sides of the join are plain
    # shuffles, and the rows of a very common key are split over several tasks
    sizes = scratch.save(posted.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    search = _Search(scratch, texts, reps, width, percent)
    if not sizes.isEmpty():
        lists = scratch.save(posted.join(sizes, "key"), "lists")
        # a member's fame: the logarithms of its lists' lengths, so that one very long list does not make it
        fame = lists.groupBy("rep").agg(F.round(F.sum(F.ln("m")), 6).alias("fame"))
        lists = scratch.save(lists.join(fame, "rep"), "famed")
        scratch.drop("posted", "lists")
        for round_ in range(PIVOT_ROUNDS):
            search.pivot_round(lists, round_)
        search.rest(lists)
        scratch.drop("famed")

    named = reps.select("print", "rep").withColumn("component_id", F.col("rep"))
    if search.labels is not None:
        least = search.labels.groupBy("comp").agg(F.min("node").alias("component_id"))
        of_node = search.labels.join(least, "comp").select(F.col("node").alias("rep"), "component_id")
        named = reps.select("print", "rep").join(of_node, "rep", "left").select("print", F.coalesce("component_id", "rep").alias("component_id"))
    named = named.select("print", "component_id")
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "print").join(named, "print", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def representatives(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each group, with the columns that docs has: that of the smallest doc_id.

    Of rows of equal doc_id one stays, the first by its text, then by the whole row as JSON; rows without a
    doc_id stay.
    """
    scratch = Scratch(docs.sparkSession, "unique")
    found = near_duplicates(docs, width, percent).where("doc_id is not null")
    name = "__id" + "_" * max((len(c) for c in docs.columns), default=0)  # no column of docs
    gone = scratch.save(found.groupBy(F.col("doc_id").alias(name)).agg(F.bool_or("kept").alias("kept"), (F.count("*") > 1).alias("again")).where("not kept or again"), "gone")
    again = gone.where("kept").select(name)
    gone = gone.select(name)
    key = F.col("doc_id").cast("long") == F.col(name)
    small = gone.count() <= BROADCAST_ROWS
    single = docs.join(F.broadcast(gone) if small else gone, key, "left_anti")
    if again.isEmpty():
        return single
    own = docs.join(F.broadcast(again) if small else again, key, "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = own.groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.to_json(row))).alias(name))
    return single.unionByName(first.select(f"{name}.*"))


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same rows by joining all shingles; for small tables only.
OP1_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, hash(array_to_string(w[k : k + 4], ' ')) AS h FROM w, unnest(range(1, greatest(1, len(w) - 4) + 1)) t(k) WHERE len(w) > 0
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
    SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 85 * (x.n + y.n - c)
), e AS (
    SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (
    SELECT a AS doc_id, b AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a
), m AS (
    SELECT doc_id, min(other) AS least FROM r GROUP BY 1
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.least, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m.least, d.doc_id)) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
