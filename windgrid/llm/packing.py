"""Best-fit packing of token pieces into sequences, by bin completion.

``pack`` cuts every document into pieces of at most ``capacity`` tokens and gives each piece a
sequence and an offset. How full sequences can get depends only on how many pieces there are of each
length, so the search works on that histogram (at most ``capacity`` entries, whatever the size of the
corpus). Its answer is a list of filling patterns with multiplicities. A piece finds its sequence
from its rank among the pieces of its length, so that no task ever holds more than its own pieces.

Two searches run over the histogram. `bin_completion` commits one filling around the largest piece after
another; that gives the incumbent. `branch` is the branch and bound: at each largest piece it goes on with
each of its undominated fillings (of a dominated one, one or two pieces could be changed for a longer single
piece that is there and fits), those with the least waste first, and drops a branch whose sequences so far
and lower bound for the rest are no fewer than the incumbent's. It ends after `nodes` of them; within one
filling's enumeration SEARCH_NODES end it. Both are parameters (None: no end, the packing is the least
possible). `solve` says whether its packing is proved to be.

Defined cases: a null or empty text is the end token alone; a null doc_id stays null; repeated rows
are packed as separate documents; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windgrid.llm import tokens
from windgrid.llm.scratch import Scratch

CAPACITY = 1024
#: Fillings looked at for one largest piece before its best filling so far is taken.
SEARCH_NODES = 3_000
#: Branches that the search over whole packings looks at, and fillings of one largest piece that it goes on with.
BRANCHES, WIDTH = 400, 4
#: Wastes of a sequence that a search accepts at once; one search for each.
ACCEPTED = (0, 1, 2, 4, 6, 8, 10, 12, 16, 24)
#: A lookup is sent to every executor up to this many rows (about 50 bytes each), and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Filling:
    """`times` sequences, each of `parts`: (length, how often), longest first."""

    times: int
    parts: tuple[tuple[int, int], ...]


def complete(counts: np.ndarray, largest: int, capacity: int, enough: int = 0, nodes: int = SEARCH_NODES) -> list[tuple[int, int]]:
    """The first filling around one piece of length `largest` that wastes no more than `enough`, or the least.

    Depth first over lengths from long to short, as many of each as fit first. Fillings that leave room
    for a piece still there are dominated and not formed. A branch is cut when the waste it cannot avoid
    is no less than that of the incumbent; the first incumbent is best fit (the longest that fits, again
    and again). Of equal waste, the filling with the longer pieces is found first and kept.
    """
    room = capacity - largest
    left = counts.copy()
    left[largest] -= 1
    lengths = [int(x) for x in np.nonzero(left[: room + 1])[0][::-1]]
    if not lengths:
        return [(largest, 1)]
    # tail[i]: tokens in all pieces from lengths[i] on; no branch can fill more than that
    mass = np.array([n * int(left[n]) for n in lengths], dtype=np.int64)
    tail = np.concatenate([np.cumsum(mass[::-1])[::-1], [0]])
    waste, best = room + 1, ()
    stack: list[tuple[int, int, tuple]] = [(0, room, ())]
    for _ in range(nodes):
        if not stack or waste <= enough:
            break
        i, free, chosen = stack.pop()
        while i < len(lengths) and lengths[i] > free:
            i += 1
        if i == len(lengths):
            if free < waste:
                waste, best = free, chosen
            continue
        if free - int(tail[i]) >= waste:
            continue
        n = lengths[i]
        most = min(free // n, int(left[n]))
        # with no shorter length to follow, fewer than `most` would be dominated
        for k in range(0 if i + 1 < len(lengths) else most, most + 1):
            stack.append((i + 1, free - k * n, (*chosen, (n, k)) if k else chosen))
    out = dict(best)
    out[largest] = out.get(largest, 0) + 1
    return sorted(out.items(), reverse=True)


def best_fit_decreasing(counts: np.ndarray, capacity: int) -> list[Filling]:
    """Best fit of the pieces from long to short, on the histogram; the incumbent for the whole packing."""
    left, out = counts.astype(np.int64).copy(), []
    while (there := np.nonzero(left)[0]).size:
        used, free, parts = {}, capacity, []
        for n in there[::-1]:
            n = int(n)
            if n <= free and (k := min(free // n, int(left[n]))):
                parts.append((n, k))
                used[n] = k
                free -= n * k
        times = min(int(left[n]) // k for n, k in used.items())
        for n, k in used.items():
            left[n] -= k * times
        out.append(Filling(times, tuple(parts)))
    return out


def bin_completion(counts: np.ndarray, capacity: int, enough: int = 0) -> list[Filling]:
    """Fills sequences around the largest piece left; a filling is used as often as the counts allow.

    enough: waste that is accepted at once. Without any, exact fillings use up the short pieces early.
    """
    left, out = counts.astype(np.int64).copy(), []
    while (there := np.nonzero(left)[0]).size:
        parts = complete(left, int(there[-1]), capacity, enough)
        times = max(1, min(int(left[n]) // k for n, k in parts))
        for n, k in parts:
            left[n] -= k * times
        out.append(Filling(times, tuple(parts)))
    return out


def fewest_possible(counts: np.ndarray, capacity: int) -> int:
    """A lower bound: for every a, pieces above capacity - a stand alone, those above half do not share, and the
    pieces from a to half need what room those leave."""
    n = np.arange(capacity + 1)
    much, many = np.concatenate([[0], np.cumsum(counts * n)]), np.concatenate([[0], np.cumsum(counts)])
    half, best = capacity // 2, 0
    for a in range(half + 1):
        alone, apart = many[-1] - many[capacity - a + 1], many[capacity - a + 1] - many[half + 1]
        room = apart * capacity - (much[capacity - a + 1] - much[half + 1])
        best = max(best, int(alone + apart + max(0, -(-(much[half + 1] - much[a] - room) // capacity))))
    return best


def dominated(parts: dict[int, int], largest: int, left: np.ndarray, free: int) -> bool:
    """Whether a filling that leaves `free` could have a longer piece, there in `left`, in place of one or two others.

    Whatever packing uses such a filling is no worse with the pieces changed over (Martello and Toth). The largest
    piece itself stays. With nothing to change, a piece that fits into `free` as well dominates.
    """
    spare = left.copy()
    for n, k in parts.items():
        spare[n] -= k
    own = dict(parts)
    own[largest] -= 1
    have = [n for n, k in own.items() if k]
    groups = [0, *have, *(a + b for i, a in enumerate(have) for b in have[i:] if a != b or own[a] > 1)]
    # a piece equal to the pair's sum changes two for one of the same size: that dominates too
    return any(spare[max(1, g + (g in own)) : g + free + 1].any() for g in groups)


def fillings(left: np.ndarray, largest: int, capacity: int, most: int | None = WIDTH, nodes: int | None = SEARCH_NODES) -> tuple[list[tuple[tuple[int, int], ...]], bool]:
    """The `most` undominated fillings around a largest piece with the least waste, and whether these are all there are."""
    room, out, whole = capacity - largest, [], True
    rest = left.copy()
    rest[largest] -= 1
    lengths = [int(x) for x in np.nonzero(rest[: room + 1])[0][::-1]]
    stack: list[tuple[int, int, tuple]] = [(0, room, ())]
    seen = 0
    while stack:
        if nodes is not None and seen >= nodes:
            whole = False
            break
        seen += 1
        i, free, chosen = stack.pop()
        while i < len(lengths) and lengths[i] > free:
            i += 1
        if i == len(lengths):
            parts = dict(chosen)
            parts[largest] = parts.get(largest, 0) + 1
            if not dominated(parts, largest, left, free):
                out.append((free, tuple(sorted(parts.items(), reverse=True))))
            continue
        n = lengths[i]
        for k in range(min(free // n, int(rest[n])) + 1):
            stack.append((i + 1, free - k * n, (*chosen, (n, k)) if k else chosen))
    out.sort(key=lambda x: x[0])
    if most is not None and len(out) > most:
        out, whole = out[:most], False
    return [p for _, p in out], whole


def branch(counts: np.ndarray, capacity: int, incumbent: list[Filling], nodes: int | None = BRANCHES, most: int | None = WIDTH, within: int | None = SEARCH_NODES) -> tuple[list[Filling], bool]:
    """The branch and bound over packings: the fewest sequences found, and whether there can be none with fewer.

    A filling is tried as often as the counts allow and, where nothing is cut short, less often as well.
    """
    total = sum(f.times for f in incumbent)
    least = fewest_possible(counts, capacity)
    best, exact, seen = incumbent, True, 0
    whole_search = nodes is None and most is None and within is None
    stack: list[tuple[np.ndarray, int, tuple]] = [(counts.astype(np.int64), 0, ())]
    while stack and total > least:
        if nodes is not None and seen >= nodes:
            exact = False
            break
        seen += 1
        left, used, done = stack.pop()
        there = np.nonzero(left)[0]
        if not there.size:
            if used < total:
                total, best = used, list(done)
            continue
        if used + fewest_possible(left, capacity) >= total:
            continue
        largest = int(there[-1])
        found, whole = fillings(left, largest, capacity, most, within)
        if not found:  # all of them beyond the nodes: the plain completion
            found, whole = [tuple(complete(left, largest, capacity))], False
        exact &= whole
        for parts in reversed(found):
            often = max(1, min(int(left[n]) // k for n, k in parts))
            exact &= whole_search or often == 1
            for times in range(1, often + 1) if whole_search else (often,):
                after = left.copy()
                for n, k in parts:
                    after[n] -= k * times
                stack.append((after, used + times, (*done, Filling(times, parts))))
    return best, exact or total == least


def solve(counts: np.ndarray, capacity: int = CAPACITY, nodes: int | None = BRANCHES, most: int | None = WIDTH, within: int | None = SEARCH_NODES) -> list[Filling]:
    """The best of the best-fit incumbent, of bin completions with several accepted wastes, and of the branch and bound."""
    return packing_of(counts, capacity, nodes, most, within)[0]


def packing_of(counts: np.ndarray, capacity: int = CAPACITY, nodes: int | None = BRANCHES, most: int | None = WIDTH, within: int | None = SEARCH_NODES) -> tuple[list[Filling], bool]:
    """A packing, and whether it is proved that none has fewer sequences."""
    total = lambda fillings: sum(f.times for f in fillings)
    best, least = best_fit_decreasing(counts, capacity), fewest_possible(counts, capacity)
    for enough in ACCEPTED:
        if total(best) == least:
            return best, True
        best = min(best, bin_completion(counts, capacity, enough), key=total)
    return branch(counts, capacity, best, nodes, most, within)


def places(fillings: list[Filling]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank + 1, first sequence, pieces of it in a sequence, first offset)."""
    taken: dict[int, int] = {}
    out, sequence = [], 0
    for f in fillings:
        offset = 0
        for n, k in f.parts:
            low = taken.get(n, 0)
            taken[n] = low + k * f.times
            out.append((n, low, taken[n], sequence, k, offset))
            offset += n * k
        sequence += f.times
    return out


PIECES = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
    ("ids", pa.binary()), ("task", pa.int32()), ("place", pa.int64()),
])


def cut(encoder: Callable[[], Callable], capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to pieces; `place` counts the pieces of one length within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, counted = encoder(), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            docs = batch.column("doc_id").to_pylist()
            for at in range(0, len(docs), 256):
                rows: list[tuple] = []
                for doc, ids in zip(docs[at : at + 256], encode(batch.column("text").slice(at, 256).to_pylist()), strict=True):
                    raw, first = ids.astype("<u4").tobytes(), len(ids) % capacity or capacity
                    low, high, piece = 0, first, 0
                    while low < len(ids):
                        n = high - low
                        rows.append((doc, piece, low, n, raw[4 * low : 4 * high], task, counted[n]))
                        counted[n] += 1
                        low, high, piece = high, high + capacity, piece + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), PIECES.types, strict=True)], schema=PIECES)

    return run


def pack(docs: DataFrame, encoder: Callable[[], Callable], capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places.

    docs: doc_id, text. encoder: called in each task, gives a function from a list of texts to arrays of
    ids, end token included. Returns doc_id, piece, start, length, ids (little-endian unsigned 32-bit),
    sequence_id, offset.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    schema = "doc_id long, piece int, start long, length long, ids binary, task int, place long"
    pieces = scratch.save(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut(encoder, capacity), schema), "pieces")
    per_task = scratch.save(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "per_task")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `capacity` rows
        counts[row["length"]] = row["n"]
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    if per_task.count() <= BROADCAST_ROWS:
        ranks = F.broadcast(ranks)
    slots = Slots(places(solve(counts, capacity)))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(("sequence_id", "offset"), slots(length.to_numpy(dtype=np.int64), rank.to_numpy(dtype=np.int64)), strict=True)))

    # only lengths and ranks go to Python
    ranked = pieces.join(ranks, ["length", "task"]).withColumn("at", place("length", F.col("place") + F.col("earlier")))
    return ranked.select("doc_id", "piece", "start", "length", "ids", "at.sequence_id", "at.offset")


class Slots:
    """Sequence and offset of a piece from its length and its rank among the pieces of that length."""

    def __init__(self, found: list[tuple[int, int, int, int, int, int]]):
        rows = np.array(sorted(found), dtype=np.int64).reshape(-1, 6)
        self.length, self.low, _, self.sequence, self.times, self.first = rows.T
        self.begin = np.searchsorted(self.length, np.arange(int(self.length[-1]) + 2 if len(rows) else 1))  # where each length's rows begin

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((2, len(length)), dtype=np.int64)
        for n in np.unique(length).tolist():
            own = np.nonzero(length == n)[0]
            low, high = self.begin[n], self.begin[n + 1]
            k = low + np.searchsorted(self.low[low:high], rank[own], side="right") - 1
            nth = rank[own] - self.low[k]
            out[0, own] = self.sequence[k] + nth // self.times[k]
            out[1, own] = self.first[k] + nth % self.times[k] * n
        return out[0], out[1]


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: sequence_id, n_tokens, doc_ids, ids (little-endian unsigned 32-bit)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_tokens"),
        F.transform("parts", lambda x: x["doc_id"]).alias("doc_ids"),
        F.expr("aggregate(parts, X'', (a, x) -> concat(a, x.ids))").alias("ids"),
    )


def op9_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens, one row per piece."""
    from windgrid.llm.scratch import table

    packed = pack(table(spark, sf_dir, "documents"), tokens.byte_bpe_encoder(end=2))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
