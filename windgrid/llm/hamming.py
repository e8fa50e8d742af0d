"""Exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into m segments. If two codes differ in at most d bits, one of their segments differs
in at most floor(d / m) bits. So searching every segment's inverted lists for values within radius r finds
all codes at distance below m * (r + 1); radii grow, for the queries that need it, until the kth distance
found is below that bound and the answer is provably complete.

The index is one table for all rows: a row per code and segment, keyed by (segment, value). In each round
the open queries post the values at exactly the round's radius, the two meet in an equi-join on the key, and
a pair counts in the one segment where it is nearest (the first of those), so none is seen twice. The best k
so far go into the next round with the query, and a candidate beyond the kth of them is dropped in the join.
The number of segments follows from the number of codes, so that lists stay short: m is 64 / (log2(codes) -
SPARE), rounded.

Equal codes are one entry with their k smallest ids, and equal query codes one query, so that a code with
many copies costs as much as any other. A list of more than CELL codes, as of a segment that many codes
share, is dealt into several, and the values posted to it with it.

Defined cases: a null vector, one of another length or with a null in it has no code, is no query and is
never found; a null id likewise; repeated rows are different entries with equal ids; ties in distance go
to the smaller id; fewer than k rows give fewer; a query finds itself; repeated queries are answered each;
an empty table gives no rows; other columns of either table are not read.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windgrid.llm.scratch import Scratch, table

BITS = 64
#: A segment is that many bits shorter than what tells all codes apart: lists hold about 2 ** SPARE codes.
SPARE = 3
LEAST_WIDTH, MOST_WIDTH = 8, 32
K = 10
#: Every row whose id is divisible by this is a query.
EVERY = 50
#: Codes of a list, or of each part of a longer one.
CELL = 4096
#: Lists of several parts are sent to every executor up to this many (20 bytes each), and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000


def sign_code(vector: str) -> str:
    """SQL of 64 bits, bit i set where element i is above zero; null unless there are 64 elements, none null."""
    bits = f"aggregate(transform({vector}, (x, i) -> if(x > 0, shiftleft(1L, i), 0L)), 0L, (a, x) -> a | x)"
    return f"if(size({vector}) = {BITS} and forall({vector}, x -> x is not null), {bits}, null)"


def segments(codes: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments for that many distinct codes; all bits, widths as equal as can be."""
    width = min(MOST_WIDTH, max(LEAST_WIDTH, log2(max(2, codes)) - SPARE))
    m = max(ceil(BITS / MOST_WIDTH), round(BITS / width))
    ends = [BITS * k // m for k in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def masks(width: int, radius: int) -> list[int]:
    """Values of `width` bits with `radius` of them set."""
    return [sum(1 << i for i in c) for c in combinations(range(width), radius)]


def _value(code: Column | str, cut: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(code, cut[0]).bitwiseAND(F.lit((1 << cut[1]) - 1).cast("long"))


class Index:
    """Inverted lists of all segments over entries (code, ids)."""

    def __init__(self, entries: DataFrame, scratch: Scratch, cell: int = CELL):
        self.scratch, self.cuts = scratch, segments(entries.count())
        values = F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), _value("code", cut).alias("value")) for s, cut in enumerate(self.cuts)]))
        lists = scratch.save(entries.select("code", "ids", values.alias("x")).select("x.segment", "x.value", "code", "ids"), "lists")
        sizes = lists.groupBy("segment", "value").agg(F.ceil(F.count("*") / cell).cast("int").alias("parts")).where("parts > 1")
        sizes = scratch.save(sizes, "long_lists")
        several = sizes.count()
        self.long_lists = None
        if several:
            self.long_lists = F.broadcast(sizes) if several <= BROADCAST_ROWS else sizes
        self.lists = self.dealt(lists).withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("code"), F.col("parts")).cast("int")).otherwise(0)).drop("parts")

    def dealt(self, rows: DataFrame) -> DataFrame:
        """rows (segment, value, ...) with the parts of their list."""
        if self.long_lists is None:
            return rows.withColumn("parts", F.lit(1))
        return rows.join(self.long_lists, ["segment", "value"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))

    def posted(self, queries: DataFrame, radius: int) -> DataFrame:
        """segment, value, part, q, bound: the values at exactly `radius` from those of queries (q, bound)."""
        spark = queries.sparkSession
        wanted = [(s, masks(width, radius)) for s, (_, width) in enumerate(self.cuts) if radius <= width]
        flips = F.broadcast(spark.createDataFrame(wanted, "segment int, masks array<long>"))  # a row per segment
        own = F.explode(F.array(*[F.struct(F.lit(s).alias("segment"), _value("q", cut).alias("value")) for s, cut in enumerate(self.cuts)]))
        at = queries.select("q", "bound", own.alias("x")).select("q", "bound", "x.segment", "x.value").join(flips, "segment")
        at = at.select("segment", F.explode(F.transform("masks", lambda m: m.bitwiseXOR(F.col("value")))).alias("value"), "q", "bound")
        return self.dealt(at).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def found(self, queries: DataFrame, radius: int) -> DataFrame:
        """q, distance, ids: codes that are nearest to a query in some segment at exactly `radius`, none beyond its bound."""
        met = self.lists.join(self.posted(queries, radius), ["segment", "value", "part"])
        apart = F.col("code").bitwiseXOR(F.col("q"))
        met = met.withColumn("distance", F.bit_count(apart).cast("int")).where(F.col("distance") <= F.col("bound"))
        # the first of the segments with the least distance
        first = F.lit(True)
        for s, cut in enumerate(self.cuts):
            d = F.bit_count(_value(apart, cut))
            first &= F.when(F.col("segment") > s, d > radius).when(F.col("segment") < s, d >= radius).otherwise(F.lit(True))
        return met.where(first).select("q", "distance", "ids")


def top_k(rows: DataFrame, queries: DataFrame, k: int = K, cell: int = CELL) -> DataFrame:
    """query_id, rank, id, distance of the k nearest of rows (id, code) for each of queries (query_id, code)."""
    scratch = Scratch(rows.sparkSession, "hamming")
    rows, asked = rows.select("id", "code").where("id is not null and code is not null"), queries.select("query_id", "code").where("query_id is not null and code is not null")
    nth = Window.partitionBy("code").orderBy("id")
    entries = rows.withColumn("n", F.row_number().over(nth)).where(F.col("n") <= k)
    entries = scratch.save(entries.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    open_ = scratch.save(asked.select(F.col("code").alias("q")).distinct().withColumn("bound", F.lit(BITS)), "open_0")
    index = Index(entries, scratch, cell)
    m, radius, best, done = len(index.cuts), 0, None, []
    while not open_.isEmpty():
        if radius > max(width for _, width in index.cuts):  # everything was met: fewer than k rows
            done.append(best)
            break
        new = index.found(open_, radius)
        new = new if best is None else best.unionByName(new)
        # the k best codes by their smallest ids hold the k best ids
        order = Window.partitionBy("q").orderBy("distance", F.col("ids")[0])
        best = scratch.save(new.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n"), f"best_{radius}")
        each = best.select("q", "distance", F.size("ids").alias("n")).groupBy("q").agg(F.sort_array(F.collect_list(F.struct("distance", "n"))).alias("x"))  # at most k
        kth = F.aggregate("x", F.struct(F.lit(0).alias("n"), F.lit(BITS).alias("d")), lambda a, x: F.struct((a["n"] + x["n"]).alias("n"), F.when((a["n"] < k) & (a["n"] + x["n"] >= k), x["distance"]).otherwise(a["d"]).alias("d")))
        state = each.select("q", kth.alias("kth")).select("q", F.col("kth.d").alias("bound"), (F.col("kth.n") >= k).alias("full"))
        state = open_.select("q").join(state, "q", "left").select("q", F.coalesce("bound", F.lit(BITS)).alias("bound"), F.coalesce("full", F.lit(False)).alias("full"))
        state = scratch.save(state.withColumn("closed", F.col("full") & (F.col("bound") < m * (radius + 1))), f"state_{radius}")
        done.append(best.join(state.where("closed").select("q"), "q", "left_semi"))
        open_ = state.where("not closed").select("q", "bound")
        best = best.join(open_.select("q"), "q", "left_semi")
        radius += 1
    found = rows.sparkSession.createDataFrame([], "q long, distance int, ids array<long>")
    for part in done:
        found = found.unionByName(part)
    each = found.select("q", "distance", F.explode("ids").alias("id"))
    order = Window.partitionBy("q").orderBy("distance", "id")
    each = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(F.col("q").alias("code"), "rank", "id", "distance")
    return asked.join(each, "code").select("query_id", "rank", "id", "distance")


def op8_multi_index_hashing(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest rows by sign code for every row whose id is divisible by 50."""
    coded = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.expr(sign_code("embedding")).alias("code"))
    found = top_k(coded, coded.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "code"))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


OP8_SQL = """
WITH c AS (
    SELECT vec_id, list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN (1::HUGEINT << i::INTEGER) ELSE 0::HUGEINT END))::HUGEINT AS code
    FROM embeddings WHERE len(embedding) = 64
), d AS (
    SELECT q.vec_id AS query_id, r.vec_id, bit_count(xor(q.code, r.code)) AS distance
    FROM c q, c r WHERE q.vec_id % 50 = 0
), n AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS INTEGER) AS distance FROM n WHERE rank <= 10
"""
