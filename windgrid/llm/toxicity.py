"""Toxicity by non-negative positive-unlabelled learning.

Training sees confirmed toxic texts and unlabelled texts, of which a share (the class prior) is toxic
too. The risk of a scorer g is estimated as

    prior * P[loss(g)] + max(0, U[loss(-g)] - prior * P[loss(-g)])

over the positive (P) and the unlabelled (U) texts: the unlabelled texts count as clean, less what the
toxic ones among them add, and that difference is not let below zero, where it would only be over-fitting.
g is linear in the presence of words; each word is scaled by how much more often it is in P than in U, so
that a long text of rare words, each seen a few times, adds up to little.

U is every document of the training fold. Words are counted over all of them, and a written table holds
each one's words that are features. Numpy descends on a bounded part of it, and the descent is run again with
its risk corrected by what all of U has beyond that part: passes over all sum loss and gradient in the tasks,
as whole numbers, so that the order of the tasks changes nothing. The cut is where (share of P above) ** 2 / (share of U above) is greatest, which
orders cuts as F1 does without a label of a clean text, or in the middle of cuts nearly as good. Labels of clean texts serve the class prior only.

Defined cases: a null or empty text has no words and gets the score of that; a null doc_id is scored and
never trained on; repeated rows are scored alike; a document with contradicting labels counts as clean;
of equally telling words the smaller code is a feature; with no labels at all every score is the prior's;
an empty table gives no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windgrid.llm.sampling import fold, labelled, picked
from windgrid.llm.scratch import Scratch, bounded_batches, table

#: Labelled texts in the sample for the fit; unlabelled texts that numpy descends on (passes over all correct it).
MOST_LABELLED, START_UNLABELLED = 24_000, 12_000
#: A word is a feature if that many of the sampled toxic texts have it (1: every word), and it is among the most telling ones (None: all).
LEAST_TEXTS, MOST_FEATURES = 4, 2_000
#: Passes that take loss and gradient from all unlabelled texts.
PASSES = 3
THRESHOLD = 0.7
#: Cuts of that share of the best one's worth are as good as it.
FLAT = 0.97
#: Whole units in which a text's share of a gradient or a loss is summed, and bins of the raw score per unit.
UNITS, BINS = 1 << 20, 32

WORD = re.compile(r"[^\W\d_]+")


def code(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def codes(text: str | None) -> set[int]:
    """32-bit codes of the distinct words, in lower case."""
    return {code(w) for w in set(WORD.findall(text.lower()))} if text else set()


class Lookup(dict):
    """What `of` has for a word's code (`absent` if nothing), kept per word; emptied when it gets long."""

    def __init__(self, of: dict, absent, most: int = 500_000):
        super().__init__()
        self.of, self.absent, self.most = of, absent, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        self[word] = found = self.of.get(code(word), self.absent)
        return found


@dataclass(frozen=True)
class PuModel:
    weights: dict[int, float]
    bias: float

    def scorer(self):
        """A function from a text to its score."""
        weight = Lookup(self.weights, 0.0)

        def score(text: str | None) -> float:
            # sorted: the last digit of a sum must not depend on a set's order
            total = self.bias + sum(sorted(map(weight.__getitem__, set(WORD.findall(text.lower()))))) if text else self.bias
            return float(1 / (1 + np.exp(-np.clip(total, -30, 30))))

        return score

    def score(self, text: str | None) -> float:
        return self.scorer()(text)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Rows:
    """Texts as the places of their features (arrays), each `times` over: a sparse 0/1 matrix."""

    def __init__(self, rows: list[np.ndarray], scale: np.ndarray, times: np.ndarray | None = None):
        self.rows, self.scale = len(rows), scale
        self.times = np.ones(len(rows)) if times is None else times.astype(float)
        self.n = max(1.0, float(self.times.sum()))
        self.at = np.repeat(np.arange(self.rows), [len(r) for r in rows])
        self.word = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, (w * self.scale)[self.word], minlength=self.rows)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, g[self.at], minlength=len(self.scale)) * self.scale


def risk(x: np.ndarray, p: Rows, u_loss: float, u_gradient: np.ndarray, prior: float, decay: float) -> tuple[float, float, np.ndarray]:
    """The risk, its part that must not fall below zero, and the gradient; u_*: means over U of loss(-g).

    Below zero the gradient is that of the part, turned round: a step leads back up.
    """
    zp = p.dot(x[:-1]) + x[-1]
    mean = lambda g: np.append(p.back(g * p.times), (g * p.times).sum()) / p.n
    rest = u_loss - prior * float((np.logaddexp(0, zp) * p.times).sum() / p.n)
    ridge = np.append(decay * x[:-1], 0.0)
    up = u_gradient - prior * mean(_sigmoid(zp))
    total = prior * float((np.logaddexp(0, -zp) * p.times).sum() / p.n) + max(0.0, rest) + float(decay * (x[:-1] ** 2).sum() / 2)
    return total, rest, (up - prior * mean(1 - _sigmoid(zp)) if rest >= 0 else -up) + ridge


@dataclass(frozen=True)
class Shift:
    """What all of U has beyond a sample of it, at the weights `at`: in the mean of loss(-g) and in its gradient."""

    at: np.ndarray
    loss: float
    gradient: np.ndarray


def of_sample(x: np.ndarray, u: Rows) -> tuple[float, np.ndarray]:
    """Means of loss(-g) and of its gradient over the rows of u."""
    z = u.dot(x[:-1]) + x[-1]
    s = _sigmoid(z) * u.times
    return float((np.logaddexp(0, z) * u.times).sum() / u.n), np.append(u.back(s), s.sum()) / u.n


def descend(p: Rows, u: Rows, prior: float, shift: Shift | None = None, steps: int = 400, rate: float = 0.05, decay: float = 1e-4) -> np.ndarray:
    """Weights of the scaled features and the bias that minimize the risk (Adam, full batches).

    With a shift, the risk on the sample u is corrected to first order by what all unlabelled texts have beyond it.
    """
    x = np.zeros(len(p.scale) + 1)
    x[-1] = np.log(prior / (1 - prior))
    m, v = np.zeros_like(x), np.zeros_like(x)
    for t in range(1, steps + 1):
        loss, slope = of_sample(x, u)
        if shift:
            loss, slope = loss + shift.loss + float(shift.gradient @ (x - shift.at)), slope + shift.gradient
        _, _, g = risk(x, p, loss, slope, prior, decay)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def fit_to_all(p: Rows, u: Rows, over_all, prior: float, passes: int = PASSES) -> np.ndarray:
    """The fit to all unlabelled texts: descents on the sample u, each corrected by a pass over all at the last one's end.

    over_all: a function from weights to the means of loss(-g) and of its gradient over all of U.
    """
    x = descend(p, u, prior)
    for _ in range(passes):
        (loss, slope), (all_loss, all_slope) = of_sample(x, u), over_all(x)
        x = descend(p, u, prior, Shift(x, all_loss - loss, all_slope - slope))
    return x


def lifts(p: np.ndarray, u: np.ndarray, n_p: int) -> np.ndarray:
    """How far above chance words are among the toxic texts, from their shares; little evidence, little scale."""
    return np.log((p + 0.5 / n_p) / (u + 0.5 / n_p)) * (1 - np.exp(-((p - u) ** 2) * n_p / (8 * (u + 1 / n_p))))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, least_texts: int = LEAST_TEXTS, most_features: int | None = MOST_FEATURES) -> tuple[dict[int, float], float]:
    """Weights by word code and the bias, from texts in memory as arrays of distinct codes."""
    names, in_p = np.unique(np.concatenate([np.empty(0, np.int64), *positive]).astype(np.int64), return_counts=True)
    all_u, counts_u = np.unique(np.concatenate([np.empty(0, np.int64), *unlabelled]).astype(np.int64), return_counts=True)
    found = dict(zip(all_u.tolist(), counts_u.tolist(), strict=True))
    p, u = in_p / max(1, len(positive)), np.array([found.get(c, 0) for c in names.tolist()]) / max(1, len(unlabelled))
    lift = lifts(p, u, max(1, len(positive)))
    there = np.nonzero((in_p >= least_texts) & (p > u))[0]
    there = np.sort(there[np.lexsort((names[there], -np.round(lift * p, 9)[there]))][:most_features])
    names, scale = names[there], lift[there]
    rows = lambda texts: Rows([np.nonzero(np.isin(names, t))[0] for t in texts], scale)
    x = descend(rows(positive), rows(unlabelled), prior)
    return {int(c): float(f) for c, f in zip(names, x[:-1] * scale, strict=True)}, float(x[-1])


def cut(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The raw score from which a text counts as toxic, from counts by bin (BINS to a unit, the middle one at 0).

    Training texts lie higher than others of their kind, so the cut is not where the worth is greatest but in the
    middle of the cuts around that which are worth nearly as much.
    """
    above_p, above_u = positive[::-1].cumsum()[::-1], unlabelled[::-1].cumsum()[::-1]
    worth = above_p.astype(float) ** 2 / np.maximum(above_u, 1)
    low = high = int(np.argmax(worth))
    while low > 0 and worth[low - 1] >= FLAT * worth.max():
        low -= 1
    while high + 1 < len(worth) and worth[high + 1] >= FLAT * worth.max():
        high += 1
    return ((low + high) / 2 - len(worth) // 2) / BINS


def _bins(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(z * BINS), -30 * BINS, 30 * BINS - 1).astype(np.int64) + 30 * BINS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> code, n: texts that have the word, counted as far as memory for a million words allows."""

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate([np.empty(0, np.int64), *held]), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["code", "n"])

    known, held, size = Lookup(_Codes(), None), [], 0
    for batch in batches:
        for t in batch.column("text"):
            if t := t.as_py():
                held.append(np.fromiter(set(map(known.__getitem__, set(WORD.findall(t.lower())))), dtype=np.int64))
                size += len(held[-1])
                if size >= 1_000_000:
                    yield counted(held)
                    held, size = [], 0
    yield counted(held)


class _Codes:
    """Every code stands for itself."""

    @staticmethod
    def get(key: int, absent=None) -> int:
        return key


def _patterns(features: np.ndarray):
    """pick, text -> pick, places, n: the sorted features of texts, equal ones together as far as they meet in a task."""
    schema = pa.schema([("pick", pa.bool_()), ("places", pa.binary()), ("n", pa.int64())])

    def rows(held: dict) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.bool_()), pa.array([k[1] for k in held], pa.binary()), pa.array(list(held.values()), pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = Lookup({int(c): k for k, c in enumerate(features)}, -1)
        held: dict[tuple[bool, bytes], int] = {}
        for batch in batches:
            for pick, t in zip(batch.column("pick").to_pylist(), batch.column("text"), strict=True):
                found = set(map(place.__getitem__, set(WORD.findall(t.lower())))) if (t := t.as_py()) else set()
                key = (pick, np.array(sorted(found - {-1}), dtype="<u4").tobytes())
                held[key] = held.get(key, 0) + 1
            if len(held) >= 20_000:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    return run


def _places(cells) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), dtype="<u4") for x in cells]


def _units(x: np.ndarray, scale: np.ndarray):
    """places, n -> place, units: loss and gradient of loss(-g) over the rows, per feature, then bias, then loss."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(scale) + 2, dtype=np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy()
            rows = Rows(_places(batch.column("places")), scale)
            z = rows.dot(x[:-1]) + x[-1]
            s = np.rint(_sigmoid(z) * UNITS).astype(np.int64) * n
            # whole numbers below 2 ** 53 in a batch: exact
            total[:-2] += np.rint(np.bincount(rows.word, s[rows.at], minlength=len(scale))).astype(np.int64)
            total[-2] += s.sum()
            total[-1] += (np.rint(np.logaddexp(0, z) * UNITS).astype(np.int64) * n).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["place", "units"])

    return run


def _spread(x: np.ndarray, scale: np.ndarray):
    """places, n -> bin, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(60 * BINS, dtype=np.int64)
        for batch in batches:
            z = Rows(_places(batch.column("places")), scale).dot(x[:-1]) + x[-1]
            np.add.at(total, _bins(z), batch.column("n").to_numpy())
        there = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], names=["bin", "n"])

    return run


def _over_all(patterns: DataFrame, x: np.ndarray, scale: np.ndarray, n: int) -> tuple[float, np.ndarray]:
    """Means of loss(-g) and of its gradient over all unlabelled texts."""
    got = patterns.select("places", "n").mapInArrow(_units(x, scale), "place long, units long").groupBy("place").agg(F.sum("units").alias("units")).collect()
    total = np.zeros(len(scale) + 2)
    for r in got:
        total[r["place"]] = r["units"]
    total /= UNITS * n
    return float(total[-1]), np.append(total[:-2] * scale, total[-2])


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "toxic", most: int = MOST_LABELLED, least_texts: int = LEAST_TEXTS, most_features: int | None = MOST_FEATURES, passes: int = PASSES) -> PuModel:
    """Fits the model on documents for which `keep` (of doc_id) holds; labels beyond `most` are sampled, texts are not."""
    scratch = Scratch(docs.sparkSession, "toxic")
    known = scratch.save(labelled(docs, labels, label, keep, most).select("doc_id", "label", "text"), "known")
    sides = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_p = sides.get(1, 0)
    prior = min(0.9, max(0.001, n_p / max(1, sum(sides.values()))))
    base = float(np.log(prior / (1 - prior)))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(F.col("doc_id").isNotNull()).where(keep)
    n_u = own.count()
    if not n_p or not n_u:
        return PuModel({}, base)
    count = lambda rows: rows.select("text").mapInArrow(_counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    in_p = scratch.save(count(known.where("label = 1")).where(F.col("n") >= least_texts).withColumnRenamed("n", "p"), "in_p")
    both = in_p.join(count(own).withColumnRenamed("n", "u"), "code", "left").select("code", "p", F.coalesce("u", F.lit(0)).alias("u"))
    both = both.where(F.col("p") * n_u > F.col("u") * n_p)
    # the same formula as `lifts`, to leave all but the most telling words where they are
    p, u = F.col("p") / n_p, F.col("u") / n_u
    lift = F.log((p + 0.5 / n_p) / (u + 0.5 / n_p)) * (1 - F.exp(-((p - u) ** 2) * n_p / (8 * (u + 1 / n_p))))
    both = scratch.save(both.withColumn("worth", F.round(lift * p, 9)), "both")
    both = both.orderBy(F.desc("worth"), "code").limit(most_features) if most_features else both
    words = both.select("code", "p", "u").toPandas().sort_values("code")
    if not len(words):
        return PuModel({}, base)
    features = words["code"].to_numpy(dtype=np.int64)
    scale = lifts(words["p"].to_numpy() / n_p, words["u"].to_numpy() / n_u, n_p)

    columns = "pick boolean, places binary, n long"
    of_p = known.where("label = 1").select(F.lit(True).alias("pick"), "text").mapInArrow(_patterns(features), columns).toArrow()
    patterns = scratch.save(own.select(picked(F.col("doc_id"), START_UNLABELLED, n_u).alias("pick"), "text").mapInArrow(_patterns(features), columns), "patterns")

    def rows(found: pa.Table) -> Rows:
        order = sorted(range(found.num_rows), key=lambda i: (found["places"][i].as_py(), found["n"][i].as_py()))  # whatever the tasks were
        places = _places(found["places"])
        return Rows([places[i] for i in order], scale, found["n"].to_numpy()[order])

    p, u = rows(of_p), rows(patterns.where("pick").toArrow())
    x = fit_to_all(p, u, lambda w: _over_all(patterns, w, scale, n_u), prior, passes)
    unlabelled = np.zeros(60 * BINS, dtype=np.int64)
    for r in patterns.select("places", "n").mapInArrow(_spread(x, scale), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        unlabelled[r["bin"]] = r["n"]
    positive = np.bincount(_bins(p.dot(x[:-1]) + x[-1]), p.times, minlength=60 * BINS).astype(np.int64)
    scratch.drop("known", "in_p", "both", "patterns")
    found = x[:-1] * scale
    weights = {int(c): float(f) for c, f in zip(features, found, strict=True) if abs(f) > 1e-3}
    return PuModel(weights, float(x[-1]) - cut(positive, unlabelled) + float(np.log(THRESHOLD / (1 - THRESHOLD))))


def score(docs: DataFrame, model: PuModel, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (all of docs, if not given) with score and predicted of the whole text appended.

    Columns of docs with those two names are replaced.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    names = docs.columns if carry is None else carry
    schema = docs.select(*names).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            got = np.array([of(t.as_py()) for t in batch.column("text")], dtype=float)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(got), pa.array((got >= THRESHOLD).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: PuModel) -> DataFrame:
    """The rows of docs whose score is below THRESHOLD, with the columns that docs has.

    Only the text goes to Python, and only the score comes back.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = model.scorer()
        for texts in parts:
            yield pd.Series([of(t) for t in texts], dtype=float)

    return docs.where(scored(F.col("text").cast("string")) < THRESHOLD)


def held_out(remainder: int, folds: int) -> Column:
    return F.coalesce(fold(F.col("doc_id"), folds) == remainder, F.lit(False))


def op6_pu_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt from those whose id's remainder by 3 is not 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, ~held_out(1, 3))
    return score(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held_out(1, 3).alias("held_out"), "score", "predicted")
