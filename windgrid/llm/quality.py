"""Document quality by Bradley-Terry pairwise ranking.

From labelled documents, pairs of a better and a worse one are drawn; the chance that a document is
preferred is the logistic function of the difference of the two scores, and scores are linear in features
of the text. So the fit is a logistic regression on feature differences, without a bias. The scores say
which document is better, not which is good: the border is a quantile of the scores of the labelled
documents (the one given, or the one whose cut agrees best with the labels), and scores are shifted so that
it lies at THRESHOLD.

Defined cases: a null or empty text has the features of no text and gets the score of that; a null doc_id
is scored and never trained on; repeated rows are scored alike; without labels of both kinds every score
is 0.5 + THRESHOLD / 2 (nothing is rejected); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windgrid.llm.sampling import labelled
from windgrid.llm.scratch import bounded_batches, table
from windgrid.llm.toxicity import held_out

#: Labelled texts in the sample for the fit, and preference pairs drawn from them.
MOST_LABELLED, PAIRS = 24_000, 200_000
THRESHOLD = 0.7

UPPER, LOWER, DIGIT, SPACE, LINE = range(5)
_CLASS = np.full(256, 6, dtype=np.int64)  # 6: bytes beyond ASCII
_CLASS[:128] = 5
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = UPPER, LOWER, DIGIT, SPACE, LINE
#: Marks of ordinary prose; other ASCII marks are counted apart.
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[[ord(c) for c in ".,;:'\"()-?"]] = True
_CLASS[_PLAIN] = 7
N_CLASSES = 8

NAMES = [
    "upper", "lower", "digit", "space", "line", "other_mark", "beyond_ascii", "plain_mark", "class_changes", "mark_runs",
    "log_words", "word_length", "long_words", "distinct_words", "next_same", "top_word", "top_pair", "distinct_pairs",
    "capital_words", "upper_words", "words_with_marks", "bare_marks", "log_lines", "distinct_lines", "line_length", "end_marks", "link_words",
    "worst_window_mark", "worst_window_upper", "worst_window_distinct",
]
WINDOW = 64
_LINK = re.compile(r"https?:|www\.|@")


def features(text: str | None) -> np.ndarray:
    """Shares and logarithms that describe the whole text, in the order of NAMES."""
    out = np.zeros(len(NAMES))
    if not text or text.isspace():
        return out
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    kinds = _CLASS[raw]
    out[:N_CLASSES] = np.bincount(kinds, minlength=N_CLASSES) / len(raw)
    if len(raw) > 1:
        change = kinds[1:] != kinds[:-1]
        out[8] = change.mean()
        out[9] = ((kinds[1:] == 5) & ~change).mean()
    words = text.split()
    n = len(words)
    lower = [w.lower() for w in words]
    seen: dict[str, int] = {}
    codes = np.array([seen.setdefault(w, len(seen)) for w in lower], dtype=np.int64)
    counts = np.bincount(codes)
    sizes = np.array([len(w) for w in words])
    out[10] = np.log1p(n)
    out[11] = sizes.mean()
    out[12] = (sizes > 20).mean()
    out[13] = len(counts) / n
    out[15] = counts.max() / n
    if n > 1:
        out[14] = (codes[1:] == codes[:-1]).mean()
        pairs = np.unique(codes[1:] * len(seen) + codes[:-1], return_counts=True)[1]
        out[16] = pairs.max() / (n - 1)
        out[17] = len(pairs) / (n - 1)
    upper = np.array([w.isupper() and len(w) > 1 for w in words])
    out[18] = sum(w[0].isupper() for w in words) / n
    out[19] = upper.mean()
    marked = np.array([not (w[-1].isalnum() or w[-1] in ".,;:?\"')") for w in words])
    out[20] = marked.mean()
    out[21] = sum(len(w) == 1 and not w.isalnum() for w in words) / n
    lines = text.splitlines()
    out[22] = np.log1p(len(lines))
    out[23] = len(set(lines)) / len(lines)
    out[24] = np.log1p(len(text) / len(lines))
    out[25] = sum(x.rstrip().endswith((".", "?", "!", ":")) for x in lines) / len(lines)
    out[26] = sum(bool(_LINK.search(w)) for w in words) / n if ":" in text or "@" in text or "www." in text else 0.0
    # the worst stretch, for texts that are good but for a part
    ends = np.unique(np.append(np.arange(WINDOW, n, WINDOW // 2), n))  # by half over one another, the last one at the end
    starts = np.maximum(ends - WINDOW, 0)
    for k, x in ((27, marked), (28, upper)):
        total = np.concatenate([[0], np.cumsum(x)])
        out[k] = ((total[ends] - total[starts]) / (ends - starts)).max()
    out[29] = max(1 - len(np.unique(codes[a:b])) / (b - a) for a, b in zip(starts, ends, strict=True))
    return out


@dataclass(frozen=True)
class RankModel:
    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    border: float
    slope: float
    quantile: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.border) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def loss(w: np.ndarray, d: np.ndarray, decay: float) -> float:
    """Mean logistic loss of the preferences, from feature differences (better less worse)."""
    return float(np.logaddexp(0, -(d @ w)).mean() + decay * (w**2).sum() / 2)


def gradient(w: np.ndarray, d: np.ndarray, decay: float) -> np.ndarray:
    lost = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
    return -(lost @ d) / len(d) + decay * w


def fit(x: np.ndarray, y: np.ndarray, pairs: int = PAIRS, steps: int = 300, rate: float = 0.05, decay: float = 1e-4, seed: int = 7, quantile: float | None = None) -> RankModel | None:
    """The Bradley-Terry fit on drawn pairs (Adam, full batches), and the border among the scores.

    quantile: the share of the labelled documents below the border; if not given, the best by the labels.
    """
    good, bad = np.nonzero(y == 1)[0], np.nonzero(y == 0)[0]
    if not len(good) or not len(bad):
        return None
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - mean) / spread, -8, 8)
    rng = np.random.default_rng(seed)
    d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        g = gradient(w, d, decay)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    s = z @ w
    order = np.argsort(s, kind="stable")
    # the quantile whose cut agrees best with the labels; both kinds weigh alike
    below_bad, below_good = np.cumsum(y[order] == 0) / len(bad), np.cumsum(y[order] == 1) / len(good)
    gain = below_bad - below_good
    gain[:-1][s[order][1:] == s[order][:-1]] = -1
    k = int(np.argmax(gain)) if quantile is None else min(len(s) - 1, max(0, int(np.ceil(quantile * len(s))) - 1))
    border = float(s[order][k] + (s[order][min(k + 1, len(s) - 1)] - s[order][k]) / 2)
    slope = 4.0 / max(1e-9, float(np.quantile(s, 0.75) - np.quantile(s, 0.25)) + float(np.median(s[y == 1]) - np.median(s[y == 0])))
    return RankModel(w, mean, spread, border, slope, (k + 1) / len(s))


def _matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts]).reshape(len(texts), len(NAMES))


def train(docs: DataFrame, labels: DataFrame, keep: Column, label: str = "quality", most: int = MOST_LABELLED, quantile: float | None = None) -> RankModel | None:
    """Fits the model on labelled documents for which `keep` (of doc_id) holds, about `most` of them; quantile: see fit."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    rows = labelled(docs, labels, label, keep, most).select("label", "text").mapInArrow(run, "label int, x array<double>").toArrow()
    if not rows.num_rows:
        return None
    x, y = np.array(rows["x"].to_pylist()), np.array(rows["label"].to_pylist())
    order = np.lexsort((*x.T, y))  # the pairs drawn must not depend on the order of the tasks
    return fit(x[order], y[order], quantile=quantile)


def score(docs: DataFrame, model: RankModel | None, carry: list[str] | None = None) -> DataFrame:
    """The columns `carry` (all of docs, if not given) with score and predicted of the whole text appended.

    Columns of docs with those two names are replaced.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    names = docs.columns if carry is None else carry
    schema = docs.select(*names).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = model.score(_matrix(batch.column("text").to_pylist())) if model else np.full(batch.num_rows, 0.5 + THRESHOLD / 2)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(got), pa.array((got >= THRESHOLD).astype(np.int32))], names=[*names, "score", "predicted"])

    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: RankModel | None) -> DataFrame:
    """The rows of docs whose score is at least THRESHOLD, with the columns that docs has.

    Only the text goes to Python, and only the score comes back.
    """
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(_matrix(texts)) if model else 1.0, index=texts.index, dtype=float)

    return docs.where(scored(F.col("text").cast("string")) >= THRESHOLD)


def op2_bradley_terry_quality(spark, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from those whose id's remainder by 4 is not 2."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, ~held_out(2, 4))
    return score(docs.select("doc_id", "text"), model, ["doc_id"]).select("doc_id", held_out(2, 4).alias("held_out"), "score", "predicted")
