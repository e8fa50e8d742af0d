"""Language identification by error-correcting output codes.

Every language is given a codeword of BITS bits, any two of them far apart. One binary classifier per bit,
linear in the shares of byte n-grams, predicts that bit of a text's language. Decoding weighs each bit's
loss by how well its classifier does on each language and takes the codeword with the least total, so a few
wrong bits change nothing. A text whose two nearest codewords are almost as near as each other is flagged.

Defined cases: a null text and one without a letter (Unicode's L categories; numerals such as one half are
none) are `und`, with score 0 and flagged; of codewords at equal loss the language first in order is taken; a null lang or
doc_id is never trained on; repeated rows are predicted alike; with no languages to learn every text is
`und`; with one, every text with a letter is that; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from windgrid.llm.sampling import STEPS
from windgrid.llm.scratch import bounded_batches, table
from windgrid.llm.toxicity import held_out

#: Texts in the sample for the fit, and those that a language may have even if the languages are so many that this makes more.
MOST_TEXTS, LEAST_TEXTS = 4_000, 16
DIMENSIONS, BITS = 4096, 31
#: Softmax share of the second codeword from which a text is ambiguous.
AMBIGUOUS = 0.25
UNKNOWN = "und"

_PLAIN_LETTER = re.compile("[A-Za-z]")
_PIECE = 1 << 20


def ngram_shares(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 1-, 2- and 3-grams of the lower-cased UTF-8 bytes.

    Everything but letters counts as one space; long texts are counted piece by piece.
    """
    raw = np.frombuffer(text.lower().encode("utf-8", "replace"), dtype=np.uint8)
    total = np.zeros(DIMENSIONS)
    for at in range(0, len(raw), _PIECE):
        b = raw[max(0, at - 2) : at + _PIECE].astype(np.uint32)
        b = np.where((b >= 97) & (b < 123) | (b >= 128), b, 32)
        b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))]
        for k in (1, 2, 3):
            if len(b) >= k:
                code = np.full(len(b) - k + 1, k, dtype=np.uint32)
                for j in range(k):
                    code = code * np.uint32(257) + b[j : j + len(code)]
                total += np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    return np.sqrt(total / max(1.0, total.sum()))


def has_letter(text: str | None) -> bool:
    return bool(text) and (_PLAIN_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def codewords(count: int, bits: int = BITS, seed: int = 5) -> np.ndarray:
    """`count` words of +1 and -1, each bit splitting the languages, drawn to be far apart."""
    rng = np.random.default_rng(seed)
    best, apart = None, -1
    for _ in range(200):
        words = rng.choice([-1, 1], (count, bits))
        if count > 1:
            flat = np.abs(words.sum(axis=0)) == count  # a bit that is the same for all says nothing
            words[rng.integers(count, size=flat.sum()), np.nonzero(flat)[0]] *= -1
        d = (words[:, None] != words[None]).sum(axis=2) + np.eye(count, dtype=int) * bits
        if d.min() > apart:
            best, apart = words, int(d.min())
    return best


@dataclass(frozen=True)
class CodeModel:
    languages: list[str]
    words: np.ndarray  # languages x bits
    weights: np.ndarray  # dimensions x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits, rows sum to 1
    sharpness: float

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language places, scores, flags of ambiguity."""
        margins = x @ self.weights + self.bias
        losses = np.logaddexp(0, -margins[:, None, :] * self.words[None])
        total = -self.sharpness * (losses * self.trust[None]).sum(axis=2)
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        second = np.sort(p, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
        return best, p[np.arange(len(p)), best], second >= AMBIGUOUS


def fit(x: np.ndarray, y: list[str], steps: int = 100, rate: float = 0.5, decay: float = 1e-5) -> CodeModel:
    """One logistic classifier per bit, all at once (Adam, full batches); languages weigh alike."""
    languages = sorted(set(y))
    place = {s: k for k, s in enumerate(languages)}
    at = np.array([place[s] for s in y])
    words = codewords(len(languages))
    share = np.bincount(at, minlength=len(languages))
    weight = ((1 / share)[at] / len(languages)).astype(np.float32)
    target = words[at].astype(np.float32)
    w, b = np.zeros((x.shape[1], BITS), dtype=np.float32), np.zeros(BITS, dtype=np.float32)
    m, v = np.zeros((x.shape[1] + 1, BITS), dtype=np.float32), np.zeros((x.shape[1] + 1, BITS), dtype=np.float32)
    for t in range(1, steps + 1):
        lost = 1 / (1 + np.exp(np.clip((x @ w + b) * target, -30, 30)))
        g = -(weight[:, None] * lost * target)
        g = np.vstack([x.T @ g + decay * w, g.sum(axis=0)])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = np.float32(rate) * (m / np.float32(1 - 0.9**t)) / (np.sqrt(v / np.float32(1 - 0.999**t)) + np.float32(1e-8))
        w -= step[:-1]
        b -= step[-1]
    right = ((x @ w + b) * target > 0).astype(float)
    trust = np.array([right[at == k].mean(axis=0) for k in range(len(languages))]) + 1e-6
    trust /= trust.sum(axis=1, keepdims=True)
    return CodeModel(languages, words, w.astype(np.float32), b, trust, sharpness=4.0)


def _matrix(texts: list) -> np.ndarray:
    return np.array([ngram_shares(t) for t in texts], dtype=np.float32).reshape(len(texts), DIMENSIONS)


def shares(counts: dict[str, int], most: int) -> dict[str, int]:
    """Texts of each language for the fit: as evenly as the counts allow, `most` together."""
    out, left = {}, most
    for k, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[lang] = min(n, max(LEAST_TEXTS, left // (len(counts) - k)))
        left -= out[lang]
    return out


def sample(known: DataFrame, most: int) -> DataFrame:
    """lang, text of about `most` rows of known (doc_id, lang, text), by a hash of the id; of every language at least one."""
    spark = known.sparkSession
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if sum(counts.values()) <= most:
        return known.select("lang", "text")
    bounds = [(lang, STEPS * n // counts[lang]) for lang, n in shares(counts, most).items()]
    rows = known.join(F.broadcast(spark.createDataFrame(bounds, "lang string, bound long")), "lang")
    rows = rows.where(F.shiftrightunsigned(F.xxhash64(F.lit("sample"), "doc_id"), 2) < F.col("bound")).select("lang", "text")
    missed = sorted(set(counts) - {r["lang"] for r in rows.select("lang").distinct().collect()})
    if missed:  # by chance, or as its rows share one id
        rows = rows.unionByName(known.where(F.col("lang").isin(missed)).groupBy("lang").agg(F.min("text").alias("text")))
    return rows


def train(docs: DataFrame, keep: Column, most: int | None = None) -> CodeModel | None:
    """Fits the model on documents with a language for which `keep` (of doc_id) holds; every language among them is learnt.

    most: texts in the sample for the fit, MOST_TEXTS if not given (LEAST_TEXTS of every language that has them, even beyond that).
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                x = _matrix(batch.column("text").slice(k, 256).to_pylist()).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(k, 256), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull()).where(keep)
    rows = sample(known, MOST_TEXTS if most is None else most).mapInArrow(run, "lang string, x binary").toArrow()
    if not rows.num_rows:
        return None
    return fit(np.array([np.frombuffer(x.as_py(), dtype=np.float16) for x in rows["x"]]).astype(np.float32), rows["lang"].to_pylist())


def predict(docs: DataFrame, model: CodeModel | None) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for docs (doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                texts = batch.column("text").slice(k, 256).to_pylist()
                there = [i for i, t in enumerate(texts) if model and has_letter(t)]
                lang, score, odd = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if there:
                    for i, b, s, a in zip(there, *model.decode(_matrix([texts[i] for i in there])), strict=True):
                        lang[i], score[i], odd[i] = model.languages[b], float(s), bool(a)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, 256), pa.array(lang), pa.array(score, pa.float64()), pa.array(odd)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean")


def op3_ecoc_language(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt from those whose id's remainder by 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out(1, 3))
    return predict(docs, model).select("doc_id", held_out(1, 3).alias("held_out"), "lang_pred", "score", "ambiguous")
