"""Letters, decoding and held-out accuracy of language identification."""

import numpy as np
import pytest

from windgrid.llm import language
from windgrid.llm.queries import QUERIES
from windgrid.llm.scratch import table


@pytest.mark.parametrize(("text", "there"), [(None, False), ("", False), ("12 ...", False), ("\u00bd \u00b2", False), ("\u2167 \u3007", False), ("_\u0301", False), ("\u4e2d", True), ("\u00bd a", True), ("\u02b0", True), ("1\u00df", True)])
def test_letters(spark, text, there):
    assert language.has_letter(text) == there
    model = language.fit(np.eye(2, language.DIMENSIONS, dtype=np.float32), ["en", "de"])
    row = language.predict(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()
    assert (row["lang_pred"] == "und") == (not there) and (there or row["score"] == 0 and row["ambiguous"])


def test_decoding_against_a_plain_version():
    rng = np.random.default_rng(2)
    words, w, b = language.codewords(5), rng.normal(size=(7, language.BITS)), rng.normal(size=language.BITS)
    trust = rng.random((5, language.BITS))
    model = language.CodeModel(list("abcde"), words, w, b, trust / trust.sum(axis=1, keepdims=True), 4.0)
    x = rng.normal(size=(30, 7))
    best, score, odd = model.decode(x)
    for i in range(30):
        margins = [sum(x[i, d] * w[d, k] for d in range(7)) + b[k] for k in range(language.BITS)]
        losses = [4.0 * sum(model.trust[c, k] * np.log1p(np.exp(-margins[k] * words[c, k])) for k in range(language.BITS)) for c in range(5)]
        p = np.exp(-np.array(losses)) / np.exp(-np.array(losses)).sum()
        assert best[i] == p.argmax() and score[i] == pytest.approx(p.max()) and odd[i] == (np.sort(p)[-2] >= language.AMBIGUOUS)


def test_equal_losses_go_to_the_first_language():
    words = np.ones((3, language.BITS), dtype=int)
    model = language.CodeModel(["a", "b", "c"], words, np.zeros((2, language.BITS)), np.zeros(language.BITS), np.ones((3, language.BITS)) / language.BITS, 4.0)
    assert model.decode(np.ones((1, 2)))[0].tolist() == [0]


def test_shares_of_many_documents():
    counts = {"en": 10**11, "de": 10**6, "xx": 3}
    got = language.shares(counts, 4_000)
    assert got["xx"] == 3 and got["de"] > 1900 and got["en"] > 1900
    assert all(language.STEPS * n // counts[lang] > 0 for lang, n in got.items())


def test_held_out_texts_of_the_tables(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang").where("lang is not null")
    rows = QUERIES["op3_ecoc_language"](spark, sf).join(docs, "doc_id").where("held_out and lang_pred <> 'und'").select("lang", "lang_pred").collect()
    assert len(rows) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
