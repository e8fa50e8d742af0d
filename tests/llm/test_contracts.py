"""The registered queries on whole tables: SQL where there is some, the libraries themselves elsewhere."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

from windgrid.llm import tokens
from windgrid.llm.queries import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rel = duck.execute(ORACLE[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    want = sorted(str([r[names.index(c)] for c in columns]) for r in rel.fetchall())
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == want


@pytest.fixture(scope="module")
def texts(duck):
    return duck.execute("select doc_id, coalesce(text, '') from documents order by doc_id").fetchall()


def test_stored_ids(spark, sf, texts):
    library, start = tokens._library("word_bpe_49k.json"), 0
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op4_content_addressed_ids"](spark, sf).collect()}
    for i, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids + [1]
        assert got[i] == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(texts)


def test_pieces(spark, sf, texts):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary("piece_bpe_32k.model"))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in QUERIES["op7_sentencepiece_backtracking"](spark, sf).collect()}
    for i, t in texts:
        ids = library.encode(t)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_packed(spark, sf, texts):
    library, got, places = tokens._library("byte_bpe_50k.json"), {}, {}
    for r in QUERIES["op9_best_fit_packing"](spark, sf).collect():
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    tokens_in_all = 0
    for i, t in texts:
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [2], "<u4")
        tokens_in_all += len(ids)
        ends = list(range(len(ids) % 1024 or 1024, len(ids) + 1, 1024))
        assert sorted(got[i]) == [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]
    for spans in places.values():
        assert [o for o, _ in sorted(spans)] == np.cumsum([0, *(n for _, n in sorted(spans))])[:-1].tolist() and sum(n for _, n in spans) <= 1024
    assert len(places) <= -(-tokens_in_all // 1024) * 1.02 + 1


@pytest.mark.parametrize(("name", "remainder", "folds", "extra"), [("op2_bradley_terry_quality", 2, 4, "predicted"), ("op6_pu_toxicity", 1, 3, "predicted"), ("op3_ecoc_language", 1, 3, "lang_pred")])
def test_scores(spark, sf, texts, name, remainder, folds, extra):
    rows = QUERIES[name](spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == [i for i, _ in texts]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % folds == remainder) and 0 <= r["score"] <= 1
        assert extra != "predicted" or r["predicted"] == int(r["score"] >= 0.7)
