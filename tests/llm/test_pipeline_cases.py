"""Each stage against a plain version of itself on whole tables, and on odd ones."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_operators import brute_components, prose
from windgrid.llm import quality, tokens, toxicity
from windgrid.llm.scratch import table


@pytest.fixture(scope="module")
def own(spark, tmp_path_factory):
    """Toxic and spoilt documents, copies, nulls, repeats and columns whose names the stages use inside."""
    rng, rows, labels = random.Random(5), [], []
    for i in range(240):
        t = prose(i, 30 + i % 40)
        kind = i % 6
        if kind == 1:
            w = t.split()
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["blockhead", "nitwit", "oaf"]))
            t = " ".join(w)
        if kind == 2:
            t = " ".join(w.upper() + "!!" for w in t.split())
        rows.append((i, t))
        labels.append((i, int(kind != 2) if i % 5 else None, int(kind == 1) if i % 7 else None))
    rows += [(1000 + i, prose(i, 30 + i % 40) + " tail") for i in range(0, 240, 6)]  # near copies of clean ones
    rows += [(2000, None), (2001, ""), (2002, " \t\n"), (None, prose(999, 50)), (None, None), (2003, prose(3, 43)), (2003, prose(3, 43)), (2004, "word " * 40_000), (2005, prose(0, 5) + " \u00e9\u4e2d"), (2006, prose(77, 50)), (2006, prose(78, 50))]
    labels += [(None, 1, 1), (5000, 0, 1), (0, 0, 1)]
    folder = tmp_path_factory.mktemp("own")
    clash = ["score", "predicted", "n", "rep", "print", "key", "kept", "again", "label", "length", "piece", "at", "__id", "p"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"concat('{c}', doc_id) as `{c}`" for c in clash])
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def key(r):
    return (r["doc_id"] is not None, r["doc_id"], r["text"] or "", r["text"] is not None)


def check_stages(spark, sf_dir):
    """Runs the stages one by one; returns what each kept."""
    docs, labels = table(spark, sf_dir, "documents").cache(), table(spark, sf_dir, "labels")
    rows = docs.collect()

    model = toxicity.train(docs, labels, ~toxicity.held_out(1, 3))
    clean = corpus_pipeline.without_toxic(spark, docs, sf_dir)
    assert clean.schema == docs.schema
    want = [r for r in rows if model.bias + sum(sorted(model.weights.get(c, 0.0) for c in toxicity.codes(r["text"]))) < np.log(0.7 / 0.3) - 1e-12]
    got = clean.collect()
    assert sorted(got, key=key) == sorted(want, key=key)

    clean = spark.createDataFrame(got, docs.schema).cache()
    rank = quality.train(clean, labels, ~toxicity.held_out(2, 4))
    good = corpus_pipeline.of_quality(spark, clean, sf_dir)
    assert good.schema == docs.schema
    if rank:
        want = []
        for r in got:
            z = np.clip((quality.features(r["text"]) - rank.mean) / rank.spread, -8, 8) @ rank.weights
            if 1 / (1 + np.exp(-np.clip(rank.slope * (z - rank.border) + np.log(0.7 / 0.3), -30, 30))) >= 0.7:
                want.append(r)
    else:
        want = got
    got = good.collect()
    assert sorted(got, key=key) == sorted(want, key=key)

    good = spark.createDataFrame(got, docs.schema).cache()
    unique = corpus_pipeline.without_near_copies(spark, good, sf_dir)
    assert unique.schema == docs.schema
    texts = {}
    for r in got:
        texts.setdefault(r["doc_id"], set()).add(r["text"] or "")
    root = brute_components([(i, min(t)) for i, t in texts.items() if len(t) == 1], percent=80) if all(len(t) == 1 for i, t in texts.items() if i is not None) else None
    got = unique.collect()
    if root is not None:
        ids = sorted(r["doc_id"] for r in got if r["doc_id"] is not None)
        assert ids == sorted({c for _, c in root.values()})
    assert len([r for r in got if r["doc_id"] is None]) == len([r for r in good.collect() if r["doc_id"] is None])

    unique = spark.createDataFrame(got, docs.schema).cache()
    packed = corpus_pipeline.packed(spark, unique, sf_dir).collect()
    encode = tokens.byte_bpe_encoder(end=2)()
    lengths = sorted(len(x) for x in encode([r["text"] for r in got]))
    spans, of_doc = {}, {}
    for r in packed:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        of_doc[r["doc_id"]] = of_doc.get(r["doc_id"], 0) + r["length"]
    assert sum(lengths) == sum(of_doc.values()) and set(of_doc) == {r["doc_id"] for r in got}
    for parts in spans.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    return got


def test_stages_on_the_tables(spark, sf):
    assert check_stages(spark, sf)


def test_stages_on_odd_rows(spark, own):
    kept = check_stages(spark, own)
    ids = {r["doc_id"] for r in kept}
    assert not any(i is not None and i < 240 and i % 6 in (1, 2) for i in ids) or len([i for i in ids if i is not None and i < 240 and i % 6 in (1, 2)]) < 8
    assert len([i for i in ids if i is not None and i < 240 and i % 6 in (0, 3, 4, 5)]) > 150
    assert not any(i is not None and 1000 <= i < 1240 and (i - 1000) in ids for i in ids if i != 1000)


def test_run_writes_what_the_stages_give(spark, own):
    first, again = (sorted(map(str, corpus_pipeline.run(spark, own).select("doc_id", "piece", "start", "length", "ids_crc32").collect())) for _ in range(2))
    assert first == again and len(first) > 100


def test_without_labels_and_without_rows(spark, own, tmp_path):
    for name, part in (("a", "true"), ("b", "false")):
        table(spark, own, "documents").where(part).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        table(spark, own, "labels").limit(0).write.parquet(f"{tmp_path}/{name}/labels.parquet")
    docs = table(spark, f"{tmp_path}/a", "documents")
    assert corpus_pipeline.of_quality(spark, docs, f"{tmp_path}/a").count() == corpus_pipeline.without_toxic(spark, docs, f"{tmp_path}/a").count() == docs.count()
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() > 100
    empty = corpus_pipeline.run(spark, f"{tmp_path}/b")
    assert empty.count() == 0 and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
