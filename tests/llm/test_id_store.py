"""Packs by tokens, the tree over them, and what the root of a store gives away."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import prose
from windgrid.llm import id_store, tokens
from windgrid.llm.scratch import Scratch


@pytest.fixture(scope="module")
def texts():
    return [(i, prose(i % 50, 200 + 13 * (i % 7))) for i in range(120)] + [(None, "x"), (None, None), (300, prose(1, 9000))]


def plain_tree(roots, fan):
    level = roots or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\2" + b"".join(level[k : k + fan])).digest() for k in range(0, len(level), fan)]
    return level[0].hex()


def moved(spark, store, kinds):
    """A copy of a store with other rows of some kinds."""
    out = id_store.IdStore(Scratch(spark, "t"))
    rows = [kinds.get(k, lambda d: d)(store._stored(k)) for k in ("packs", "shared", "manifest")]
    rows[0].unionByName(rows[1]).unionByName(rows[2]).write.partitionBy("kind").parquet(out.scratch.path("store"))
    out.scratch.save(store.scratch.read("root", spark.createDataFrame([], id_store.ROOT)), "root")
    return out


def test_packs_and_tree(spark, texts, monkeypatch):
    monkeypatch.setattr(id_store, "PACK_TOKENS", 3000)
    monkeypatch.setattr(id_store, "FAN", 3)
    store = id_store.IdStore(Scratch(spark, "t"))
    store.write(spark.createDataFrame(texts, "doc_id long, text string"), tokens.word_bpe_encoder(end=1))
    manifest = sorted(store.manifest().collect(), key=lambda r: r["pack"])
    assert len(manifest) > 9 and all(r["n_tokens"] <= 3000 or r["documents"] == 1 for r in manifest)
    documents, n, packs, root = store.root()
    assert (documents, packs) == (len(texts), len(manifest)) and n == sum(r["n_tokens"] for r in manifest)
    assert root == plain_tree([bytes(r["root"]) for r in manifest], 3)
    rows = sorted(store._stored("packs").collect(), key=lambda r: (r["pack"], r["place"]))
    assert [r["doc_id"] for r in rows] == sorted((i for i, _ in texts), key=lambda i: (i is not None, i))
    assert all(bytes(r["leaf"]) == id_store.leaf(r["doc_id"], bytes(r["names"]), r["n_tokens"]) for r in rows)
    store.verify()

    a, b = 3, 4  # two documents that change ids
    swap = F.when(F.col("doc_id") == a, b).when(F.col("doc_id") == b, a).otherwise(F.col("doc_id"))
    lost = manifest[2]["pack"]
    for kinds in (
        {"packs": lambda d: d.withColumn("doc_id", swap.cast("long"))},
        {"packs": lambda d: d.where(F.col("pack") != lost), "manifest": lambda d: d.where(F.col("pack") != lost)},
        {"manifest": lambda d: d.where(F.col("pack") != lost)},
    ):
        with pytest.raises(ValueError):
            moved(spark, store, kinds).verify()
    moved(spark, store, {}).verify()


def test_empty_store(spark):
    store = id_store.IdStore(Scratch(spark, "t"))
    store.write(spark.createDataFrame([], "doc_id long, text string"), tokens.word_bpe_encoder(end=1))
    assert store.root() == (0, 0, 0, hashlib.sha256(b"").hexdigest()) and store.read().count() == 0


def test_ids_that_do_not_fit(spark):
    store = id_store.IdStore(Scratch(spark, "t"))
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    with pytest.raises(Exception, match="does not fit"):
        store.write(docs, lambda: lambda texts: [np.array([70_000], dtype=np.uint32) for _ in texts])
    wide = id_store.IdStore(Scratch(spark, "t"), "<u4")
    wide.write(docs, lambda: lambda texts: [np.array([70_000], dtype=np.uint32) for _ in texts])
    assert bytes(wide.read().first()["ids"]) == (70_000).to_bytes(4, "little")
