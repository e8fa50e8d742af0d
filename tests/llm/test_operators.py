"""The ten operators on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from windgrid.llm import components, hamming, id_store, language, media, near_dedup, packing, pieces, quality, tokens, toxicity, warc
from windgrid.llm.scratch import Scratch

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
#: Columns whose names the operators use inside.
CLASH = ("n", "key", "rep", "comp", "print", "score", "predicted", "ids", "pack", "place", "task", "length", "held_out", "__id")


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus():
    rows = [(i, prose(i, 40 + i % 30)) for i in range(30)]
    rows += [(100, prose(3, 43)), (101, prose(3, 43).upper()), (102, prose(3, 43) + " extra words here"), (103, None), (104, ""), (105, " \t\n "), (106, "one two"), (107, "one two"), (108, "one two three"), (109, prose(9, 6000)), (109, prose(9, 6000)), (None, prose(3, 43)), (110, "Ünïcödé 日本語 \U0001f600 'quote' 123 $5.00"), (111, "x" * 5000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), "doc_id long, text string").select("*", F.lit("en").alias("lang"), *[F.lit(1).alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# ---- 1


def brute_components(rows, percent=85, width=5):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        if i is not None:
            sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def compare_components(spark, rows, docs=None):
    docs = docs if docs is not None else spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = brute_components(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"] is False
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
            assert r["kept"] == (r["component_id"] == r["doc_id"])


def test_near_duplicates(spark, docs):
    compare_components(spark, corpus(), docs)


def versions(seed, copies, most):
    """Versions of one text with up to `most` changed words, besides short common lines."""
    rng, base = random.Random(seed), [f"w{k}" for k in range(120)]
    rows = []
    for i in range(copies):
        t = base[:]
        for _ in range(rng.randint(0, most)):
            k, what = rng.randrange(len(t)), rng.random()
            if what < 0.5:
                t[k] = f"c{rng.randrange(10**6)}"
            elif what < 0.8 and len(t) > 90:
                del t[k]
            else:
                t.insert(k, "again")
        rows.append((i, " ".join(t) + (" a common line that many of the documents share at the end" if i % 2 else "")))
    return rows


def test_crowd_of_versions(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHORT", 6)  # so that lists of runs and crowds are needed
    monkeypatch.setattr(near_dedup, "BLOCK", 40)  # and blocks
    compare_components(spark, versions(1, 150, 9))


def test_long_lists_without_crowds(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHORT", 4)
    line = " ".join(f"license{k}" for k in range(30))
    compare_components(spark, [(i, prose(1000 + i, 50) + " " + line) for i in range(60)] + [(500 + i, t) for i, t in versions(2, 40, 4)])


def test_near_duplicates_of_nothing(empty):
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.representatives(empty).columns == empty.columns


def test_representatives(spark, docs):
    kept = near_dedup.representatives(docs)
    assert kept.columns == docs.columns
    want = brute_components(corpus())
    ids = sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None)
    assert ids == sorted({c for _, c in want.values()})
    assert kept.where("doc_id is null").count() == 1


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(2))
        bits = np.bitwise_count(near_dedup._parities([near_dedup.parity(a)]) ^ near_dedup._parities([near_dedup.parity(b)])).sum()
        assert bits <= len(np.setxor1d(a, b))


def test_estimate_is_exact_for_small_sets():
    a, b = np.array([1, 3, 5, 7], dtype="<u4"), np.array([3, 4, 5], dtype="<u4")
    assert near_dedup.estimate(a, b) == (2, 5) and near_dedup.estimate(a[:0], b[:0]) == (0, 0)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = components.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "cc"), "t").collect()
    groups = {}
    for r in got:
        groups.setdefault(r["comp"], set()).add(r["node"])
    assert sorted(map(sorted, groups.values())) == [list(range(41)), list(range(100, 130)), [200, 201]]


# ---- 2, 3, 6


def labelled(spark, bad, n=240):
    rows, labels = [], []
    for i in range(n):
        text, label = prose(i, 80), int(i % 3 == 0)
        rows.append((i, bad(text, random.Random(i)) if label else text, "en"))
        labels.append((i, 1 - label, label))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(got, want):
    return np.mean([r["predicted"] == want(r["doc_id"]) for r in got])


def test_toxicity(spark, docs, empty):
    def insult(text, rng):
        w = text.split()
        for _ in range(3):
            w.insert(rng.randrange(len(w)), rng.choice(["blockhead", "Nitwit!", "oaf,"]))
        return " ".join(w)

    d, labels = labelled(spark, insult)
    model = toxicity.train(d, labels, ~toxicity.held_out(1, 3))
    got = toxicity.score(d, model).collect()
    assert accuracy([r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1], lambda i: int(i % 3 == 0)) > 0.95
    odd = toxicity.score(docs, model)
    assert odd.count() == docs.count() and set(odd.columns) == set(docs.columns) and odd.where("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.accepted(docs, model).columns == docs.columns
    for none in (labels.limit(0), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert toxicity.score(d, toxicity.train(d, none, ~toxicity.held_out(1, 3))).where("predicted = 1").count() == 0
    assert toxicity.train(empty, labels, F.lit(True)).weights == {}


def test_risk_is_never_negative_of_use():
    rng = np.random.default_rng(0)
    p = [np.sort(np.append(rng.integers(10, 60, 5), [1])).astype(np.uint32) for _ in range(40)]
    u = [np.sort(rng.integers(10, 60, 6)).astype(np.uint32) for _ in range(200)] + p[:20]
    w, _ = toxicity.fit(p, u, 0.1)
    assert max(w, key=w.get) == 1


def test_quality(spark, docs, empty):
    d, labels = labelled(spark, lambda t, rng: " ".join(w.upper() + "!!" for w in t.split()))
    model = quality.train(d, labels, ~toxicity.held_out(2, 4))
    got = quality.score(d, model).collect()
    assert accuracy([r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2], lambda i: int(i % 3 != 0)) > 0.95
    odd = quality.score(docs, model)
    assert odd.count() == docs.count() and odd.where("score < 0 or score > 1 or score is null or isnan(score)").count() == 0
    assert quality.score(empty, model).count() == 0 and quality.accepted(docs, model).columns == docs.columns
    one_kind = labels.withColumn("quality", F.lit(1))
    assert quality.train(d, one_kind, F.lit(True)) is None and quality.accepted(d, None).count() == d.count()


def test_language(spark, docs, empty):
    texts = {"en": "the house and the garden with flowers near the river this morning", "de": "das haus und der garten mit blumen an dem fluss heute morgen schön", "fr": "la maison et le jardin avec des fleurs près de la rivière ce matin"}
    rows = []
    for i in range(180):
        lang = list(texts)[i % 3]
        w = texts[lang].split()
        random.Random(i).shuffle(w)
        rows.append((i, " ".join(w), lang if i % 10 else None))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(d, ~toxicity.held_out(1, 3))
    got = {r["doc_id"]: r for r in language.predict(d, model).collect()}
    assert all(got[i]["lang_pred"] == list(texts)[i % 3] for i in range(180)) and all(0 <= r["score"] <= 1 for r in got.values())
    odd = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs.where("doc_id between 103 and 106"), model).collect()}
    assert odd[103] == odd[104] == odd[105] == "und" and odd[106] != "und"
    assert language.predict(empty, model).count() == 0
    assert language.train(empty, F.lit(True)) is None
    assert {r["lang_pred"] for r in language.predict(d, None).collect()} == {"und"}
    words = language.codewords(4)
    assert min((words[a] != words[b]).sum() for a in range(4) for b in range(a)) >= 12


def test_language_sample(spark, monkeypatch):
    """The bound counts usable rows only, and rare languages are learnt, however many documents there are."""
    texts = {"en": "the house and the garden near the river", "de": "das haus und der garten an dem fluss", "fr": "la maison et le jardin de la ville"}
    rows = [(i, texts["en" if i % 2 else "de"], ("en" if i % 2 else "de") if i < 900 else None) for i in range(4000)] + [(5000, texts["fr"], "fr")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen, fit = [], language.fit
    monkeypatch.setattr(language, "MOST_TEXTS", 300)
    monkeypatch.setattr(language, "fit", lambda x, y: seen.append(y) or fit(x, y))
    model = language.train(d, F.lit(True))
    assert model.languages == ["de", "en", "fr"] and 240 <= len(seen[0]) <= 360 and abs(seen[0].count("en") - 150) < 50
    assert {r["lang_pred"] for r in language.predict(d.where("doc_id = 5000"), model).collect()} == {"fr"}
    monkeypatch.setattr(language, "MOST_TEXTS", 901)
    assert len(language.train(d, F.lit(True)).languages) == 3 and len(seen[1]) == 901
    one_id = d.where("lang is not null").withColumn("doc_id", F.when(F.col("lang") == "de", 7).otherwise(F.col("doc_id")))
    monkeypatch.setattr(language, "MOST_TEXTS", 60)
    assert language.train(one_id, F.lit(True)).languages == ["de", "en", "fr"]
    assert language.shares({"a": 1, "b": 50, "c": 10**9}, 100) == {"a": 1, "b": 49, "c": 50}


# ---- 4


def test_id_store(spark, docs, empty):
    library = tokens._library("word_bpe_49k.json")
    store = id_store.IdStore(Scratch(spark, "t"))
    store.write(docs, tokens.word_bpe_encoder(end=1))
    got = store.read().join(store.manifest().select("pack", F.col("start").alias("base")), "pack").collect()
    assert len(got) == docs.count()
    want, start = {}, 0
    for i, t in sorted(corpus(), key=lambda r: (r[0] is not None, r[0])):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        want.setdefault(i, []).append((start, np.array(ids, "<u4").tobytes()))
        start += len(ids)
    for r in got:
        assert (r["base"] + r["begin"], bytes(r["ids"])) in want[r["doc_id"]]
    assert store._stored("shared").select("names").distinct().count() == store._stored("shared").count() > 0
    none = id_store.IdStore(Scratch(spark, "t"))
    none.write(empty, tokens.word_bpe_encoder(end=1))
    assert none.read().count() == 0


def test_damage_is_found(spark):
    store = id_store.IdStore(Scratch(spark, "t"))
    store.write(spark.createDataFrame([(1, prose(1, 400)), (2, prose(2, 300))], "doc_id long, text string"), tokens.word_bpe_encoder(end=1))
    bad = store._stored("packs").withColumn("names", F.expr("concat(X'00', substring(names, 2))")).where("doc_id = 1")
    keep = store._stored("packs").where("doc_id = 2").unionByName(store._stored("manifest")).unionByName(bad)
    moved = id_store.IdStore(Scratch(spark, "t"))
    keep.write.partitionBy("kind").parquet(moved.scratch.path("store"))
    with pytest.raises(ValueError):
        moved.verify()
    with pytest.raises(Exception, match="not what its name says"):
        moved.read(verify=False).collect()


def test_boundaries_follow_the_content():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 49000, 20_000).astype(np.uint32)
    shifted = np.concatenate([rng.integers(0, 49000, 777).astype(np.uint32), a])
    x, y = id_store.boundaries(a), id_store.boundaries(shifted)
    assert x[-1] == len(a) and len({e + 777 for e in x} & set(y)) > len(x) * 0.8
    assert max(np.diff([0, *x])) <= id_store.LARGEST and id_store.boundaries(a[:0]) == []


def test_encoders():
    rng = random.Random(4)
    letters = "".join(map(chr, range(0, 0x180))) + "日é́İſΣς…“” ​\U0001f600½²" + "abcdefg   '''sstdll..,," * 6
    texts = ["", " ", "<|endoftext|> x", "it's we'll '", "a.b ,c .d"] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(2000)]
    for own, name in ((tokens.word_bpe_encoder(), "word_bpe_49k.json"), (tokens.byte_bpe_encoder(), "byte_bpe_50k.json")):
        library = tokens._library(name)
        for t, ids in zip(texts, own()(texts), strict=True):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)
    assert tokens.byte_bpe_encoder(end=2)()([None])[0].tolist() == [2]


# ---- 5


def png():
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def test_sniffing():
    import gzip
    import io
    import zipfile

    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a", "b" * 100)
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"," + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00;"
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xda" + struct.pack(">H", 4) + b"cd" + b"\x12\xff\x00\x34" + b"\xff\xd9"
    pdf = b"%PDF-1.4\nx\nstartxref\n0\n%%EOF"
    bmp = b"BM" + struct.pack("<IIII", 58, 0, 54, 40) + b"\0" * 40
    whole = {"audio/wav": media.to_wave(b"abc"), "image/png": png(), "image/gif": gif, "image/jpeg": jpeg, "application/gzip": gzip.compress(b"hello" * 50), "application/zip": z.getvalue(), "application/pdf": pdf, "image/bmp": bmp}
    for kind, raw in whole.items():
        assert media.sniff(raw) == (kind, len(raw), []), kind
        assert media.sniff(raw[:-1])[0] != kind or kind == "audio/wav", kind
        assert media.sniff(b"text " + raw + b" more")[2] == [(kind, 5, len(raw))], kind
    assert media.sniff(None) == media.sniff(b"") == (media.UNKNOWN, 0, [])
    assert media.sniff(b"RIFF and PK\x03\x04 and BM in a text")[2] == []
    assert media.wave_samples(media.to_wave(b"abc")) == b"abc" and media.feature(b"") == "n=0"


def test_media_round_trip(spark, docs, empty):
    got = {(r["doc_id"], r["n_bytes"]): r for r in media.media_digests(media.text_media(docs)).collect()}
    for i, t in corpus():
        raw = (t or "").encode()
        size = max(1, -(-len(raw) // 576)) * 576
        r, payload = got[i, len(raw)], raw + b"\xff" * (size - len(raw))
        stored = media.to_wave(payload)
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (size, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"], r["feature"], r["corrected"]) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload), True)
    assert media.media_digests(media.text_media(empty)).count() == 0
    blobs = spark.createDataFrame([(1, png(), "image/gif"), (2, None, None), (3, b"plain" + png(), "text/plain")], "id int, blob binary, said string")
    rows = {r["id"]: r for r in media.sniffed(blobs, "blob", "said").collect()}
    assert rows[1]["true_type"] == "image/png" and rows[1]["corrected"] and rows[3]["carved"][0]["offset"] == 5 and rows[2]["true_bytes"] == 0


# ---- 7


def test_pieces_against_the_library(docs, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary("piece_bpe_32k.model"))
    own = pieces.loaded(tokens.vocabulary("piece_bpe_32k.model"))
    rng = random.Random(7)
    letters = "aeiounrstlhdmcfp  \n.,!?#$%éüßñ0123456789'\"()-<>_▁日本語中文русский한국어\U0001f600́​\xa0"
    texts = ["", " ", "a\0b", "  a  b ", "\t\n", "<s>hi</s>", "▁a", " " * 37, "x" + " " * 100 + "y", "ab" * 3000]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(rng.choice(own.model.pieces[259:]).replace("▁", " ") for _ in range(rng.randint(0, 12))) for _ in range(1000)]
    for t in texts:
        ids = library.encode(t)
        assert own.encode(t) == ids, repr(t)
        assert own.decode(ids) == library.decode(ids), repr(t)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3)]) for _ in range(rng.randint(0, 10))]
        assert own.decode(ids) == library.decode(ids), ids
    got = pieces.encode_pieces(docs).collect()
    assert len(got) == docs.count() and all(r["ids"] == library.encode(r2 or "") for r, r2 in ((r, dict(((i, t) for i, t in corpus() if i is not None)).get(r["doc_id"], prose(3, 43))) for r in got))
    assert pieces.digest_pieces(empty).count() == 0


# ---- 8


def test_hamming_search(spark):
    rng = np.random.default_rng(0)
    codes = np.concatenate([rng.integers(-(2**62), 2**62, 300), np.repeat(rng.integers(0, 2**40), 40), np.array([0, -1, 1])])
    codes[50:90] = codes[0] ^ (1 << rng.integers(0, 60, 40))
    rows = [(i, int(c)) for i, c in enumerate(codes)] + [(None, 5), (999, None), (7, int(codes[7]))]
    r = spark.createDataFrame(rows, "id long, code long").withColumn("rank", F.lit(0))
    got = {}
    for x in hamming.top_k(r.drop("rank"), r.where("id % 9 = 0").select(F.col("id").alias("query_id"), "code"), 6).collect():
        got.setdefault(x["query_id"], []).append((x["rank"], x["distance"], x["id"]))
    known = [(i, c) for i, c in rows if i is not None and c is not None]
    for q, c in known:
        if q % 9 == 0:
            want = sorted((((c ^ c2) & (2**64 - 1)).bit_count(), i) for i, c2 in known)[:6]
            assert [x[1:] for x in sorted(got[q])] == want
    assert hamming.top_k(r.limit(0).drop("rank"), r.limit(0).select(F.col("id").alias("query_id"), "code")).count() == 0
    vectors = spark.createDataFrame([([1.0] * 64,), ([1.0] * 63,), ([None] + [1.0] * 63,), (None,)], "embedding array<double>")
    assert [x[0] for x in vectors.select(F.expr(hamming.sign_code("embedding"))).collect()] == [-1, None, None, None]


# ---- 9


def test_packing(spark, docs, empty):
    library = tokens._library("byte_bpe_50k.json")
    got = packing.pack(docs, tokens.byte_bpe_encoder(end=2), 64).collect()
    want = sorted((i is not None, i, np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in corpus())
    for r in got:
        assert r["length"] <= 64 and len(r["ids"]) == 4 * r["length"]
    ids = sorted(bytes(r["ids"]) for r in got)
    cut = []
    for _, _, raw in want:
        n = len(raw) // 4
        ends = list(range(n % 64 or 64, n + 1, 64))
        cut += [raw[4 * a : 4 * b] for a, b in zip([0, *ends], ends, strict=False)]
    assert ids == sorted(cut)
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(empty, tokens.byte_bpe_encoder(end=2)).count() == 0
    seqs = packing.sequences(packing.pack(docs, tokens.byte_bpe_encoder(end=2), 64)).collect()
    assert sum(s["n_tokens"] for s in seqs) == sum(len(x) for x in cut) // 4 and all(len(s["ids"]) == 4 * s["n_tokens"] for s in seqs)


def fewest(counts, capacity):
    """Sequences needed, by trying all partitions of a few pieces."""
    items = sorted((n for n, c in enumerate(counts) for _ in range(c)), reverse=True)
    best = [len(items)]

    def put(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: k for k, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= capacity:
                put(i + 1, (*bins[:k], bins[k] + items[i], *bins[k + 1 :]))
        put(i + 1, (*bins, items[i]))

    put(0, ())
    return best[0]


def test_bin_completion_is_near_the_optimum():
    rng = np.random.default_rng(5)
    over = 0
    for _ in range(60):
        counts = np.zeros(21, dtype=np.int64)
        for n in rng.integers(1, 21, 9):
            counts[n] += 1
        found = packing.solve(counts, 20)
        used = np.zeros_like(counts)
        for f in found:
            assert sum(n * k for n, k in f.parts) <= 20
            for n, k in f.parts:
                used[n] += k * f.times
        assert (used == counts).all()
        over += sum(f.times for f in found) - fewest(counts, 20)
    assert over <= 3
    assert packing.complete(np.array([0, 0, 0, 2, 2, 0, 1]), 6, 10) == [(6, 1), (4, 1)]


# ---- 10


def test_warc(spark):
    big, other = "<p>" + "x" * 1500, "y" * 999
    rows = [(1, "http://a.example/1", big), (5, "https://www.a.example:8443/1?Q=2", big), (3, None, big), (2, "http://b.example", other), (4, "http://b.example/ä b\n", other), (6, "bad:[url", None), (7, "http://c.example", ""), (None, "http://n.example", big), (8, "http://u.example", "é" * 700), (9, "http://r.example", "z" * 1200), (9, "http://r.example", "z" * 1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("digest"), F.lit(2).alias("archive"))
    scratch = Scratch(spark, "t")
    archives = warc.write(pages, scratch)
    got = warc.merged(warc.captures(archives)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], []).append((r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]))
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    assert by[1] == [(1503, sha(big), "revisit", 5)] and by[3] == [(1503, sha(big), "revisit", 5)] and by[5] == [(1503, sha(big), "response", None)]
    assert by[None] == [(1503, sha(big), "revisit", 5)] and by[2] == [(999, sha(other), "response", None)] == by[4]
    assert by[6] == by[7] == [(0, sha(""), "response", None)] and by[8] == [(1400, sha("é" * 700), "response", None)]
    assert by[9] == [(1200, sha("z" * 1200), "response", None)] * 2
    order = [(r["url_key"], r["captured"], -1 if r["page_id"] is None else r["page_id"]) for r in got]
    assert order == sorted(order)
    assert warc.merged(warc.captures(warc.write(pages.limit(0), Scratch(spark, "t")))).count() == 0
    assert warc.url_key("http://www.Example.com/A?B=C") == "com,example)/a?b=c"


def test_loser_tree():
    rng = random.Random(3)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted((rng.randrange(50), i) for i in range(rng.randrange(20))) for _ in range(k)]
        got = [x[1] for x in warc.LoserTree([iter([((v,), v) for v, _ in r]) for r in runs])]
        assert got == sorted(v for r in runs for v, _ in r)


def test_damaged_archive():
    raw = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = raw.compress(warc.record(1, "http://a.example", b"x" * 2000, hashlib.sha1(b"x" * 2000).hexdigest(), None)) + raw.flush()
    assert [s for _, s, _ in warc.members(data * 3)] == [len(data)] * 3
    with pytest.raises(ValueError):
        list(warc.members(data[:-3]))
