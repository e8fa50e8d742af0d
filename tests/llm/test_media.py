"""The media query through its stored file against a plain version, and validators on odd files."""

import hashlib
import io
import struct
import time
import zipfile
import zlib

import duckdb
import pytest

from windgrid.llm import media
from windgrid.llm.queries import QUERIES
from windgrid.llm.scratch import Scratch


def test_stored_media(spark, sf):
    rows = duckdb.sql(f"select doc_id, coalesce(text, '') from '{sf}/documents.parquet'").fetchall()
    got = {r["doc_id"]: r for r in QUERIES["op5_signature_sniffing"](spark, sf).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        raw = t.encode()
        payload = raw + b"\xff" * ((-len(raw)) % 576 or (0 if raw else 576))
        wave = b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-32:]), len(wave), hashlib.sha256(wave).hexdigest())
        x = [b - 128 for b in payload]
        assert r["feature"] == f"n={len(x)};ms={len(x) // 8};sum={sum(x)};energy={sum(v * v for v in x)};crossings={sum((a < 0) != (b < 0) for a, b in zip(x, x[1:], strict=False))};low={min(x)};high={max(x)}"
        assert r["true_type"] == "audio/wav" and r["corrected"]


def test_damage_of_the_stored_file_is_found(spark):
    docs = spark.createDataFrame([(1, "some text RIFF PK\x03\x04"), (None, None)], "doc_id long, text string")
    stored = Scratch(spark, "t").save(media.text_media(docs), "media")
    assert media.media_digests(stored).count() == 2
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="carved"):
        media.media_digests(stored.withColumn("blob", F.expr("substring(blob, 1, octet_length(blob) - 1)"))).collect()


def test_jpeg_with_fill_bytes_and_scans():
    def scan(data):
        return b"\xff\xda\x00\x04ab" + data

    raw = b"\xff\xd8\xff\xff\xff\xe0\x00\x06abcd" + scan(b"12\xff\x00\xff\xd334\xff") + b"\xff\xff\xc4\x00\x03z" + scan(b"5\xff\xff\xd9")
    assert media.sniff(raw) == ("image/jpeg", len(raw), [])
    assert media.sniff(raw[:-1])[0] == media.UNKNOWN


def test_archives_in_archives():
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("a", b"x" * 100)
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr("inner.zip", inner.getvalue())
        z.writestr("b", b"y")
    two = b"head" + outer.getvalue() + b"between" + inner.getvalue()
    assert media.sniff(two)[2] == [("application/zip", 4, len(outer.getvalue())), ("application/zip", 11 + len(outer.getvalue()), len(inner.getvalue()))]


def test_many_headers_are_read_once():
    began = time.time()
    assert media.sniff(b"PK\x03\x04" * 200_000)[2] == []
    assert media.sniff((b"PK\x03\x04" * 50 + b"PK\x05\x06" + b"\xee" * 18) * 2_000)[2] == []
    assert time.time() - began < 20
