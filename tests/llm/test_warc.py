"""Archives as files, and records read at the places that the merged index names."""

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from windgrid.llm import warc
from windgrid.llm.scratch import Scratch


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h{i % 7}.example/{i}", f"<p>{i % 11}" + "x" * (900 + 40 * (i % 11))) for i in range(200)] + [(None, None, None), (500, "http://z.example", "")]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def stored(spark, pages):
    scratch = Scratch(spark, "t")
    archives = warc.write(pages, scratch)
    return archives, scratch.save(warc.merged(scratch.save(warc.captures(archives), "runs")), "index")


def test_files_are_archives_that_others_read(spark, stored, tmp_path):
    archives, index = stored
    folder = str(tmp_path / "warc")
    for _ in range(2):  # a task may run again
        written = {r["archive"]: r["bytes"] for r in warc.files(archives, folder).collect()}
    assert sorted(os.listdir(folder)) == sorted(written) and all(os.path.getsize(os.path.join(folder, a)) == n for a, n in written.items())
    records = 0
    for name in written:
        with gzip.open(os.path.join(folder, name)) as f:  # members one after another are one stream
            text = f.read()
        while text:
            head, _, rest = text.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            n = int(fields[b"Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[n : n + 4] == b"\r\n\r\n" and fields[b"WARC-Type"] in (b"response", b"revisit")
            assert (b"WARC-Refers-To" in fields) == (fields[b"WARC-Type"] == b"revisit")
            records, text = records + 1, rest[n + 4 :]
    assert records == index.count() == 202


def test_records_at_the_places_of_the_index(stored):
    archives, index = stored
    got, want = warc.fetched(archives, index), index
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    one = index.where("page_id = 7")
    assert [str(r) for r in warc.fetched(archives, one).collect()] == [str(r) for r in one.collect()]
    with pytest.raises(Exception, match="ends within a record"):
        warc.fetched(archives, one.withColumn("size", F.col("size") - 3)).collect()


def test_a_payload_that_is_not_what_its_record_says(spark):
    import zlib

    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = squeeze.compress(warc.record(1, "http://a.example", b"x" * 2000, hashlib.sha1(b"y").hexdigest(), None)) + squeeze.flush()
    archives = spark.createDataFrame([("a.warc.gz", bytearray(data))], "archive string, data binary")
    with pytest.raises(Exception, match="not what its record says"):
        warc.fetched(archives, warc.captures(archives)).collect()
