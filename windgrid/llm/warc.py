"""WARC archives of pages, and one globally ordered capture index over them by external merge.

``write`` turns every page into a record (gzip member) and cuts archives of bounded size. Records with
equal payloads of at least LEAST bytes are stored once: the one with the largest page_id is the
response, the others are revisits that refer to it. ``captures`` reads archives back record by record,
checks them, and gives each archive's captures as a run sorted by URL key, time and page_id.
``merged`` orders all runs at once: range partitioning cuts every run at the same keys, and each task
merges its slices of the runs with a loser tree (a shuffle does not keep the order of a slice, so each is
sorted again as it arrives). ``fetched`` reads the records that an index names, at their offsets, and holds
payloads against their digests. Archives are cells of a Parquet table, since that is what every executor can
write wherever the shared folder is; ``files`` writes them as .warc.gz files where the folder is mounted.
Pages have no time of capture: WARC-Date is the second after EPOCH that the page_id counts.

Defined cases: a null html is an empty payload; a null url has no target line and an empty key; a null
page_id stays null and is never a response that others refer to; of repeated rows with the largest
page_id, every one is a response; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windgrid.llm.scratch import Scratch, bounded_batches, table

#: Payloads from this size on are stored once.
LEAST = 1000
#: An archive is closed at this many bytes.
ARCHIVE_BYTES = 4 << 20
#: Archives that one task reads, about.
ARCHIVES = 8
#: Captures that one task merges, about.
MERGE_ROWS = 50_000
#: Digests of repeated payloads are sent to every executor up to this many (60 bytes each), and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Host labels from the top down, then the path and query in lower case: com,example)/a?b."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:
        return url.lower()
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page {page_id}'.encode()).digest())}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, not yet compressed; a revisit has the HTTP header but no payload."""
    stamp = (EPOCH + timedelta(seconds=(page_id or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {stamp}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}")
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    if page_id is not None:
        lines.append(f"X-Page: {page_id}")
    return "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""]).encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's WARC header, HTTP header and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    size = int(fields["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record is not as long as it says")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, http, payload


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of the gzip members of an archive."""
    at = 0
    while at < len(data):
        one, parts, end = zlib.decompressobj(31), [], at
        while not one.eof:
            part = data[end : end + 65536]
            if not part:
                raise ValueError("an archive ends within a record")
            parts.append(one.decompress(part))
            end += len(part)
        size = end - at - len(one.unused_data)
        yield at, size, b"".join(parts)
        at += size


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with digests and what they refer to -> archives."""
    part, number, held = TaskContext.get().partitionId(), 0, bytearray()

    def closed() -> pa.RecordBatch:
        nonlocal number, held
        out = pa.RecordBatch.from_arrays([pa.array([f"pages-{part:06d}-{number:06d}.warc.gz"]), pa.array([bytes(held)], pa.binary())], names=["archive", "data"])
        number, held = number + 1, bytearray()
        return out

    for batch in batches:
        for page, url, payload, digest, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
            squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
            held += squeeze.compress(record(page.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py())) + squeeze.flush()
            if len(held) >= ARCHIVE_BYTES:
                yield closed()
    if held:
        yield closed()


CAPTURE = "url_key string, captured string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, at long, size long"
_TYPES = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in CAPTURE.split(", ")]


def _key(row: tuple) -> tuple:
    return row[0], row[1], -1 if row[2] is None else row[2], row[7], row[8]


def _capture(content: bytes) -> tuple[tuple, bytes]:
    """url_key, captured, page_id, payload_bytes, payload_digest, record_type, refers_to of a record; its payload."""
    fields, http, payload = parse(content)
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    said = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    page, refers = fields.get("X-Page"), fields.get("X-Refers-To-Page")
    return (url_key(fields.get("WARC-Target-URI")), fields["WARC-Date"], int(page) if page else None, said, digest, fields["WARC-Type"], int(refers) if refers else None), payload


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives -> their captures, each archive's a sorted run. Only headers are looked at."""
    for batch in batches:
        for archive, data in zip(batch.column("archive").to_pylist(), batch.column("data"), strict=True):
            rows = []
            for at, size, content in members(data.as_py()):
                rows.append((*_capture(content)[0], archive, at, size))
            rows.sort(key=_key)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


class LoserTree:
    """k sorted runs as one: the inner nodes hold the losers of their matches, the winner is next."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        self.winner = self._build(1) if runs else -1

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or x is not None and (x[0], a) < (y[0], b)

    def _build(self, node: int) -> int:
        """Plays all matches below a node; leaves are k .. 2k - 1."""
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        won, lost = (a, b) if self._before(a, b) else (b, a)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple]:
        while self.winner >= 0 and self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            w = self.winner
            self.heads[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node >= 1:
                if self._before(self.losers[node], w):
                    w, self.losers[node] = self.losers[node], w
                node //= 2
            self.winner = w


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of runs, one after another -> all their captures in order."""
    runs: list[list[tuple]] = []
    name = None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[7] != name:
                runs.append([])
                name = row[7]
            runs[-1].append((_key(row), row))
    out: list[tuple] = []
    for _, row in LoserTree([iter(r) for r in runs]):
        out.append(row)
        if len(out) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)


def write(pages: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """Archives of all pages (page_id, url, html): archive, data. They are files below scratch."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    small = scratch.save(rows.select("page_id", "digest", F.octet_length("payload").alias("n")).where(F.col("n") >= least), "digests")
    latest = small.groupBy("digest").agg(F.count("*").alias("m"), F.max("page_id").alias("latest")).where("m > 1 and latest is not null").select("digest", "latest")
    latest = scratch.save(latest, "latest")
    if latest.count() <= BROADCAST_ROWS:
        latest = F.broadcast(latest)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("latest")), F.col("latest")).alias("refers_to")
    rows = rows.join(latest, "digest", "left").select("page_id", "url", "payload", "digest", refers)
    return scratch.save(rows.mapInArrow(_archives, "archive string, data binary"), "archives")


def captures(archives: DataFrame) -> DataFrame:
    """The captures of archives, as they are read back, archive by archive in key order."""
    return archives.mapInArrow(_runs, CAPTURE)


def merged(runs: DataFrame) -> DataFrame:
    """All captures in order of URL key, time and page_id, over partitions of bounded size."""
    n = max(1, -(-runs.count() // MERGE_ROWS), runs.sparkSession.sparkContext.defaultParallelism)
    order = [F.col("url_key"), F.col("captured"), F.col("page_id").asc_nulls_first(), F.col("archive"), F.col("at")]
    return runs.repartitionByRange(n, *order).sortWithinPartitions("archive", *order[:3], "at").mapInArrow(_merge, CAPTURE)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Archives with the places (at, size) that an index has in them -> the captures there."""
    for batch in batches:
        for archive, data, places in zip(batch.column("archive").to_pylist(), batch.column("data"), batch.column("places").to_pylist(), strict=True):
            rows, raw = [], data.as_py()
            for place in places:
                at, size = place["at"], place["size"]
                (_, length, content), *_ = members(raw[at : at + size])
                row, payload = _capture(content)
                if length != size or row[5] == "response" and (len(payload) != row[3] or hashlib.sha1(payload).hexdigest() != row[4]):
                    raise ValueError(f"{archive}, {at}: the payload is not what its record says")
                rows.append((*row, archive, at, size))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)


def fetched(archives: DataFrame, index: DataFrame) -> DataFrame:
    """The captures that an index (archive, at, size) names, from the records themselves; an archive holds a bounded number."""
    places = index.groupBy("archive").agg(F.array_sort(F.collect_list(F.struct("at", "size"))).alias("places"))
    parts = max(archives.sparkSession.sparkContext.defaultParallelism, -(-archives.count() // ARCHIVES))
    both = archives.repartition(parts, "archive").join(places.repartition(parts, "archive"), "archive")
    return both.select("archive", "data", "places").mapInArrow(_fetch, CAPTURE)


def files(archives: DataFrame, folder: str) -> DataFrame:
    """Writes archives as files of their names into a folder that all executors mount: archive, bytes.

    A file appears under its name when it is whole, so a task that is run again does no harm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            sizes = []
            for archive, data in zip(batch.column("archive").to_pylist(), batch.column("data"), strict=True):
                part = os.path.join(folder, f".{archive}.{uuid.uuid4().hex}")
                with open(part, "wb") as f:
                    sizes.append(f.write(data.as_py()))
                os.replace(part, os.path.join(folder, archive))
            yield pa.RecordBatch.from_arrays([batch.column("archive"), pa.array(sizes, pa.int64())], names=["archive", "bytes"])

    bounded_batches(archives.sparkSession)
    return archives.select("archive", "data").mapInArrow(run, "archive string, bytes long")


def op10_warc_index_merge(spark, sf_dir: str) -> DataFrame:
    """Records of all pages, read back from the archives at the places that the merged index names."""
    scratch = Scratch(spark, "warc")
    archives = write(table(spark, sf_dir, "pages"), scratch)
    runs = scratch.save(captures(archives), "runs")
    index = scratch.save(merged(runs), "index")
    scratch.drop("runs")
    return fetched(archives, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS digest, url FROM pages
), q AS (
    SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS latest FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN latest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN latest <> page_id THEN latest END AS refers_to
FROM q
"""
