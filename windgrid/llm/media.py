"""Media columns: types told from the bytes themselves.

``sniff`` walks a blob once with an Aho-Corasick automaton of magic bytes; a validator per format then
confirms structure and length at each hit. What begins the blob corrects its declared type; confirmed
media further in are carved out with their spans. ``to_wave`` and ``wave_samples`` store bytes losslessly
as 8-bit mono sound and give them back.

Defined cases: a null blob counts as empty; an empty or unknown blob has type application/octet-stream
and no carvings; a magic number without the structure of its format is nothing; repeated rows are
sniffed alike; a null doc_id stays null; an empty table gives no rows; `sniffed` keeps all columns but those
of its own names, the others read the columns named only.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from windgrid.llm.scratch import Scratch, bounded_batches, table

UNKNOWN = "application/octet-stream"
RATE = 8000
#: Payloads are padded with 255 to a positive multiple of this.
UNIT = 576
#: A PDF's parts: where a section's table begins, its end mark, and the next file.
_PDF = re.compile(rb"startxref|%%EOF|%PDF-")


def _wave(b: memoryview) -> int:
    """Length of a RIFF WAVE file at the start of b, or 0."""
    if len(b) < 44 or bytes(b[8:12]) != b"WAVE":
        return 0
    size = 8 + struct.unpack_from("<I", b, 4)[0]
    if size > len(b):
        return 0
    at, seen = 12, set()
    while at + 8 <= size:
        name, n = bytes(b[at : at + 4]), struct.unpack_from("<I", b, at + 4)[0]
        if at + 8 + n > size:
            return 0
        if name == b"fmt ":
            if n < 16:
                return 0
            kind, channels, rate, per_second, align, bits = struct.unpack_from("<HHIIHH", b, at + 8)
            if not channels or kind == 1 and (align != channels * bits // 8 or per_second != rate * align):
                return 0
        seen.add(name)
        at += 8 + n + n % 2
    return size if at in (size, size + 1) and {b"fmt ", b"data"} <= seen else 0


def _png(b: memoryview) -> int:
    at, first = 8, True
    while at + 12 <= len(b):
        n, name = struct.unpack_from(">I", b, at)[0], bytes(b[at + 4 : at + 8])
        end = at + 12 + n
        if end > len(b) or first and (name != b"IHDR" or n != 13) or zlib.crc32(b[at + 4 : at + 8 + n]) != struct.unpack_from(">I", b, at + 8 + n)[0]:
            return 0
        if name == b"IEND":
            return end
        at, first = end, False
    return 0


def _gif(b: memoryview) -> int:
    if len(b) < 14:
        return 0
    table_size = lambda flags: 3 << ((flags & 7) + 1) if flags & 128 else 0
    at = 13 + table_size(b[10])

    def blocks(at: int) -> int:
        while at < len(b) and b[at]:
            at += 1 + b[at]
        return at + 1 if at < len(b) else -1

    while 0 < at < len(b):
        if b[at] == 0x3B:
            return at + 1
        if b[at] == 0x21:
            at = blocks(at + 2)
        elif b[at] == 0x2C and at + 10 < len(b):
            at = blocks(at + 11 + table_size(b[at + 9]))
        else:
            return 0
    return 0


#: A marker in entropy-coded data that ends it: no stuffed zero, restart or fill byte.
_JPEG_END = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL)


def _jpeg(b: memoryview) -> int:
    at = 2
    while at + 2 <= len(b):
        if b[at] != 0xFF:
            return 0
        mark = b[at + 1]
        if mark == 0xFF:  # fill bytes may come before any marker
            at += 1
            continue
        if mark == 0xD9:
            return at + 2
        if mark in (0x01, *range(0xD0, 0xD8)):
            at += 2
            continue
        n = struct.unpack_from(">H", b, at + 2)[0] if at + 4 <= len(b) else 0
        if n < 2:
            return 0
        at += 2 + n
        if mark == 0xDA:
            found = _JPEG_END.search(b, min(at, len(b)))
            if not found:
                return 0
            at = found.start()
    return 0


def _gzip(b: memoryview) -> int:
    one = zlib.decompressobj(31)
    try:
        at = 0
        while at < len(b) and not one.eof:
            one.decompress(b[at : at + 65536], 1 << 20)
            while one.unconsumed_tail and not one.eof:
                one.decompress(one.unconsumed_tail, 1 << 20)
            at += 65536
    except zlib.error:
        return 0
    return min(at, len(b)) - len(one.unused_data) if one.eof else 0


def _zip_ends(blob: bytes) -> dict[int, int]:
    """Begin -> end of the archives in a blob: an end record says where its central directory is, so where the archive begins."""
    out: dict[int, int] = {}
    at = blob.find(b"PK\x05\x06")
    while at >= 0 and at + 22 <= len(blob):
        count, size, offset, note = struct.unpack_from("<HIIH", blob, at + 10)
        begin = at - offset - size
        if begin >= 0 and at + 22 + note <= len(blob) and (not count or blob[begin + offset : begin + offset + 4] == b"PK\x01\x02"):
            out.setdefault(begin, at + 22 + note)
        at = blob.find(b"PK\x05\x06", at + 4)
    return out


def _zip(b: memoryview) -> int:
    """An archive of which the end record describes the central directory."""
    return _zip_ends(bytes(b)).get(0, 0)


def _pdf(b: memoryview) -> int:
    """Up to the last end mark (saved changes append sections) before the next file; files within come before the first."""
    if not bytes(b[5:8]).replace(b".", b"").isdigit():
        return 0
    end, armed = 0, False
    for m in _PDF.finditer(b, 8):
        what = m.group()
        if what == b"startxref":
            armed = True
        elif what == b"%%EOF":
            if armed:
                end, armed = m.end(), False
        elif end:
            break
    return end


def _bmp(b: memoryview) -> int:
    if len(b) < 54:
        return 0
    size, zero, offset, header = struct.unpack_from("<IIII", b, 2)
    return size if not zero and 54 <= offset <= size <= len(b) and header in (40, 108, 124) else 0


#: Magic bytes, the type they announce.
MAGIC = {
    b"RIFF": "audio/wav",
    b"\x89PNG\r\n\x1a\n": "image/png",
    b"GIF87a": "image/gif",
    b"GIF89a": "image/gif",
    b"\xff\xd8\xff": "image/jpeg",
    b"\x1f\x8b\x08": "application/gzip",
    b"PK\x03\x04": "application/zip",
    b"%PDF-": "application/pdf",
    b"BM": "image/bmp",
}
VALID: dict[str, Callable[[memoryview], int]] = {
    "audio/wav": _wave, "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "application/gzip": _gzip,
    "application/zip": _zip, "application/pdf": _pdf, "image/bmp": _bmp,
}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind in MAGIC.items():
        found.add_word(magic.decode("latin-1"), (len(magic), kind))
    found.make_automaton()
    return found


def sniff(blob: bytes | None, inside: bool = True) -> tuple[str, int, list[tuple[str, int, int]]]:
    """Type and length of what begins the blob, and (type, offset, length) of media further in.

    Confirmed media are not searched for others within, but those behind a leading one are found.
    """
    if not blob:
        return UNKNOWN, 0, []
    view, kind, size, carved, beyond = memoryview(blob), UNKNOWN, 0, [], 0
    last_table = zips = None  # of a PDF, before the last end mark: one that begins behind it has none; of archives, see _zip_ends
    text = blob.decode("latin-1") if inside else blob[:16].decode("latin-1")
    for end, (n, what) in _automaton().iter(text):
        at = end + 1 - n
        if at < beyond:
            continue
        if what == "application/pdf":
            if last_table is None:
                last_table = blob.rfind(b"startxref", 0, max(0, blob.rfind(b"%%EOF")))
            if at > last_table:
                continue
        if what == "application/zip":  # one pass for all that look like one
            zips = _zip_ends(blob) if zips is None else zips
            length = zips.get(at, at) - at
        else:
            length = VALID[what](view[at:])
        if length:
            if at == 0:
                kind, size = what, length
            else:
                carved.append((what, at, length))
            beyond = at + length
    return kind, size, carved


def sniffed(rows: DataFrame, blob: str, declared: str | None = None) -> DataFrame:
    """rows with true_type, true_bytes, corrected (declared type was wrong) and carved spans appended."""
    bounded_batches(rows.sparkSession)
    rows = rows.drop("true_type", "true_bytes", "corrected", "carved")
    names, own = rows.columns, rows.schema
    span = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sniff(x.as_py()) for x in batch.column(blob)]
            said = batch.column(declared).to_pylist() if declared else [f[0] for f in found]
            spans = [[dict(zip(("type", "offset", "length"), c, strict=True)) for c in f[2]] for f in found]
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[0] != s for f, s in zip(found, said, strict=True)], pa.bool_()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*names, "true_type", "true_bytes", "corrected", "carved"])

    schema = StructType(own.fields[:]).add("true_type", "string").add("true_bytes", "long").add("corrected", "boolean").add("carved", DataType.fromDDL("array<struct<type:string,offset:long,length:long>>"))
    return rows.mapInArrow(run, schema)


def to_wave(payload: bytes) -> bytes:
    """An 8-bit mono wave file whose samples are the payload's bytes."""
    n = len(payload)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return struct.pack("<4sI4s", b"RIFF", 36 + n + n % 2, b"WAVE") + fmt + struct.pack("<4sI", b"data", n) + payload + b"\0" * (n % 2)


def wave_samples(media: bytes) -> bytes:
    """The samples of a confirmed wave file."""
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + struct.unpack_from("<I", media, at + 4)[0]
    return media[at + 8 : at + 8 + struct.unpack_from("<I", media, at + 4)[0]]


def feature(samples: bytes) -> str:
    """Length, mean level, energy and zero crossings of the sound, as text of fixed form."""
    if not samples:
        return "n=0"
    x = np.frombuffer(samples, dtype=np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"n={len(x)};ms={1000 * len(x) // RATE};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings};low={int(x.min())};high={int(x.max())}"


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT))


#: The declared type of stored texts. It is in front of the media in their cell, as a header of its own.
DECLARED = "text/plain"


def text_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, declared, blob for docs (doc_id, text): texts as wave files, each behind a header that declares another type."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = f"Content-Type: {DECLARED}\r\n\r\n".encode()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                both = [padded(t.as_py()) for t in batch.column("text").slice(at, 512)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 512), pa.array([n for n, _ in both], pa.int64()), pa.array([DECLARED] * len(both)), pa.array([head + to_wave(p) for _, p in both], pa.binary())], names=["doc_id", "n_bytes", "declared", "blob"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, declared string, blob binary")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, true_type string, corrected boolean"


def media_digests(stored: DataFrame) -> DataFrame:
    """Digests and features of stored media, from the bytes read back: carved out of their cells, confirmed and opened."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in DIGESTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, declared, cell in zip(*(batch.column(c) for c in ("doc_id", "n_bytes", "declared", "blob")), strict=True):
                blob = cell.as_py()
                kind, _, carved = sniff(blob)
                if kind != UNKNOWN or len(carved) != 1 or carved[0][0] != "audio/wav" or sum(carved[0][1:]) != len(blob):
                    raise ValueError(f"document {doc}: not one whole wave file is carved from what is stored")
                kind, at, size = carved[0]
                media = blob[at : at + size]
                samples = wave_samples(media)
                rows.append((doc.as_py(), n.as_py(), len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples), kind, kind != declared.as_py()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    bounded_batches(stored.sparkSession)
    return stored.mapInArrow(run, DIGESTS)


def op5_signature_sniffing(spark, sf_dir: str) -> DataFrame:
    """All documents stored as sound that is declared to be text, read back, carved out by its signature and measured."""
    stored = Scratch(spark, "media").save(text_media(table(spark, sf_dir, "documents")), "media")
    return media_digests(stored)
