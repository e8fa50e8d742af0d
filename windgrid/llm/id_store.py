"""A content-addressed store of token-id streams.

Layout below one folder, all Parquet:

``packs``  one row per document, files in ascending doc_id order: the recipe (hashes and token counts of
           its chunks), the chunks found nowhere else (little-endian unsigned 16-bit ids, or 32-bit for
           vocabularies that need them, zstd), and the document's Merkle leaf, of its doc_id, token count and recipe.
``shared`` one row per chunk that occurs more than once, named by its hash.
``manifest`` one row per pack: its documents and tokens, and the Merkle root of its leaves.
``root``   one row: all documents, tokens and packs, and the root over the roots of the packs, FAN at a time.

A chunk ends where a rolling hash of the last WINDOW ids has its low bits zero, so equal passages give
equal chunks wherever they stand. A pack ends at PACK_TOKENS ids or PACK_ROWS documents. ``read`` puts the
documents together again and fails on any chunk, leaf or root that is not what its name says, and on a pack
that is missing.

Defined cases: a null or empty text is the end id alone; null doc_ids sort first and stay null; repeated
rows are stored as documents of their own (their chunks once); an id too large for the store's width is an
error; an empty table gives an empty store, whose root is that of nothing; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from windgrid.llm import tokens
from windgrid.llm.scratch import Scratch, table

WINDOW, SMALLEST, LARGEST = 8, 128, 4096
#: A boundary in about 2 ** CUT_BITS ids.
CUT_BITS = 9
NAME = 16
#: A pack is closed at that many ids or documents; there is one manifest row for each.
PACK_TOKENS, PACK_ROWS = 4 << 20, 16_000
#: Roots that one node of the tree over the packs joins.
FAN = 1024
#: The packs' starts are sent to every executor up to this many packs (16 bytes each), and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000


def boundaries(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream.

    The rolling hash is a sum over the window of mixed ids times powers of an odd number, in 64-bit
    arithmetic that wraps; high bits of its product decide.
    """
    n = len(ids)
    if n <= SMALLEST:
        return [n] if n else []
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    roll = np.zeros(n - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        roll += x[WINDOW - 1 - k : n - k] * np.uint64(pow(0x5851F42D4C957F2D, k, 1 << 64))
    roll ^= roll >> np.uint64(31)
    cuts = np.nonzero((roll * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - CUT_BITS) == 0)[0] + WINDOW
    out, low = [], 0
    for cut in cuts.tolist():
        while cut - low > LARGEST:
            low += LARGEST
            out.append(low)
        if cut - low >= SMALLEST:
            out.append(cut)
            low = cut
    while n - low > LARGEST:
        low += LARGEST
        out.append(low)
    if low < n:
        out.append(n)
    return out


def chunk_name(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=NAME).digest()


def leaf(doc_id: int | None, names: bytes, n_tokens: int) -> bytes:
    own = b"\0" if doc_id is None else b"\1" + doc_id.to_bytes(8, "little", signed=True)
    return hashlib.sha256(b"\0" + own + n_tokens.to_bytes(8, "little") + names).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    if not leaves:
        return hashlib.sha256(b"").digest()
    while len(leaves) > 1:
        odd = leaves[-1:] if len(leaves) % 2 else []
        leaves = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(leaves[::2], leaves[1::2], strict=False)] + odd
    return leaves[0]


STAGED = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("names", pa.binary()), ("sizes", pa.list_(pa.int32())), ("ids", pa.binary())])


def _stage(encoder: Callable[[], Callable], dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encode, squeeze = encoder(), zstandard.ZstdCompressor(level=1).compress
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            docs, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, len(docs), 128):
                rows = []
                for doc, ids in zip(docs[at : at + 128], encode(texts.slice(at, 128).to_pylist()), strict=True):
                    if len(ids) and int(ids.max()) > np.iinfo(dtype).max:
                        raise ValueError(f"document {doc}: an id does not fit into {dtype}")
                    raw, width = ids.astype(dtype).tobytes(), np.dtype(dtype).itemsize
                    ends = boundaries(ids)
                    names = b"".join(chunk_name(raw[width * a : width * b]) for a, b in zip([0, *ends], ends, strict=False))
                    rows.append((doc, row, len(ids), names, np.diff([0, *ends]).tolist(), squeeze(raw)))
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), STAGED.types, strict=True)], schema=STAGED)

    return run


def _split(dtype: str):
    """Documents with the places of their shared chunks, in order -> pack rows, shared chunks, manifest."""

    schema = pa.schema([("kind", pa.string()), ("pack", pa.int64()), ("place", pa.int64()), ("begin", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("names", pa.binary()), ("sizes", pa.list_(pa.int32())), ("shared", pa.list_(pa.int32())), ("payload", pa.binary()), ("leaf", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        squeeze, open_ = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress
        width, pack = np.dtype(dtype).itemsize, TaskContext.get().partitionId() << 24
        leaves: list[bytes] = []
        total, places = 0, None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        def summary() -> tuple:
            return ("manifest", pack, len(leaves), None, None, total, merkle_root(leaves), None, None, None, None)

        for batch in batches:
            rows = []
            for doc, row, n, names, sizes, ids, at, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "n_tokens", "names", "sizes", "ids", "at", "own")), strict=True):
                if ids is None:  # the places of the document that follows
                    places = (row, at, own)
                    continue
                if leaves and (total + n > PACK_TOKENS or len(leaves) >= PACK_ROWS):
                    rows.append(summary())
                    pack, leaves, total = pack + 1, [], 0
                shared, mine = (places[1], set(places[2])) if places and places[0] == row else ([], set())
                if shared:
                    raw, private, low = open_(ids, max_output_size=width * n), [], 0
                    held = set(shared)
                    for k, size in enumerate(sizes):
                        part = raw[low : low + width * size]
                        low += width * size
                        if k not in held:
                            private.append(part)
                        elif k in mine:
                            rows.append(("shared", pack, None, None, None, size, names[NAME * k : NAME * (k + 1)], None, None, squeeze(part), None))
                    ids = squeeze(b"".join(private))
                leaves.append(leaf(doc, names, n))
                rows.append(("packs", pack, len(leaves) - 1, total, doc, n, names, sizes, sorted(shared), ids, leaves[-1]))
                total += n
            for k in range(0, len(rows), 1000):
                yield out(rows[k : k + 1000])
        if leaves:
            yield out([summary()])

    return run


STORED = "kind string, pack long, place long, begin long, doc_id long, n_tokens long, names binary, sizes array<int>, shared array<int>, payload binary, leaf binary"


ROOT = "documents long, n_tokens long, packs long, root binary"


class IdStore:
    """One store: ``write`` makes it, ``read`` returns documents from its files."""

    def __init__(self, scratch: Scratch, dtype: str = "<u2"):
        self.scratch, self.dtype, self.spark = scratch, dtype, scratch.spark

    def write(self, docs: DataFrame, encoder: Callable[[], Callable]) -> None:
        """docs: doc_id, text. encoder: called in each task, gives a function from texts to arrays of ids."""
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        staged = self.scratch.save(docs.mapInArrow(_stage(encoder, self.dtype), "doc_id long, row long, n_tokens long, names binary, sizes array<int>, ids binary"), "staged")
        # names only: which chunks occur more than once, and where first
        each = staged.select("doc_id", "row", F.posexplode("sizes").alias("at", "size"), "names")
        each = each.select("doc_id", "row", "at", F.expr(f"substring(names, at * {NAME} + 1, {NAME})").alias("name"))
        twice = each.groupBy("name").agg(F.count("*").alias("m"), F.min(F.struct("row", "at")).alias("first")).where("m > 1").select("name", "first")
        twice = self.scratch.save(twice, "twice")  # written first, so that the join can split a very common chunk's rows
        found = each.join(twice, "name").select("doc_id", "row", "at", ((F.col("first.row") == F.col("row")) & (F.col("first.at") == F.col("at"))).alias("own"))
        found = found.groupBy("doc_id", "row").agg(F.collect_list("at").alias("at"), F.expr("collect_list(at) filter (where own)").alias("own"))
        found = self.scratch.save(found, "found")
        none = lambda kind: F.lit(None).cast(kind)
        both = staged.select("*", none("array<int>").alias("at"), none("array<int>").alias("own")).unionByName(
            found.select("doc_id", "row", none("long").alias("n_tokens"), none("binary").alias("names"), none("array<int>").alias("sizes"), none("binary").alias("ids"), "at", "own")
        )
        size = staged.agg(F.count("*").alias("rows"), F.sum("n_tokens").alias("tokens")).first()
        packs = max(1, -(-size["rows"] // PACK_ROWS), -(-(size["tokens"] or 0) // PACK_TOKENS), self.spark.sparkContext.defaultParallelism * 2)
        order = both.repartitionByRange(packs, F.col("doc_id").asc_nulls_first(), F.col("row")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row", F.col("ids").isNotNull())
        order.mapInArrow(_split(self.dtype), STORED).write.option("compression", "zstd").partitionBy("kind").parquet(self.scratch.path("store"))
        self.scratch.save(self._top(), "root")
        self.scratch.drop("staged", "twice", "found")

    def _stored(self, kind: str) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(self.scratch.path("store")).where(F.col("kind") == kind)

    def manifest(self) -> DataFrame:
        """pack, documents, n_tokens, root, start (tokens of all packs before it)."""
        rows = self._stored("manifest").select("pack", F.col("place").alias("documents"), "n_tokens", F.col("names").alias("root"))
        before = Window.orderBy("pack").rowsBetween(Window.unboundedPreceding, -1)  # one row per pack
        return rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def _top(self) -> DataFrame:
        """documents, n_tokens, packs, root of the manifest as it is; a level of the tree is a job."""
        size = self.manifest().agg(F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"), F.count("*").alias("packs"))
        level = self.manifest().select((F.row_number().over(Window.orderBy("pack")) - 1).alias("i"), "root")  # one row per pack
        n, k = level.count(), 0
        while n > 1:
            parts = F.transform(F.array_sort(F.collect_list(F.struct("i", "root"))), lambda x: x["root"])
            joined = level.groupBy(F.expr(f"i div {FAN}").alias("i")).agg(F.aggregate(parts, F.expr("X'02'"), lambda a, x: F.concat(a, x)).alias("all"))
            level = self.scratch.save(joined.select("i", F.unhex(F.sha2("all", 256)).alias("root")), f"root_{uuid.uuid4().hex}_{k}")
            n, k = -(-n // FAN), k + 1
        top = level.first()
        return size.withColumn("root", F.lit(bytes(top["root"]) if top else merkle_root([])))

    def root(self) -> tuple[int, int, int, str]:
        """Documents, tokens, packs and the root, as they were when the store was written."""
        got = self.scratch.read("root", self.spark.createDataFrame([], ROOT)).first()
        return got["documents"], got["n_tokens"], got["packs"], bytes(got["root"]).hex()

    def read(self, verify: bool = True) -> DataFrame:
        """doc_id, pack, begin (its offset in the pack), n_tokens, ids (little-endian unsigned 32-bit), put together from the files."""
        packs = self._stored("packs").drop("kind")
        if verify:
            self.verify()
        # only documents with shared chunks meet the chunk table
        plain = packs.where("size(shared) = 0").select("doc_id", "pack", "begin", "n_tokens", "names", "sizes", "shared", "payload", F.lit(None).cast("array<struct<at:int,part:binary>>").alias("parts"))
        some = packs.where("size(shared) > 0")
        wanted = some.select("pack", "place", F.explode("shared").alias("at"), "names").select("pack", "place", "at", F.expr(f"substring(names, at * {NAME} + 1, {NAME})").alias("name"))
        chunks = self._stored("shared").select(F.col("names").alias("name"), F.col("payload").alias("part"))
        parts = wanted.join(chunks, "name", "left").groupBy("pack", "place").agg(F.collect_list(F.struct("at", "part")).alias("parts"))
        whole = some.join(parts, ["pack", "place"]).select(*plain.columns)
        return plain.unionByName(whole).mapInArrow(_join(self.dtype), "doc_id long, pack long, begin long, n_tokens long, ids binary")

    def verify(self) -> None:
        """Fails unless every document gives its leaf, every pack's leaves its root, and the packs' roots the store's."""

        def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pack, leaves, out = None, [], []
            for batch in batches:
                for p, doc, names, n, said in zip(*(batch.column(c).to_pylist() for c in ("pack", "doc_id", "names", "n_tokens", "leaf")), strict=True):
                    if p != pack and leaves:
                        out.append((pack, merkle_root(leaves)))
                        leaves = []
                    pack = p
                    own = leaf(doc, names, n)
                    leaves.append(own if own == said else b"")  # a wrong leaf gives a wrong root
            if leaves:
                out.append((pack, merkle_root(leaves)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["pack", "got"])

        got = self._stored("packs").select("pack", "place", "doc_id", "names", "n_tokens", "leaf").repartition("pack").sortWithinPartitions("pack", "place").mapInArrow(roots, "pack long, got binary")
        bad = self.manifest().join(got, "pack", "full").where("not (root <=> got)")
        if not bad.isEmpty():
            raise ValueError("a pack's documents do not give the root in its manifest")
        now = self._top().first()
        if (now["documents"], now["n_tokens"], now["packs"], bytes(now["root"]).hex()) != self.root():
            raise ValueError("the packs do not give the root of the store")


def _join(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        open_, width = zstandard.ZstdDecompressor().decompress, np.dtype(dtype).itemsize
        for batch in batches:
            out = []
            for n, names, sizes, shared, payload, parts in zip(*(batch.column(c).to_pylist() for c in ("n_tokens", "names", "sizes", "shared", "payload", "parts")), strict=True):
                raw = open_(payload, max_output_size=width * n)
                if shared:
                    held = {x["at"]: open_(x["part"], max_output_size=width * sizes[x["at"]]) for x in parts if x["part"] is not None}
                    pieces, low = [], 0
                    for k, size in enumerate(sizes):
                        if k in held:
                            pieces.append(held[k])
                        else:
                            pieces.append(raw[low : low + width * size])
                            low += width * size
                    raw = b"".join(pieces)
                low = 0
                for k, size in enumerate(sizes):
                    if chunk_name(raw[low : low + width * size]) != names[NAME * k : NAME * (k + 1)]:
                        raise ValueError("a chunk is not what its name says")
                    low += width * size
                if low != width * n or len(raw) != low:
                    raise ValueError("a document has not the length of its recipe")
                out.append(np.frombuffer(raw, dtype=dtype).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "pack", "begin", "n_tokens")), pa.array(out, pa.binary())], names=["doc_id", "pack", "begin", "n_tokens", "ids"])

    return run


def digests(store: IdStore) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the store's files; start: ids of all documents before it."""
    offsets = store.manifest().select("pack", F.col("start").alias("base"))
    if offsets.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    read = store.read().select("doc_id", "pack", "begin", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return read.join(offsets, "pack").select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def op4_content_addressed_ids(spark, sf_dir: str) -> DataFrame:
    """Ids of all documents, stored in ascending doc_id order and read back."""
    store = IdStore(Scratch(spark, "ids"))
    store.write(table(spark, sf_dir, "documents"), tokens.word_bpe_encoder(end=1))
    return digests(store)

