"""SentencePiece encoding and decoding of merge-type (BPE) models, without the library.

A merge-type model joins, again and again, the adjacent pair whose joint piece has the best score. The
result is the only split of the text into pieces in which every two neighbours are *compatible*: merging
their joint text anew leaves the boundary between them. So the split can be searched instead of merged:
take the longest piece at each position, step to a shorter one or back when a neighbour is not
compatible, and note positions from which no end was reached in a bitfield, so that each fails once.

The pieces that start at each position come from one pass of an Aho-Corasick automaton.
Words are independent, since no piece has a space mark after another character; their ids are kept.

Defined cases: null counts as empty (no ids, decoded to the empty text); a null doc_id stays null; repeated rows
are encoded alike; an empty table gives no rows; other columns are not read; characters outside the vocabulary become byte pieces; runs of the
space mark, whose pieces all have one score, are merged by the plain rule (leftmost first).
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windgrid.llm.scratch import bounded_batches, table
from windgrid.llm.tokens import vocabulary

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol-buffer message's fields; fixed 32-bit values as floats."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 5:
            yield key >> 3, float(np.frombuffer(data, "<f4", 1, at)[0])
            at += 4
        elif kind == 1:
            at += 8
        else:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces, scores and kinds of a model file, and what encoding derives from them."""

    def __init__(self, path: str):
        import ahocorasick

        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer = normalizer = b""
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    own = dict(_fields(value))
                    self.pieces.append(own[1].decode())
                    self.scores.append(own.get(2, 0.0))
                    self.kinds.append(own.get(3, NORMAL))
                elif number == 2:
                    trainer = value
                elif number == 3:
                    normalizer = value
        if dict(_fields(trainer)).get(3) != 2:
            raise ValueError("not a merge-type model")
        rules = dict(_fields(normalizer))
        if rules.get(2) or set(self.kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE} or rules.get(4, 1):
            raise ValueError("only models without normalization rules and user-defined pieces are known here")
        self.prefix = bool(rules.get(3, 1))
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == BYTE}
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        # best first: a pair's turn is the place of its piece's score
        order = {s: k for k, s in enumerate(sorted({self.scores[i] for i in self.ids.values()}, reverse=True))}
        self.turn = {p: order[self.scores[i]] for p, i in self.ids.items()}
        self.spines: dict[str, tuple[list, list]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        # pieces of space marks only are left to the plain rule
        words = [p for p in self.ids if p.strip(MARK) or p == MARK]
        if any(MARK in p[1:] for p in words):
            raise ValueError("pieces that hold a space mark inside are not known here")
        # a piece that merging its own text does not give can never be part of a result
        self.found = ahocorasick.Automaton()
        for p in words:
            if len(p) == 1 or self._merge(list(p)) == [p]:
                self.found.add_word(p, p)
        self.found.make_automaton()
        self.joined = {pair for p in words for pair in zip(p, p[1:], strict=False)}

    def _merge(self, symbols: list[str]) -> list[str]:
        """The plain rule: the best pair first, of equal ones the leftmost."""
        heap, turn = [], self.turn
        right = list(range(1, len(symbols) + 1))
        left = list(range(-1, len(symbols) - 1))

        def offer(a: int) -> None:
            b = right[a]
            if b < len(symbols) and (t := turn.get(symbols[a] + symbols[b])) is not None:
                heapq.heappush(heap, (t, a, symbols[a] + symbols[b]))

        for a in range(len(symbols)):
            offer(a)
        while heap:
            _, a, joint = heapq.heappop(heap)
            b = right[a]
            if not symbols[a] or b >= len(symbols) or symbols[a] + symbols[b] != joint:
                continue
            symbols[a], symbols[b] = joint, ""
            right[a] = right[b]
            if right[b] < len(symbols):
                left[right[b]] = a
            offer(a)
            if left[a] >= 0:
                offer(left[a])
        return [s for s in symbols if s]

    def _spine(self, piece: str) -> tuple[list, list]:
        """How the piece's first and last symbol grow as its text is merged: [(symbol, turn)], in time."""
        if piece not in self.spines:
            symbols = list(piece)
            first, last, now = [(symbols[0], -1)], [(symbols[-1], -1)], -1
            while len(symbols) > 1:
                t, a = min((self.turn[x + y], k) for k, (x, y) in enumerate(zip(symbols, symbols[1:], strict=False)) if x + y in self.turn)
                now = max(now, t)
                symbols[a : a + 2] = [symbols[a] + symbols[a + 1]]
                if a == 0:
                    first.append((symbols[0], now))
                if a == len(symbols) - 1:
                    last.append((symbols[-1], now))
            self.spines[piece] = first, last
        return self.spines[piece]

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging the text of a and b leaves them apart: their edges are merged anew, side by side."""
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[a, b] = self._apart(self._spine(a)[1], self._spine(b)[0])
        return known

    def _apart(self, last: list, first: list) -> bool:
        i = j = 0
        never = len(self.turn) + 1
        while True:
            joint = self.turn.get(last[i][0] + first[j][0], never)
            own = last[i + 1][1] if i + 1 < len(last) else never
            other = first[j + 1][1] if j + 1 < len(first) else never
            # of equal turns the leftmost goes first: what grows a, then the joint, then what grows b
            if joint < own and joint <= other and joint < never:
                return False
            if own == other == never:
                return True
            if own <= other:
                i += 1
            else:
                j += 1

    def search(self, text: str) -> list[str]:
        """The compatible split of a text whose characters are all pieces."""
        size = len(text)
        if size == 1:
            return [text]
        starts: list[list[str]] = [[] for _ in range(size + 1)]
        for end, p in self.found.iter(text):
            starts[end + 1 - len(p)].append(p)  # ends grow, so the longest comes last
        failed = bytearray(size // 8 + 1)
        out: list[str] = []
        tries = [starts[0]]
        at, before, pairs = 0, None, self.pairs
        while at < size:
            options = tries[-1]
            while options:
                p = options.pop()
                end = at + len(p)
                if failed[end >> 3] & 1 << (end & 7):
                    continue
                if before is not None:
                    fits = pairs.get((before, p))
                    if fits is None:
                        fits = self.compatible(before, p)
                    if not fits:
                        continue
                out.append(p)
                at, before = end, p
                tries.append(starts[at][:])
                break
            else:
                if not out:
                    raise ValueError("the model has no split of this text")
                # every piece that starts here was refused after `before`
                failed[at >> 3] |= 1 << (at & 7)
                tries.pop()
                at -= len(out.pop())
                before = out[-1] if out else None
        return out

    def part(self, text: str) -> tuple[int, ...]:
        """Ids of a text within which every two neighbours stand side by side in some piece."""
        ids = self.ids
        if len(text) == 1:
            return (ids[text],) if text in ids else tuple(self.byte[b] for b in text.encode())
        return tuple([ids[p] for p in self.search(text)])

    def parts(self, text: str) -> list[str]:
        """Splits a text where no piece holds both neighbours, since no merge can pass there."""
        joined, low, out = self.joined, 0, []
        for k, pair in enumerate(zip(text, text[1:], strict=False), 1):
            if pair not in joined:
                out.append(text[low:k])
                low = k
        out.append(text[low:])
        return out

    def marks(self, count: int) -> list[int]:
        """Ids of a run of space marks, by the plain rule."""
        return [self.ids[p] for p in self._merge([MARK] * count)]


class Encoder:
    """Encodes and decodes texts; ids of words and of their parts are kept, up to `most` of each."""

    def __init__(self, path: str, most: int = 400_000):
        import regex

        self.model, self.most = Model(path), most
        self.kept: dict[str, tuple[int, ...]] = {}
        self.kept_parts: dict[str, tuple[int, ...]] = {}
        if "\n" in self.model.ids:
            raise ValueError("models with a piece for the line feed are not known here")
        self.words = regex.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n").findall

    def word(self, text: str) -> tuple[int, ...]:
        """Ids of space marks with what follows them; only the last mark can join it."""
        model, kept = self.model, self.kept_parts
        marks = len(text) - len(text.lstrip(MARK))
        body = text[max(0, marks - 1) :] if marks < len(text) else ""
        out: list[int] = []
        for p in model.parts(body) if body else ():
            ids = kept.get(p)
            if ids is None:
                if len(kept) > self.most:
                    kept.clear()
                ids = model.part(p)
                if len(p) <= 64:
                    kept[p] = ids
            out += ids
        if marks > 1 or not body:
            first = bool(out) and out[0] == model.ids[MARK]
            out[: int(first)] = model.marks(marks - bool(body) + first)
        return tuple(out)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        text = text.replace(" ", MARK)
        if self.model.prefix:
            text = MARK + text
        kept = self.kept
        if len(kept) > self.most:
            kept.clear()
        out: list[int] = []
        for w in self.words(text):
            ids = kept.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= 64:
                    kept[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Texts of the pieces; byte pieces in a row are read as UTF-8, each wrong byte as U+FFFD."""
        model, out, held = self.model, [], bytearray()
        if not hasattr(self, "surfaces"):
            self.surfaces = [p.replace(MARK, " ") if k == NORMAL else "" if k == CONTROL else " ⁇ " if k == UNKNOWN else None for p, k in zip(model.pieces, model.kinds, strict=True)]
        surfaces = self.surfaces
        start = model.prefix
        for i in ids:
            s = surfaces[i]
            if s is None:
                held.append(int(model.pieces[i][3:5], 16))
                start = False
                continue
            if held:
                out.append(_utf8(bytes(held)))
                held.clear()
            out.append(s[1:] if start and model.kinds[i] == NORMAL and s.startswith(" ") else s)
            start = start and model.kinds[i] == CONTROL
        if held:
            out.append(_utf8(bytes(held)))
        return "".join(out)


def _utf8(raw: bytes) -> str:
    """UTF-8 with one U+FFFD for each byte that is no part of a character."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(raw):
            size = 1 if raw[at] < 0x80 else 2 if raw[at] >> 5 == 6 else 3 if raw[at] >> 4 == 14 else 4 if raw[at] >> 3 == 30 else 1
            try:
                out.append(raw[at : at + size].decode())
                at += size
            except UnicodeDecodeError:
                out.append("�")
                at += 1
        return "".join(out)


@lru_cache(maxsize=1)
def loaded(path: str) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path)


def encode_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, ids (array<int>), decoded for docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(vocabulary(model))
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, len(texts), 256):
                ids = [coder.encode(t) for t in texts.slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, 256), pa.array(ids, pa.list_(pa.int32())), pa.array([coder.decode(x) for x in ids], pa.string())], names=["doc_id", "ids", "decoded"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: the digests of ``encode_pieces``, made where the ids are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(vocabulary(model))
        names = [str(i) for i in range(len(coder.model.pieces))]
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column("text"):
                ids = coder.encode(t.as_py())
                n.append(len(ids))
                a.append(hashlib.sha256(",".join([names[i] for i in ids]).encode()).hexdigest())
                b.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_sentencepiece_backtracking(spark, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    return digest_pieces(table(spark, sf_dir, "documents"))
