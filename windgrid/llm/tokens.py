"""Token ids as the public tokenizer files define them, one text at a time, for use inside tasks.

Each ``*_encoder`` returns a function without arguments to be called in a task; that loads the
vocabulary there and returns the encoder proper. Vocabularies are read where they are installed and
never copied or trained. A null text counts as empty.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable
from functools import lru_cache, partial

import numpy as np


def vocabulary(name: str) -> str:
    """The place of a vocabulary file: a path as it is, a bare name from public_tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _library(name: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def byte_bpe_encoder(end: int | None = None, name: str = "byte_bpe_50k.json", ranks: str = "byte_bpe_50k.tiktoken", special: str = "<|endoftext|>") -> Callable:
    """Ids of the byte-level BPE, with `end` after each text.

    The rank file holds the same vocabulary and merges in the same order, and its library is several
    times faster; a text with the special token's string goes to the tokenizers library itself.
    """

    def load() -> Callable[[list], list[np.ndarray]]:
        import public_tokenizers
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(vocabulary(ranks), "rb"))}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        slow: list = []
        tail = [] if end is None else [end]

        def encode(texts: list) -> list[np.ndarray]:
            out = []
            for text in texts:
                if text and special in text:
                    if not slow:
                        slow.append(_library(name))
                    ids = slow[0].encode(text, add_special_tokens=False).ids
                else:
                    ids = fast.encode_ordinary(text or "")
                out.append(np.array(ids + tail, dtype=np.uint32))
            return out

        return encode

    return load


def word_bpe_encoder(end: int | None = None, name: str = "word_bpe_49k.json") -> Callable:
    """A loader of ``_word_bpe``, for the tasks."""
    return partial(_word_bpe, end, name)


@lru_cache(maxsize=2)
def _word_bpe(end: int | None, name: str) -> Callable[[list], list[np.ndarray]]:
    """Ids of the word BPE, with `end` after each text.

    The vocabulary lower-cases, splits into words and merges within a word only. Its merges are in the
    order of the ids, those of a byte and the word end first. So it is a rank vocabulary over words that
    are each closed by one byte for the word end, which the faster library encodes. That holds for texts
    of characters below U+0180, whose composition and case are the same everywhere, without the closing
    byte; any other text, and one with the string of a special token, goes through the library itself.
    The function is kept for all tasks of a Python worker.
    """
    import json

    import tiktoken

    ends = "\x01"
    with open(vocabulary(name)) as f:
        model = json.load(f)["model"]
    byte_of = _byte_alphabet()
    ranks = {bytes(byte_of[c] for c in t.removesuffix("</w>")) + (ends.encode() if t.endswith("</w>") else b""): i for t, i in model["vocab"].items()}
    joint = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    if len(ranks) != len(model["vocab"]) or [model["vocab"][t] for t in joint] != list(range(512, 512 + len(joint))):
        raise ValueError("the merges of this vocabulary are not in the order of its ids")
    fast = tiktoken.Encoding("words", pat_str=f"[^{ends}]*{ends}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    # letters, single numerals, contractions, runs of other marks; numerals below U+0180 that are no decimal digits are named
    words = re.compile(r"[^\W\d_²³¹¼½¾]+|[\d²³¹¼½¾]|'(?:s|t|re|ve|m|ll|d)|(?:[^\s\w]|_)+").findall
    beyond = re.compile("[^\x00-ſ]").search
    # texts of letters, white space and single stops and commas need no search for words
    unusual = re.compile(r"[^a-zß-öø-ÿœ \n.,]|[.,][.,]").search
    tail = [] if end is None else [end]
    slow: list = []

    def odd(text: str) -> bool:
        # Python counts U+001C to U+001F as white space, the vocabulary's pattern does not
        return "<|" in text or any(c in text for c in "\x01\x1c\x1d\x1e\x1f") or not text.isascii() and beyond(text) is not None

    def encode(texts: list) -> list[np.ndarray]:
        out = []
        for text in texts:
            if text and odd(text):
                if not slow:
                    slow.append(_library(name))
                ids = slow[0].encode(text, add_special_tokens=False).ids
            else:
                lower = (text or "").lower()
                split = words(lower) if unusual(lower) else lower.replace(",", " , ").replace(".", " . ").split()
                ids = fast(ends.join(split) + ends) if split else []
            out.append(np.array(ids + tail, dtype=np.uint32))
        return out

    return encode


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files, and the byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
