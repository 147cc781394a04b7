"""Public tokenizers over chunks of a text, with a bounded cache per Python worker.

Byte-level BPE never merges across the border before a space that a non-space follows, so a text is
cut there and each distinct chunk is encoded once. The caches only save time: a full one is kept
aside and a new one begun, so what is in use moves over, and the ids are the same.
"""

from __future__ import annotations

import base64
import json
import math
import re

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken

from riskledger.llm import workers

#: Chunks in one generation of a cache, some 60 MB; two generations are held.
CACHE = 250_000
#: Longer chunks are not kept.
LONGEST = 64

BYTE_BPE = "byte_bpe_50k"
PIECES = "piece_bpe_32k"


class Cache(dict):
    """key -> encoded value, worked out when missing."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.encoded(key)
        if len(key) <= LONGEST:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class ByteBpe(Cache):
    """chunk without its leading space -> ids as little-endian 32-bit numbers."""

    def __init__(self, name: str = BYTE_BPE, most: int = CACHE):
        super().__init__(most)
        with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.model = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
            self.added = {x["content"]: int(x["id"]) for x in json.load(f)["added_tokens"]}
        self.is_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")

    def encoded(self, chunk: str) -> bytes:
        return np.array(self.model.encode_ordinary(f" {chunk}"), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers. An added token of the vocabulary is one id wherever it stands."""
        if self.is_added.search(text):
            pieces = self.is_added.split(text)
            return b"".join(np.array([self.added[x]], "<u4").tobytes() if i % 2 else self.plain(x) for i, x in enumerate(pieces) if x)
        return self.plain(text)

    def plain(self, text: str) -> bytes:
        """Ids of a text whose special strings are plain text."""
        parts = text.split(" ")
        if "" in parts or any(map(str.isspace, {p[0] for p in parts})):
            parts = _glued(parts)
        first = np.array(self.model.encode_ordinary(parts[0]), "<u4").tobytes()
        return first + b"".join(map(self.__getitem__, parts[1:]))


def _glued(parts: list[str]) -> list[str]:
    """Join parts that begin with white space, or are empty, to the one before: no border is there."""
    out = [parts[0]]
    for part in parts[1:]:
        if not part or part[0].isspace():
            out[-1] += f" {part}"
        else:
            out.append(part)
    return out


class Words(Cache):
    """word -> how many byte-level ids it has, and its ids in a vocabulary with byte fallback.

    Both as little-endian 16-bit numbers; the count comes first and has MARK added, which no id
    reaches.
    """

    MARK = 1 << 15

    def __init__(self, name: str = PIECES, most: int = CACHE):
        super().__init__(most)
        self.bytewise = ByteBpe()  # its model only
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model"))
        n = self.pieces.get_piece_size()
        if n > self.MARK:
            raise ValueError("ids must be below the mark")
        self.is_byte = np.array([self.pieces.is_byte(i) or self.pieces.is_unknown(i) for i in range(n)])

    def encoded(self, word: bytes) -> bytes:
        text = word.decode()
        counts, n = [], len(self.bytewise.model.encode_ordinary(f" {text}"))
        while n >= 0:  # very long words need several marks
            counts.append(self.MARK + min(n, self.MARK - 1))
            n -= self.MARK - 1
        return np.array([*counts, *self.pieces.encode(text)], "<u2").tobytes()

    def encode(self, words: list[bytes]) -> tuple[int, np.ndarray]:
        """Number of byte-level ids, and the ids with byte fallback, of all words."""
        both = np.frombuffer(b"".join(map(self.__getitem__, words)), "<u2")
        marks = both >= self.MARK
        return int((both[marks] & (self.MARK - 1)).sum(dtype=np.int64)), both[~marks]


def entropy(ids: np.ndarray) -> float:
    """Bits per token of the distribution of ids; 0 for none."""
    if not len(ids):
        return 0.0
    counts = np.bincount(ids) if len(ids) > 2000 else np.unique(ids, return_counts=True)[1]
    counts = counts[counts > 0].astype(float)
    return float(math.log2(len(ids)) - (counts * np.log2(counts)).sum() / len(ids))


def shared(kind: type, name: str):
    """One model and cache per Python worker."""
    return workers.keep((kind.__name__, name), lambda: kind(name))
