"""Byte-level BPE by longest matches and backtracking (operator 8).

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the
vocabulary finds all tokens of a piece in one pass. From each position the longest
token is tried first; a token may follow another only if merging their joint bytes
would leave the border between them (``adjacent``, memoised). A position from which no
token leads on is marked and never tried again, so the time is linear in the piece.

Defined results: a null text counts as empty and has no ids; ids of repeated rows are
repeated; null ids of documents are passed through.
"""

from __future__ import annotations

import base64
import hashlib

import ahocorasick
import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, slices, table

NO_LIMIT = 1 << 62
MEMO = 2_000_000
WORDS = 400_000


class ByteBpe:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
        self.pattern = regex.compile(pattern)
        self.ids = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.text = {rank: token for token, rank in self.ids.items()}
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ids.items():
            self.automaton.add_word(token, (rank, len(token)))
        self.automaton.make_automaton()
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``token``, itself twice for a byte; None if merges never make it."""
        if token not in self.parts:
            text = self.text[token]
            parts = list(text)
            while len(parts) > 2:
                rank, at = min((self.ids.get(parts[i] + parts[i + 1], NO_LIMIT), i) for i in range(len(parts) - 1))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.parts[token] = (token, token) if len(text) == 1 else (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 else None
        return self.parts[token]

    def adjacent(self, left: int, right: int) -> bool:
        """Whether merges leave the border between two neighbouring tokens."""
        key = left << 32 | right
        if (known := self.fits.get(key)) is None:
            if len(self.fits) >= MEMO:
                self.fits.clear()
            known = self.fits[key] = self._adjacent(left, right)
        return known

    def _adjacent(self, left: int, right: int) -> bool:
        ids, text = self.ids, self.text
        if self.split(left) is None or self.split(right) is None:
            return False
        limit = NO_LIMIT
        while True:  # undo the later of the merges beside the border, back to single bytes
            if ids.get(text[left] + text[right], NO_LIMIT) < limit:
                return False
            bare_left, bare_right = len(text[left]) == 1, len(text[right]) == 1
            if bare_left and bare_right:
                return True
            if bare_right or not bare_left and left > right:
                limit, left = left, self.split(left)[1]
            else:
                limit, right = right + 1, self.split(right)[0]

    def piece(self, text: str) -> list[int]:
        """Ids of one piece, given as Latin-1 text."""
        if (whole := self.ids.get(text)) is not None:
            return [whole]
        n = len(text)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (token, size) in self.automaton.iter(text):
            starts[end + 1 - size].append((token, end + 1))  # ends ascend, so the longest comes last
        dead = bytearray(n + 1)
        out: list[int] = []
        tried: list[tuple[int, int]] = []
        at, k = 0, len(starts[0])
        while at < n:
            options = starts[at]
            while k:
                k -= 1
                token, end = options[k]
                if not dead[end] and (self.adjacent(out[-1], token) if out else self.split(token) is not None):
                    out.append(token)
                    tried.append((at, k))
                    at = end
                    k = len(starts[at]) if at < n else 0
                    break
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                dead[at] = 1
                out.pop()
                at, k = tried.pop()
        return out

    def _learn(self, word: str) -> bytes:
        if len(self.words) >= WORDS:
            self.words.clear()
        ids = np.array(self.piece(word.encode("utf-8").decode("latin-1")), dtype="<u4").tobytes()
        if len(word) <= 64:
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        get, learn = self.words.get, self._learn
        return b"".join([get(word) or learn(word) for word in self.pattern.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def loaded(path: str, pattern: str = public_tokenizers.PATTERN) -> ByteBpe:
    """One encoder for each Python worker, with its memos."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(id, n_tokens, ids): ids as binary, little-endian unsigned 32-bit integers."""

    def step(keys, texts):
        bpe = loaded(path, pattern)
        for a, b in slices(len(keys), [len(t or "") for t in texts], 8 << 20):
            ids = [bpe.encode(t or "") for t in texts[a:b]]
            yield {"id": keys[a:b], "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

    return map_rows(docs, [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")], step, "id bigint, n_tokens bigint, ids binary")


def decode_documents(encoded: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The rows of ``encode_documents`` with what their ids decode to, as binary."""

    def step(keys, counts, ids):
        bpe = loaded(path, pattern)
        for a, b in slices(len(keys), counts, 2 << 20):
            yield {"id": keys[a:b], "n_tokens": counts[a:b], "ids": ids[a:b], "decoded": [bpe.decode(x) for x in ids[a:b]]}

    return map_rows(encoded, ["id", "n_tokens", "ids"], step, "id bigint, n_tokens bigint, ids binary, decoded binary")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Both directions in one pass, with digests in place of the ids and bytes."""

    def step(keys, texts):
        bpe = loaded(path)
        for a, b in slices(len(keys), [len(t or "") for t in texts], 8 << 20):
            ids = [bpe.encode(t or "") for t in texts[a:b]]
            yield {
                "doc_id": keys[a:b], "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids], "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
            }

    return map_rows(docs, [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")], step, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
