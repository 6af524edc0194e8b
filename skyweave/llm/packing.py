"""Sum-of-squares packing of token sequences (operator 4).

Documents become ids, then pieces of at most ``capacity`` tokens. Pieces are dealt into
groups of bounded size; within a group they are placed, longest first, into the open bin
or a new one such that the sum over gaps g of (number of open bins with gap g) squared is
smallest. Full bins are done; the pieces in bins that stayed open are dealt into fewer
groups and packed again, until one group is left. Where a turn leaves nearly all pieces in
open bins, as their lengths seldom add up, the open bins themselves are packed as items
instead, in fewer groups turn by turn, until few go together any more.

Texts of any length are read in whole. Defined results: a null text counts as empty and is the end mark alone; repeated rows are
packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import map_rows, slices, table, written

CAPACITY = 4096
END = 1
GROUP = 20_000
WORDS = 450_000
#: Longer words are not remembered.
LONG = 64
#: A turn goes on with the same kind of items while it leaves no more than this share of them.
SHRINKS = 0.9

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class WordIds:
    """Ids of texts by a tokenizers file; words of Latin-1 texts are remembered.

    The file's words are found by its own pattern after NFC and lower case. Both leave
    Latin-1 text without control characters as ``str.lower`` does, so for such texts the
    words are split here and each new one is encoded once; other texts go to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and its batches are of short words
        self.tokenizer = Tokenizer.from_file(path)
        kinds = {c: unicodedata.category(c)[0] for c in map(chr, range(256))}
        letter, digit = ("".join(re.escape(c) for c, k in kinds.items() if k == x) for x in "LN")
        self.pattern = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^\s{letter}{digit}]+")
        self.control = bytes([*range(9), *range(11, 32), *range(127, 160)])
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def apart(self, words: list[str]) -> list[bytes]:
        """Ids of single words: encoded as one text with spaces between, and told apart by the library's count of words."""
        out: list[bytes] = []
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            encoding = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids, of = array("I", encoding.ids).tobytes(), np.array(encoding.word_ids)
            cuts = (4 * np.flatnonzero(np.diff(of, prepend=-1, append=-1))).tolist()
            out += [ids[a:b] for a, b in pairwise(cuts)] if len(cuts) == len(part) + 1 else self.whole(part)
        return out

    def plain(self, text: str) -> bool:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return len(raw.translate(None, self.control)) == len(raw) and not any(s in text for s in self.special)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        known, split = self.words, self.pattern.findall
        words = [split(t.lower()) if self.plain(t) else None for t in texts]
        new = list(set().union(*(w for w in words if w)) - known.keys())
        known.update(zip(new, self.apart(new), strict=True))
        out = [self.whole([t])[0] if w is None else b"".join(map(known.__getitem__, w)) for t, w in zip(texts, words, strict=True)]
        for word in new if len(known) > WORDS else (w for w in new if len(w) > LONG):
            del known[word]  # a full table keeps the words that came first, which are the commonest
        return out


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, keep_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary)."""

    def step(keys, texts):
        coder, end = word_ids(path), np.array([END], dtype="<u4").tobytes()
        for a, b in slices(len(keys), [len(t or "") for t in texts], 4 << 20):
            out: list[tuple] = []
            for key, ids in zip(keys[a:b], coder.ids([t or "" for t in texts[a:b]]), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((key, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            yield dict(zip(("doc_id", "piece", "start", "length", "ids_crc32", "ids"), map(list, zip(*out, strict=True)), strict=True))

    return map_rows(docs, [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")], step, PIECES + ", ids binary" * keep_ids)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, in the order given.

    Putting an item of size a into a gap h takes one bin from gap h and adds one to gap
    h - a: the sum of squares changes by 2 (n[h - a] - n[h] + 1). A new bin changes it by
    2 n[capacity - a] + 1, a filled one counts for nothing. Ties go to the smallest gap.
    """
    none = np.iinfo(np.int64).max // 4
    count = np.zeros(capacity + 1, dtype=np.int64)
    taken = np.full(capacity + 1, none)  # minus count, or a bar where no bin has the gap
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(lengths), dtype=np.int64)
    bins = 0
    for i, size in enumerate(lengths.tolist()):
        left = capacity - size
        change = 2 * (count[: left + 1] + taken[size:] + 1)  # by what is left of the gap
        if count[size]:
            change[0] = 1 - 2 * count[size]
        rest = int(change.argmin())
        if (2 * count[left] + 1 if left else 0) < change[rest]:
            bin_, rest = bins, left
            bins += 1
        else:
            gap = rest + size
            bin_ = open_bins[gap].pop()
            count[gap] -= 1
            taken[gap] = -count[gap] if count[gap] else none
        if rest:
            open_bins[rest].append(bin_)
            count[rest] += 1
            taken[rest] = -count[rest]
        out[i] = bin_
    return out


def packed_group(pieces: pa.Table, capacity: int, base: int) -> pa.Table:
    """Adds sequence_id, offset and full to the pieces of one group."""
    order = pc.sort_indices(pieces, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
    pieces = pieces.take(order)
    lengths = pieces["length"].to_numpy()
    bins = sum_of_squares(lengths, capacity)
    filled = np.bincount(bins, weights=lengths).astype(np.int64)
    by_bin = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[by_bin])
    offset = np.empty_like(lengths)
    offset[by_bin] = ends - lengths[by_bin] - (np.cumsum(filled) - filled)[bins[by_bin]]
    return pieces.append_column("sequence_id", pa.array(base + bins)).append_column("offset", pa.array(offset)).append_column("full", pa.array(filled[bins] == capacity))


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """``pieces`` (columns of PIECES) with sequence_id and offset; each group is packed in one task."""
    names = [c.split()[0] for c in PIECES.split(", ")]
    done: list[DataFrame] = []
    todo, left, turn = pieces.select(*names, F.monotonically_increasing_id().alias("row")), pieces.count(), 0
    while True:
        groups = -(-left // group) or 1
        out = packed_groups(todo, groups, capacity, turn)
        before, turn = left, turn + 1
        todo = out.where("not full").select(*names, "row")
        if groups == 1:
            return _all([*done, out]).select(*names, "sequence_id", "offset")
        if (left := todo.count()) > SHRINKS * before:
            return _all([*done, joined(out, capacity, group, turn)]).select(*names, "sequence_id", "offset")
        done.append(out.where("full"))


def packed_groups(todo: DataFrame, groups: int, capacity: int, turn: int) -> DataFrame:
    """Rows dealt by ``row``, so repeated ones spread too, with sequence_id, offset and full."""
    dealt = todo.withColumn("grp", F.pmod(F.xxhash64("row", F.lit(turn)), F.lit(groups)))

    def run(key, part):
        return packed_group(part.drop_columns("grp"), capacity, turn << 54 | key[0].as_py() << 21)

    return written(dealt.groupBy("grp").applyInArrow(run, PIECES + ", row bigint, sequence_id bigint, offset bigint, full boolean"), "packed")


def joined(out: DataFrame, capacity: int, group: int, turn: int) -> DataFrame:
    """``out`` with bins put together by the same rule, where pieces seldom fill one: open bins are the items, until one group is left or few go together."""
    while True:
        bins = out.groupBy("sequence_id").agg(F.sum("length").alias("length")).where(F.col("length") < capacity)
        zero = F.lit(0).cast("bigint")
        items = written(bins.select(F.col("sequence_id").alias("doc_id"), F.lit(0).alias("piece"), zero.alias("start"), "length", zero.alias("ids_crc32"), F.col("sequence_id").alias("row")), "bins")
        before = items.count()
        groups = -(-before // group) or 1
        placed = packed_groups(items, groups, capacity, turn)
        after, turn = placed.select("sequence_id").distinct().count(), turn + 1
        to = placed.select(F.col("doc_id").alias("__bin"), F.col("sequence_id").alias("__to"), F.col("offset").alias("__shift"))
        moved = out.join(to, F.col("sequence_id") == F.col("__bin"), "left").withColumns({"sequence_id": F.coalesce("__to", "sequence_id"), "offset": F.col("offset") + F.coalesce("__shift", zero)})
        out = written(moved.drop("__bin", "__to", "__shift"), "packed")
        if groups == 1 or after > SHRINKS * before:
            return out


def _all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document with its place: sequence_id and offset."""
    return pack(written(token_pieces(docs, path, capacity, id_col=id_col, text_col=text_col), "pieces"), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
