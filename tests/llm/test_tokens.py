import base64
import random
import zlib

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyweave.llm import bpe, packing

from .fixtures import clashing, prose, rows, table

MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


LIBRARY = library()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_same_ids_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode("utf-8")
    coder = bpe.loaded(MULTI)
    ids = coder.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode_ordinary(text)
    assert coder.decode(ids) == text.encode()


def test_long_pieces_take_linear_time():
    rng = random.Random(3)
    text = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    assert np.frombuffer(bpe.loaded(MULTI).encode(text), "<u4").tolist() == LIBRARY.encode_ordinary(text)


def test_encode_and_decode_documents(spark):
    encoded = bpe.encode_documents(clashing(table(spark)), MULTI)
    out = bpe.decode_documents(encoded, MULTI).collect()
    assert sorted(bytes(r.decoded) for r in out) == sorted((r[1] or "").encode() for r in rows())
    assert all(r.n_tokens == len(LIBRARY.encode_ordinary(bytes(r.decoded).decode())) for r in out)
    assert bpe.round_trip_digests(table(spark, []), MULTI).collect() == []


def test_word_ids_are_the_library_s():
    coder, plain = packing.WordIds(WORD), Tokenizer.from_file(WORD)
    texts = ["", "Don't STOP 12 déjà vu!", "Σίσυφος Σ", "a\x85b\x1cc", "<|endoftext|> x", "tab\tnew\nline", "naïve café ½²", "é", *(r[1] or "" for r in rows())]
    got = coder.ids(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_sum_of_squares_against_the_definition():
    rng = np.random.default_rng(2)
    for lengths in (rng.integers(1, 20, size=200), np.full(30, 7), np.array([20, 20, 1])):
        got = packing.sum_of_squares(lengths, 20)
        gaps: list[int] = []
        for size, bin_ in zip(lengths, got, strict=True):
            options = []
            for gap in sorted({g for g in gaps if g >= size} | {20 if 20 not in gaps else -1} - {-1}):
                after = [g for g in gaps]
                if gap in after:
                    after.remove(gap)
                after.append(gap - size)
                options.append(sum(after.count(h) ** 2 for h in range(1, 21)))
            new = [*gaps, 20 - size]
            options.append(sum(new.count(h) ** 2 for h in range(1, 21)))
            if bin_ == len(gaps):
                gaps.append(20)
            gaps[bin_] -= size
            assert gaps[bin_] >= 0 and sum(gaps.count(h) ** 2 for h in range(1, 21)) == min(options)


def test_packing(spark):
    data = [*rows(), (77, prose(6, 7000), "en", "s", 1), *((200 + i, prose(i, 5 + i), "en", "s", 1) for i in range(150))]
    out = packing.pack_documents(clashing(table(spark, data)), WORD, capacity=128).collect()
    plain = Tokenizer.from_file(WORD)
    whole = {i: plain.encode(t or "", add_special_tokens=False).ids + [1] for i, t, *_ in data if i not in (5, 7, None)}
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append(r)
        if r.doc_id in whole:
            ids = whole[r.doc_id][r.start : r.start + r.length]
            assert len(ids) == r.length and zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
            assert r.start == 128 * r.piece and (r.length == 128 or r.start + r.length == len(whole[r.doc_id]))
    for pieces in bins.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 128
    total = sum(r.length for r in out)
    assert len(bins) <= 1.03 * -(-total // 128) + 1
    assert packing.pack_documents(table(spark, []), WORD).collect() == []


def test_groups_of_pieces_cost_no_more_sequences(spark):
    data = [(i, prose(i, 3 + i % 50), "en", "s", 1) for i in range(400)]
    pieces = packing.token_pieces(table(spark, data), WORD, 256)
    one, many = packing.pack(pieces, 256), packing.pack(pieces, 256, group=60)
    count = lambda df: df.select("sequence_id").distinct().count()
    assert many.count() == one.count() == pieces.count() and count(many) <= count(one) + 8


def test_bins_are_joined_where_pieces_seldom_fill_one(spark):
    """Three pieces of 33 leave one of 100 open; each group leaves bins that go together."""
    data = [(i % 3, 0, 0, 33 if i % 7 else 20, 0) for i in range(1000)]
    pieces = spark.createDataFrame(data, packing.PIECES)
    out = packing.pack(pieces, 100, group=17).collect()
    assert len(out) == len(data)
    bins = {}
    for r in out:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 100
    best = len(set(packing.sum_of_squares(np.array(sorted((r[3] for r in data), reverse=True)), 100)))
    assert len(bins) <= 1.05 * best + 1


def test_repeated_pieces_spread_over_groups(spark):
    pieces = spark.createDataFrame([(1, 0, 0, 60, 7)] * 200, packing.PIECES)
    out = packing.packed_groups(pieces.selectExpr("*", "monotonically_increasing_id() AS row"), 10, 100, 0)
    assert out.selectExpr("shiftright(sequence_id, 21) AS g").groupBy("g").count().agg({"count": "max"}).head()[0] < 50
