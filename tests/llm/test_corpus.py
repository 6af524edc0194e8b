"""Divergence of sources, resampling and exact search, against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from skyweave.llm import divergence, resampling, top_search

from .fixtures import SCHEMA, clashing, rows, table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed: int, n: int, sources: int = 4) -> list[tuple]:
    rng = random.Random(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + ["É-tude", "Straße", "x" * 500]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words[: rng.choice((5, 40, 203))]) for _ in range(rng.randrange(60)))
        out.append((i, rng.choice((text, text.upper(), None if i % 9 == 0 else text)), rng.choice(("en", "de", None)), rng.choice([f"s{k}" for k in range(sources)] + [None] + ["s0"] * 3), 1))
    return out


# Divergence


def divergence_by_force(data, least, top, scale=divergence.SCALE):
    docs = [(r[2] or "", r[3] or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (r[1] or "").translate(LOWER))) for r in data]
    seen, counts = Counter(), Counter()
    for lang, source, found in docs:
        seen.update({(lang, t) for t in found})
        counts.update((lang, source, t) for t in found)
    out = []
    for lang in {d[0] for d in docs}:
        kept = sorted(t for (x, t), n in seen.items() if x == lang and n >= least)
        groups = sorted({d[1] for d in docs if d[0] == lang})

        def shares(sources, kept=kept, lang=lang):
            n = {t: sum(counts[lang, s, t] for s in sources) for t in kept}
            return {t: 1 + scale * (n[t] + 2) // (sum(n.values()) + 2 * len(kept)) for t in kept}

        all_, own = shares(groups), {s: shares([s]) for s in groups}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in groups:
            pair = [(sum(f(own[s][t], own[o][t]) for t in kept), o) for o in groups if o != s]
            term = [(f(own[s][t], all_[t]), t) for t in kept if counts[lang, s, t] and own[s][t] > all_[t]]
            for part, values, most in (("pair", pair, len(pair)), ("term", term, top)):
                values.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(values[:most])]
    return sorted(out)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


AUDIT = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("least", [1, 3, 10, 400])
def test_divergence_against_its_definition(spark, least):
    data = corpus(5, 300)
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    assert got(divergence.audit(df, least, 7), *AUDIT) == sorted(divergence_by_force(data, least, 7), key=repr)


def test_divergence_bears_odd_rows(spark):
    df = table(spark)
    want = sorted(divergence_by_force(rows(), 2, 10), key=repr)
    assert got(divergence.audit(clashing(df), 2), *AUDIT) == want
    assert divergence.audit(table(spark, []), 2).collect() == []
    with pytest.raises(ValueError):
        divergence.audit(df, 0)


def test_a_group_without_terms_takes_part(spark):
    data = [(i, "alpha beta", "en", "full", 1) for i in range(3)] + [(9, "...", "en", "bare", 1), (10, None, "xx", "y", 1), (11, "", "xx", "z", 1)]
    out = got(divergence.audit(spark.createDataFrame(data, SCHEMA), 2), *AUDIT)
    assert out == sorted(divergence_by_force(data, 2, 10), key=repr)
    assert ("xx", "y", "pair", "z", 0, 1) in out and any(r[1] == "bare" for r in out)


def test_a_narrow_sketch_loses_no_term(spark):
    data = corpus(6, 200)
    df = spark.createDataFrame([(r[1] or "", r[2] or "") for r in data], "text string, lang string").repartition(3)
    seen = Counter()
    for text, lang in ((r[1] or "", r[2] or "") for r in data):
        seen.update({(lang, t) for t in divergence.terms(text)})
    for width, least in ((1 << 4, 10), (1 << 7, 10), (1 << 18, 3), (1 << 7, 300)):
        bits = divergence.possible(df, least, width)
        for (lang, term), n in seen.items():
            (alive,) = divergence.marked(bits, divergence.cells([xxhash.xxh3_64_intdigest(term)], lang, width))
            assert alive or n < least
            if width == 1 << 18:
                assert alive == (n >= least)  # wide enough to be exact here


def test_small_memories_change_nothing(spark, monkeypatch):
    data = corpus(7, 300)
    monkeypatch.setattr(divergence, "ENTRIES", 30)
    df = spark.createDataFrame(data, SCHEMA).repartition(2)
    assert got(divergence.audit(df, 4, 5), *AUDIT) == sorted(divergence_by_force(data, 4, 5), key=repr)


# Resampling


def resampled_by_force(data, target, percent, least_words):
    def feats(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    docs = [(r[0], *feats(r[1])) for r in data]
    s, t = Counter(b for d in docs for b in d[2]), Counter(b for x in target for b in feats(x)[1])
    all_s, all_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in s}
    out = []
    for doc_id, n_words, at in docs:
        weight = sum(gain[b] for b in at) // len(at) if at else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append((doc_id, len(at), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n_words))
    able = sorted((r for r in out if r[4] >= least_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * percent // 100]
    return sorted([(*r[:4], i + 1) for i, r in enumerate(drawn)] + [(*r[:4], None) for r in able[len(drawn) :]] + [(*r[:4], None) for r in out if r[4] < least_words], key=repr)


DRAW = ("doc_id", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize(("percent", "least_words"), [(25, 20), (100, 0), (0, 1), (60, 5)])
def test_resampling_against_its_definition(spark, percent, least_words):
    data = corpus(8, 250)
    data += [(1000 + i, data[3][1], "en", "copy", 1) for i in range(120)]  # a third of all rows have one text
    target = ["wab wcb wdb", "É-tude wab", None, ""]
    docs = spark.createDataFrame(data, SCHEMA).repartition(6)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id bigint, text string")
    assert got(resampling.resample(docs, goal, percent, least_words), *DRAW) == resampled_by_force(data, target, percent, least_words)


def test_resampling_bears_odd_rows(spark):
    goal = spark.createDataFrame([(1, "one two")], "item_id bigint, text string")
    assert got(resampling.resample(clashing(table(spark)), goal, 50, 1), *DRAW) == resampled_by_force(rows(), ["one two"], 50, 1)
    assert resampling.resample(table(spark, []), goal).collect() == []
    data = corpus(9, 40)
    assert got(resampling.resample(spark.createDataFrame(data, SCHEMA), goal.limit(0)), *DRAW) == resampled_by_force(data, [], 25, 20)


def test_copies_are_one_text(spark):
    data = [(i, "same text here " * 5, "en", "s", 1) for i in range(50)] + [(99, "another", "en", "s", 1)]
    texts = {r.copies: r.n_words for r in resampling.collapsed(spark.createDataFrame(data, SCHEMA), "text", 10_000).collect()}
    assert texts == {50: 15, 1: 1}


# Search


VECTORS = "vec_id bigint, embedding array<float>, label int"


def vectors(seed: int, n: int, dims: int = 6) -> list[tuple]:
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(size=dims)], 0) for i in range(n)]


def search_by_force(data, k, every=7, scale=1024):
    fine = {(i, tuple(math.floor(scale * x) for x in v)) for i, v, *_ in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, v in {x for x in fine if x[0] % every == 0}:
        each = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in fine if i != q)
        out += [(q, r + 1, i, min(max(-s, -(2**63)), 2**63 - 1)) for r, (s, i) in enumerate(each[:k])]
    return sorted(out, key=repr)


SEARCH = ("query_id", "rank", "vec_id", "score")


def search(spark, data, k, **more):
    df = spark.createDataFrame(data, VECTORS).repartition(3)
    return got(top_search.top_k(df.where("vec_id % 7 = 0"), df, k, **more), *SEARCH)


@pytest.mark.parametrize(("block", "k"), [(16_384, 10), (100, 10), (9, 3), (40, 1)])
def test_search_against_brute_force(spark, block, k):
    data = vectors(1, 500)
    assert search(spark, data, k, block=block) == search_by_force(data, k)


def test_search_with_ties_copies_and_odd_rows(spark):
    same = [0.5, -0.25, 0.125]
    data = [(i, same, 0) for i in range(60)] + [(100 + i, [0.5 * (i % 3), 0.0, 1.0], 0) for i in range(60)]
    data += [(i, [float(i % 5), float(i % 2)], 0) for i in range(200, 260)]
    data += [(7, same, 0), (301, None, 0), (302, [], 0), (None, same, 0), (303, [1.0, None], 0), (304, [float("nan")], 0), (305, [float("inf"), 1.0], 0), (308, [], 1), (309, [3.0, 4.0, 5.0, 6.0, 7.0], 0)]
    assert search(spark, data, 5, block=50) == search_by_force(data, 5)
    df = clashing(spark.createDataFrame(data, VECTORS))
    assert got(top_search.top_k(df.where("vec_id % 7 = 0"), df, 5), *SEARCH) == search_by_force(data, 5)


def test_search_in_small_and_empty_tables(spark):
    assert search(spark, [], 3) == []
    assert search(spark, [(7, [1.0], 0)], 3) == []
    assert search(spark, [(7, [1.0], 0), (8, [-1.0], 0)], 3) == [(7, 1, 8, -1048576)]
    assert search(spark, [(8, [1.0], 0)], 3) == []


def test_scores_beyond_doubles_are_exact(spark):
    data = [(i, [2.0**20 + i, -(2.0**19), 1.0 + i], 0) for i in range(30)] + [(50 + i, [2.0**40, 2.0 ** (30 + i)], 0) for i in range(3)]
    assert search(spark, data, 4) == search_by_force(data, 4)


def test_segments_are_left_unread_once_the_rest_is_proven_out():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 16))
    x[:40] = x[0] + 0.1 * rng.normal(size=(40, 16))  # near the query
    v = np.floor(1024 * x).astype(np.int64)
    block = top_search.Block(v)
    alive, scores, read = block.possible(v[0], -np.inf, np.ones(4000, dtype=int), 10)
    exact = v @ v[0]
    assert read < 0.6 * v.size
    assert set(np.argsort(-exact, kind="stable")[:10]) <= set(alive.tolist())
    assert (scores == exact[alive]).all()
    none, _, untouched = block.possible(v[0], float(exact.max() * 10), np.ones(4000, dtype=int), 10)
    assert len(none) == 0 and untouched == 0
