import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from skyweave.llm import exact_dedup, fingerprints, near_dedup
from skyweave.llm.components import components
from skyweave.llm.shingles import shingle_hashes, shingle_set, words

from .fixtures import clashing, edited, prose, rows, table


def brute_components(texts: list) -> list[int]:
    sets = [shingle_set(words(t)) for t in texts]
    above = list(range(len(sets)))

    def top(v):
        while above[v] != v:
            v = above[v]
        return v

    for i, s in enumerate(sets):
        for j in range(i):
            inter = len(s & sets[j])
            if s and sets[j] and 100 * inter >= 75 * (len(s) + len(sets[j]) - inter):
                a, b = sorted((top(i), top(j)))
                above[b] = a
    return [top(i) for i in range(len(sets))]


def test_shingles_are_counted_exactly():
    for t in [None, "", "a", "a b c d", "a b c d e", "A b c d e f", "é É a\x0bb", prose(4, 500) * 3]:
        assert len(shingle_hashes(words(t))) == len(shingle_set(words(t)))
    assert words("A\xa0B C") == ["a\xa0b".encode(), b"c"]


def test_signature_estimates_similarity():
    base = prose(9, 800)
    for changes in (5, 20, 60):
        other = edited(base, 1, changes)
        s, t = shingle_hashes(words(base)), shingle_hashes(words(other))
        true = len(np.intersect1d(s, t)) / len(np.union1d(s, t))
        x, y = (np.array(near_dedup.signature(near_dedup.minima(v)), dtype=np.int64).view(np.uint64) for v in (s, t))
        d = x ^ y
        d |= d >> np.uint64(1)
        d |= d >> np.uint64(2)
        equal = 1 - np.bitwise_count(d & near_dedup._ONES).sum() / near_dedup.PERMS
        estimate = (equal - 1 / 16) / (1 - 1 / 16)
        assert abs(estimate - true) < 0.2


def test_near_groups_match_brute_force(spark):
    data = [r for r in rows() if r[0] is not None and r[0] != 5]
    data += [(100 + s, edited(prose(50, 90), s, s % 12), "en", "s", 1) for s in range(60)]
    out = {r.doc_id: r for r in near_dedup.near_groups(clashing(table(spark, data))).collect()}
    ids = [r[0] for r in data]
    for place, top in enumerate(brute_components([r[1] for r in data])):
        got = out[ids[place]]
        assert got.component_id == min(i for i, t in zip(ids, brute_components([r[1] for r in data]), strict=True) if t == top)
        assert got.n_shingles == len(shingle_set(words(data[place][1])))
        assert got.kept == (got.doc_id == got.component_id)


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "LEFT", (1, 3))
    monkeypatch.setattr(near_dedup, "RIGHT", (1, 5))
    data = [(s, edited(prose(60, 80), s, s % 15), "en", "s", 1) for s in range(80)]
    out = {r.doc_id: r.component_id for r in near_dedup.near_groups(table(spark, data)).collect()}
    tops = brute_components([r[1] for r in data])
    assert [out[r[0]] for r in data] == tops


def test_near_groups_edge_cases(spark):
    out = near_dedup.near_groups(table(spark)).collect()
    assert len(out) == len(rows())
    by = defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert {r.component_id for r in by[7]} == {7} and by[7][0].kept
    assert not by[8][0].kept and by[8][0].component_id == 7
    assert all(by[i][0].kept and by[i][0].n_shingles == 0 for i in (0, 1, 2))
    assert sorted((r.component_id is None, r.kept) for r in by[None]) == [(False, False), (True, True)]
    assert near_dedup.near_groups(table(spark, [])).collect() == []
    kept = near_dedup.drop_near_copies(clashing(table(spark)))
    assert kept.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} <= set(range(40))


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(400 + i, 401 + i) for i in range(60)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    above = {}

    def top(v):
        while above.setdefault(v, v) != v:
            v = above[v]
        return v

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        above[b] = a
    assert all(top(v) == got.get(v, v) for v in above)


@pytest.mark.parametrize("key", [exact_dedup.digest, lambda block: block[:1]])
def test_exact_groups(spark, key):
    """Also with digests that collide all the time."""
    out = exact_dedup.exact_groups(clashing(table(spark)), size=16, key=key).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in rows():
        groups[hashlib.sha256(b"".join((text or "").encode().split())).hexdigest()].append((-len(text or ""), doc_id is None, doc_id))
    assert len(out) == len(rows())
    for r in out:
        best = min(groups[r.text_sha256], key=lambda g: (g[0], g[1], -1 if g[2] is None else g[2]))
        assert r.group_size == len(groups[r.text_sha256]) and r.keep_id == best[2]
    assert sum(r.kept for r in out) == len(groups)
    assert exact_dedup.exact_groups(table(spark, [])).collect() == []


def test_drop_copies(spark):
    df = clashing(table(spark))
    out = exact_dedup.drop_copies(df)
    assert out.columns == df.columns and out.count() == len({b"".join((r[1] or "").encode().split()) for r in rows()})


def test_fingerprints_merge_and_estimate(spark):
    text, other = prose(11, 3000), edited(prose(11, 3000), 3, 150)
    a, b = fingerprints.sketch(text), fingerprints.sketch(other)
    s, t = shingle_set(words(text)), shingle_set(words(other))
    assert abs(fingerprints.resemblance(a, b) - len(s & t) / len(s | t)) < 0.15
    assert abs(fingerprints.distinct(a) / len(s) - 1) < 0.35
    assert abs(fingerprints.containment(a, b) - len(s & t) / len(s)) < 0.25
    found = words(text)
    parts = [fingerprints.sketch(b" ".join(found[i : i + 504]).decode()) for i in range(0, len(found) - 4, 500)]
    whole = parts[0]
    for p in parts[1:]:
        whole = fingerprints.merged(whole, p)
    assert (whole == a).all()
    assert (fingerprints.unpacked(fingerprints.packed(a)) == a).all()
    df = fingerprints.fingerprints(table(spark)).groupBy().agg(fingerprints.merge_fingerprints("fingerprint").alias("m"))
    union = np.empty(0, dtype=np.uint64)
    for r in rows():
        union = fingerprints.merged(union, fingerprints.sketch(r[1]))
    assert df.head().m == fingerprints.packed(union)


def test_long_texts_are_sketched_in_parts(monkeypatch):
    text = prose(12, 900)
    whole = fingerprints.sketch(text)
    monkeypatch.setattr(fingerprints, "PART", 100)
    assert (fingerprints.sketch(text) == whole).all()


def test_edit_likeness(spark):
    data = [r for r in rows() if r[0] is not None and r[0] != 5]
    data = [r for i, r in enumerate(data) if r not in data[:i]]
    out = {r.doc_id: r for r in fingerprints.edit_likeness(clashing(table(spark, data))).collect()}
    data.sort()
    assert len(out) == len(data)
    for i, (doc_id, text, *_) in enumerate(data):
        text, following = text or "", data[(i + 1) % len(data)][1] or ""
        changed = fingerprints.edited(text, following)
        got = out[doc_id]
        assert got.n_chars == len(text) and got.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert got.fingerprint == fingerprints.packed(fingerprints.sketch(text)) and 0 <= got.near_edited <= 1
        assert got.near_next == fingerprints.resemblance(fingerprints.sketch(text), fingerprints.sketch(following))
    assert len(fingerprints.edit_likeness(table(spark)).collect()) == len(rows())
    assert fingerprints.edit_likeness(table(spark, [])).collect() == []


def naive_edit(text: str, following: str) -> str:
    """The contract's words, one code point after the other."""
    n = len(text)
    out = [text[i] for i in range(n - n // 2)]
    for i in range(min(n // 2, len(following))):
        out.append(following[i])
    return "".join(out)


def naive_bottom(text: str, k: int) -> set[int]:
    """The k smallest hashes of a text's shingles, each hashed by itself."""
    return set(sorted({int(shingle_hashes(list(s), 5)[0]) for s in shingle_set(words(text))})[:k])


def naive_likeness(a: set[int], b: set[int], k: int) -> float:
    both = set(sorted(a | b)[:k])
    return len(a & b & both) / len(both) if both else 1.0


@pytest.mark.parametrize("size", [1 << 22, 200])
def test_fingerprints_by_brute_force(spark, monkeypatch, size):
    """In one range, and in many, of which rows without id and rows of one id fill several."""
    monkeypatch.setattr(fingerprints, "RANGE", size)
    data = [(i, prose(i % 23, 3 + 7 * (i % 40)) + " é😀" * (i % 3), "en", "s", 1) for i in range(60)]
    data += [(None, prose(200 + i, 20), None, None, None) for i in range(20)] + [(30, prose(300 + i, 20), "en", "s", 1) for i in range(20)] + [(61, None, None, None, None), (62, "", "en", "s", 0)]
    out = fingerprints.edit_likeness(table(spark, data), k=16).collect()
    assert len(out) == len(data)
    # rows without id and of one id follow each other by a hash that is not known here: any text of theirs may follow
    last = max(r[0] for r in data if r[0] is not None)
    ids = sorted({r[0] for r in data if r[0] is not None})
    texts = {}
    for r in data:
        texts.setdefault(r[0], []).append(r[1] or "")
    seen = []
    for r in out:
        after = texts[None] if r.doc_id == last else texts[ids[0]] if r.doc_id is None else texts[ids[ids.index(r.doc_id) + 1]]
        options = [(t, f) for t in texts[r.doc_id] for f in [*after, *(texts[r.doc_id] if len(texts[r.doc_id]) > 1 else [])]]
        fits = [(t, f) for t, f in options if hashlib.sha256(naive_edit(t, f).encode()).hexdigest() == r.edited_sha256 and len(t) == r.n_chars]
        assert fits
        t, f = fits[0]
        own, other, follows = (naive_bottom(x, 16) for x in (t, naive_edit(t, f), f))
        assert set(fingerprints.unpacked(r.fingerprint).tolist()) == own and set(fingerprints.unpacked(r.edited_fingerprint).tolist()) == other
        assert r.near_edited == naive_likeness(own, other, 16)
        assert any(r.near_next == naive_likeness(own, naive_bottom(f, 16), 16) for _, f in fits)
        seen.append(r.fingerprint)
    assert len(set(seen)) == len({frozenset(naive_bottom(r[1] or "", 16)) for r in data})


def test_recall_at_the_threshold(spark):
    """Pairs whose similarity is just above the threshold, without a third text that links them."""
    data, linked = [], 0
    for s in range(150):
        base = prose(1000 + s, 150)
        other = edited(base, s, 4)
        a, b = shingle_set(words(base)), shingle_set(words(other))
        linked += 100 * len(a & b) >= 75 * len(a | b)
        data += [(2 * s, base, "en", "s", 1), (2 * s + 1, other, "en", "s", 1)]
    out = near_dedup.near_groups(table(spark, data)).collect()
    assert 100 < linked and sum(not r.kept for r in out) == linked


def test_a_sieve_keeps_what_it_is_asked_for(spark):
    from skyweave.llm.common import sieve

    rows_ = spark.range(3000).selectExpr("id", "if(id = 5, null, id) AS k")
    keys = spark.createDataFrame([(None,), (7,), (2999,), (-4,)], "k bigint")
    some, others = sieve(rows_, rows_.k, keys, 1 << 17)
    there = {r.id for r in some.collect()}
    assert {5, 7, 2999} <= there and len(there) < 50 and there.isdisjoint(r.id for r in others.collect()) and others.count() == 3000 - len(there)
