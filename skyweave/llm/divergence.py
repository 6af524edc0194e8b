"""How far the sources of a language diverge in their terms (operator 11).

Terms that few documents hold decide nothing, but they are most of the terms. So a first
pass adds up a count-min sketch of document frequencies for each task, two rows of
saturating counters; merged, it never underestimates, and what it still puts below
``least`` documents cannot be kept. A bitmap of the counters that reach ``least`` is all
that is sent to the second pass, which drops impossible terms before it sends anything,
and counts the rest exactly, summed up by task, language and source. The sketch grows with
the text up to a bound (2 x 2^25 counters); beyond it fewer terms are dropped early, and
results stay exact.

A pair of sources adds a divergence for each kept term of its language. Terms that neither
has add the same value, those that one has depend on its count alone and are summed by
count; so only terms that both have are joined, on (language, term).

Shares are ``1 + floor(scale * (count + 2) / (all + 2 * terms))``, all arithmetic is on
integers (decimals of 38 digits where products need them).

Defined results: null texts, languages and sources count as empty; a group without terms takes part with counts of 0; a language without kept terms has pairs of
value 0 and no terms; a language with one source has no pairs; repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows_of, small_batches, table, written
from .shingles import mixed

LEAST = 10
SCALE = 1_000_000_000
TOP = 10
#: Counters of a row of the sketch, as a power of two: a counter for each 16 bytes of text, within bounds.
NARROW, WIDE = 16, 25
ROWS = 2
#: Counters that are sent together.
CHUNK = 1 << 16
#: Pairs of document and term that a task holds, as numbers, before it adds them up.
ENTRIES = 1_000_000
#: Bytes of terms: letters (capitals become small) and all that is not ASCII; the rest parts terms.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    r"""Matches of [^\x00-\x40\x5B-\x60\x7B-\x7F]+ after A-Z became a-z."""
    return text.encode("utf-8").translate(_TERM).split() if text else []


def cells(hashes: list[int], lang: str, width: int) -> np.ndarray:
    """(ROWS, n): the counters of terms of a language in each row of the sketch; ``width`` is a power of two."""
    h = mixed(np.array(hashes, dtype=np.uint64) ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8"))))
    return np.stack([((h >> np.uint64(32 * row)) & np.uint64(width - 1)).astype(np.int64) + row * width for row in range(ROWS)])


class Vocabulary(dict):
    """Numbers of terms, in the order in which they are first asked for."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number

    def cells(self, lang: str, width: int) -> np.ndarray:
        return cells(list(map(xxhash.xxh3_64_intdigest, self)), lang, width)


def possible(rows: DataFrame, least: int, width: int) -> np.ndarray:
    """Packed bits of the merged sketch's counters: whether each reaches ``least``."""
    most = max(255, least)
    kind = np.uint8 if most <= 255 else np.uint32

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(ROWS * width, dtype=kind)
        seen: dict[str, tuple[Vocabulary, list[np.ndarray]]] = {}

        def add() -> None:
            for lang, (known, found) in seen.items():
                docs = np.bincount(np.concatenate(found), minlength=len(known))
                at, place = np.unique(known.cells(lang, width).ravel(), return_inverse=True)
                more = np.bincount(place, weights=np.tile(docs, ROWS))
                counts[at] = np.minimum(counts[at] + more, most)
            seen.clear()

        size = 0
        for lang, text in rows_of(batches):
            if distinct := set(terms(text)):
                known, found = seen.setdefault(lang, (Vocabulary(), []))
                found.append(np.fromiter(map(known.__getitem__, distinct), dtype=np.int32, count=len(distinct)))
                size += len(distinct)
                if size > ENTRIES:
                    add()
                    size = 0
        add()
        for chunk in range(0, len(counts), CHUNK):
            part = counts[chunk : chunk + CHUNK]
            if len(at := np.flatnonzero(part)):
                yield pa.RecordBatch.from_arrays([pa.array([chunk // CHUNK], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([part[at].astype("<u4" if most > 255 else "u1").tobytes()], pa.binary())], names=["chunk", "at", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for chunk, raw_at, raw_n in rows_of(batches):
            part = sums.setdefault(chunk, np.zeros(CHUNK, dtype=kind))
            at = np.frombuffer(raw_at, dtype="<u2")
            part[at] = np.minimum(part[at].astype(np.int64) + np.frombuffer(raw_n, dtype="<u4" if most > 255 else "u1"), most)
        for chunk, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([np.packbits(part >= least, bitorder="little").tobytes()], pa.binary())], names=["chunk", "bits"])

    sketches = rows.select("lang", "text").mapInArrow(sketch, "chunk int, at binary, n binary")
    merged = sketches.repartition("chunk").mapInArrow(merge, "chunk int, bits binary")
    out = np.zeros(ROWS * width // 8, dtype=np.uint8)
    for chunk, bits in merged.collect():  # 8 KB for each chunk, 8 MB at most
        part = np.frombuffer(bytes(bits), dtype=np.uint8)[: len(out) - chunk * CHUNK // 8]
        out[chunk * CHUNK // 8 : chunk * CHUNK // 8 + len(part)] = part
    return out


def marked(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether all counters of each term are set."""
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def term_counts(rows: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents, of all terms that may be in ``least`` documents of the language."""
    spark = rows.sparkSession
    small_batches(spark)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    width = 1 << min(WIDE, max(NARROW, (size // 16).bit_length()))
    sieve = spark.sparkContext.broadcast(possible(rows, least, width))
    names = ["lang", "source", "term", "n", "docs"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Vocabulary] = {}
        groups: dict[tuple[str, str], tuple[list[np.ndarray], list[np.ndarray]]] = {}

        def send() -> Iterator[pa.RecordBatch]:
            alive = {lang: marked(sieve.value, v.cells(lang, width)) for lang, v in known.items()}
            text = {lang: pa.array([t.decode("utf-8") if fine else None for t, fine in zip(v, alive[lang].tolist(), strict=True)], pa.string()) for lang, v in known.items()}
            for (lang, source), (ids, n) in groups.items():
                each, place, docs = np.unique(np.concatenate(ids), return_inverse=True, return_counts=True)
                total = np.bincount(place, weights=np.concatenate(n)).astype(np.int64)
                keep = alive[lang][each]
                same = [pa.repeat(pa.scalar(x, pa.string()), int(keep.sum())) for x in (lang, source)]
                whole = pa.RecordBatch.from_arrays([*same, text[lang].take(pa.array(each[keep])), pa.array(total[keep], pa.int64()), pa.array(docs[keep], pa.int64())], names=names)
                yield from (whole.slice(at, 10_000) for at in range(0, whole.num_rows, 10_000))
            groups.clear()
            known.clear()

        pending = 0
        for lang, source, text in rows_of(batches):
            if found := terms(text):
                number = known.setdefault(lang, Vocabulary()).__getitem__
                each, n = np.unique(np.fromiter(map(number, found), dtype=np.int32, count=len(found)), return_counts=True)
                ids, counts = groups.setdefault((lang, source), ([], []))
                ids.append(each)
                counts.append(n.astype(np.int32))
                pending += len(each)
                if pending > ENTRIES:
                    yield from send()
                    pending = 0
        yield from send()

    each = rows.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n bigint, docs bigint")
    return each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: str, total: str, kept: str, scale: int) -> Column:
    """``1 + floor(scale * (count + 2) / (total + 2 * kept))`` of expressions."""
    return F.expr(f"cast(cast({scale} as decimal(19,0)) * ({count} + 2) div ({total} + 2 * {kept}) as bigint) + 1")


def apart(p: str, q: str) -> str:
    """``floor((p - q)^2 / (p + q))`` of long expressions, as SQL."""
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP, scale: int = SCALE, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` and ``term``."""
    if least < 1:
        raise ValueError("least must be at least 1")
    text = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(text(lang_col, "lang"), text(source_col, "source"), text(text_col, "text"))
    counts = written(term_counts(rows, least), "term-counts")
    total = counts.groupBy("lang", "term").agg(F.sum("n").alias("all_n"), F.sum("docs").alias("d")).where(F.col("d") >= least).drop("d")
    kept = written(counts.drop("docs").join(total, ["lang", "term"]), "kept-terms")  # a row for each group that has the term
    of_lang = kept.dropDuplicates(["lang", "term"]).groupBy("lang").agg(F.count("*").alias("v"), F.sum("all_n").alias("lang_n"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = rows.select("lang", "source").distinct().join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").na.fill(0, ["v", "lang_n", "group_n"])
    groups = written(groups.withColumn("p0", F.when(F.col("v") > 0, share("0", "group_n", "v", scale)).otherwise(1)), "term-groups")

    with_group = kept.join(groups, ["lang", "source"]).withColumn("p", share("n", "group_n", "v", scale)).withColumn("q", share("all_n", "lang_n", "v", scale))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    high = with_group.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(apart("p", "q")).alias("value"))
    high = high.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    one = groups.select("lang", F.col("source").alias("x"), F.col("p0").alias("x0"), "v")
    other = groups.select("lang", F.col("source").alias("y"), F.col("p0").alias("y0"))
    ordered = one.join(other, "lang").where("x < y").select("lang", "x", "y", F.expr(f"v * {apart('x0', 'y0')}").alias("value"))  # the rows of the answer, once
    levels = with_group.groupBy("lang", F.col("source").alias("x"), F.col("p0").alias("x0"), "p").agg(F.count("*").alias("k"))
    single = levels.join(other, "lang").where("x <> y").select("lang", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"), F.expr(f"k * ({apart('p', 'y0')} - {apart('x0', 'y0')})").alias("value"))
    mine = with_group.select("lang", "term", F.col("source").alias("x"), F.col("p0").alias("x0"), "p")
    yours = with_group.select("lang", "term", F.col("source").alias("y"), F.col("p0").alias("y0"), F.col("p").alias("q"))
    more = F.expr(f"{apart('p', 'q')} - {apart('p', 'y0')} - {apart('x0', 'q')} + {apart('x0', 'y0')}")
    both = mine.join(yours, ["lang", "term"]).where("x < y").select("lang", "x", "y", more.alias("value"))
    sums = ordered.unionByName(single).unionByName(both).groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    pairs = sums.select("lang", "value", ways.alias("w")).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(high).select("lang", "source", "part", "item", "value", "rank")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
with d as (
    select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
    from documents
), t as (select r, lang, source, unnest(w) as term from d),
kept as (select lang, term, count(*) as all_n from t group by all having count(distinct r) >= 10),
n as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by all),
grp as (select distinct lang, source from d),
tot as (select lang, source, sum(n) as group_n from n group by all),
lan as (select lang, count(*) as v, sum(all_n) as lang_n from kept group by all),
p as (
    select grp.lang, grp.source, term, coalesce(n, 0) as n,
        1 + (1000000000 * (coalesce(n, 0) + 2)::hugeint) // (coalesce(group_n, 0) + 2 * v)::hugeint as p,
        1 + (1000000000 * (all_n + 2)::hugeint) // (lang_n + 2 * v)::hugeint as q
    from grp join kept using (lang) join lan using (lang) left join tot using (lang, source) left join n using (lang, source, term)
), val as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(sum((pa.p - pb.p) * (pa.p - pb.p) // (pa.p + pb.p)), 0) as value
    from grp a join grp b on a.lang = b.lang and a.source <> b.source
    left join p pa on pa.lang = a.lang and pa.source = a.source left join p pb on pb.lang = b.lang and pb.source = b.source and pb.term = pa.term
    where pa.term is null or pb.term is not null group by all
    union all select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from p where n > 0 and p > q
), ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from val)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from ranked where part = 'pair' or rank <= 10
"""
