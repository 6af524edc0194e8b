"""Target-distribution importance resampling of documents (operator 12).

Features are runs of one and two words, hashed into buckets. A bucket's gain is the scaled
log of its share in the target over its share in the corpus, both smoothed; a text's weight
is the mean gain of its features, and documents are drawn without replacement by weight
plus Gumbel noise, the highest first.

Identical texts are grouped by the full text, each task's copies before anything moves;
features are computed and weighted once for each distinct text, counted with its
multiplicity, and weights go back to the documents before the noise, which hangs on the
document's id alone. The join back is on the text's SHA-256; its document side is a plain
exchange, which Spark can split where a third of all documents share a text.

The draw is a rank over all documents: rows are dealt by ranges of the order, and places
within ranges are shifted by the ranges' counts, so no task sees more than its range.

Defined results: a null text counts as empty and has no features, weight 0 and no rank;
an id that is null counts as no digits in the noise and comes last among ties; each row is a
document, also where rows or ids repeat; without a target all gains follow from smoothing.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, rows_of, slices, table, written

BUCKETS = 10_000
#: Words whose hash a task remembers.
WORDS = 200_000
#: Bytes of words: digits, letters (capitals become small) and all that is not ASCII; the rest parts words.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z became a-z."""
    return text.encode("utf-8").translate(_WORD).split() if text else []


def features(found: list[bytes], known: dict[bytes, int], buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of all runs of one and two words; a run's CRC continues that of its first word."""
    if len(known) > WORDS:
        known.clear()
    crc = zlib.crc32
    single = []
    for word in found:
        if (h := known.get(word)) is None:
            h = known[word] = crc(word)
        single.append(h)
    double = [crc(b" " + word, h) for h, word in zip(single, found[1:], strict=False)]
    return np.fromiter(single + double, dtype=np.int64, count=len(single) + len(double)) % buckets


def collapsed(docs: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """(key, copies, n_words, n_features, features): a row for each distinct text."""
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).groupBy("text").agg(F.count("*").alias("copies"))

    def step(found, copies) -> Iterator[dict]:
        known: dict[bytes, int] = {}
        for a, b in slices(len(found), [len(t) for t in found], 2 << 20):
            each = [words(t) for t in found[a:b]]
            at = [features(w, known, buckets) for w in each]
            yield {
                "key": [hashlib.sha256(t.encode("utf-8")).digest() for t in found[a:b]], "copies": copies[a:b], "n_words": [len(w) for w in each],
                "n_features": [len(x) for x in at], "features": [x.astype("<u2" if buckets <= 1 << 16 else "<u4").tobytes() for x in at],
            }

    return map_rows(texts, ["text", "copies"], step, "key binary, copies bigint, n_words bigint, n_features bigint, features binary")


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all documents; a task sends one row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for copies, raw in rows_of(batches):
            total += copies * np.bincount(np.frombuffer(raw, dtype="<u2" if buckets <= 1 << 16 else "<u4"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in texts.select("copies", "features").mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """``floor(1000 ln(...))`` of the smoothed shares of each bucket in the target and in the corpus."""
    n = len(corpus)
    all_corpus, all_target = float(corpus.sum()) + n, float(target.sum()) + n
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_corpus / ((s + 1.0) * all_target))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def weighted(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) for each row of ``docs``."""
    texts = written(collapsed(docs, text_col, buckets), "resample-texts")
    gain = gains(bucket_counts(texts, buckets), bucket_counts(collapsed(target, text_col, buckets), buckets))

    def step(keys, n_words, n_features, raw) -> Iterator[dict]:
        kind = "<u2" if buckets <= 1 << 16 else "<u4"
        yield {"key": keys, "n_words": n_words, "n_features": n_features, "weight": [int(gain[np.frombuffer(x, dtype=kind)].sum()) // n if n else 0 for x, n in zip(raw, n_features, strict=True)]}

    weights = map_rows(texts, ["key", "n_words", "n_features", "features"], step, "key binary, n_words bigint, n_features bigint, weight bigint")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)).alias("key"))
    return rows.join(weights.hint("merge"), "key").drop("key")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of the SHA-256 of ``seed:id``."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substr(F.sha2(text, 256), F.lit(1), F.lit(8)), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("bigint")


def ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``rows`` with rank 1, 2, 3... in ``order``: ranges of the order, then a shift for each range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = written(placed, "ranked").withColumn("__range", F.shiftright("__at", 33))
    before, shifts = 0, []
    for r in placed.groupBy("__range").count().orderBy("__range").collect():  # a row for each range
        shifts.append((r["__range"], before))
        before += r["count"]
    shift = rows.sparkSession.createDataFrame(shifts, "__range bigint, __before bigint")
    place = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(shift), "__range").withColumn("rank", place).drop("__at", "__range", "__before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank): the drawn documents are those with a rank."""
    scored = weighted(docs, target, id_col, text_col, buckets)
    scored = written(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resample-scores")
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    best = ranked(able, [F.desc("score"), F.asc_nulls_last("doc_id")])
    best = best.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return best.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_SPLIT = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

OP12_SQL = f"""
with recursive bits as (
    select i as byte, i as c, 0 as k from range(256) r(i)
    union all select byte, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from bits where k < 8
), crc_table as (select byte, c from bits where k = 8),
split as (
    select 0 as side, doc_id, row_number() over () as r, {_SPLIT} as w from documents
    union all select 1, null, row_number() over (), {_SPLIT} from benchmark
), listed as (select side, doc_id, r, len(w) as n_words, list_concat(w, [w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) as f from split),
feature as (select side, r, unnest(f) as f from listed),
bytes as (select f, hex(encode(f)) as h from (select distinct f from feature)),
running as (
    select f, h, 0 as k, 4294967295::bigint as c from bytes
    union all select f, h, k + 1, xor(x.c >> 8, t.c) from running x join crc_table t on t.byte = xor(x.c & 255, ('0x' || substr(h, 2 * k + 1, 2))::bigint)
    where k < length(h) // 2
), bucketed as (select f, xor(c, 4294967295) % 10000 as b from running where k = length(h) // 2),
of_row as (select side, r, b, count(*) as n from feature join bucketed using (f) group by all),
counted as (select b, coalesce(sum(n) filter (side = 0), 0) as s, coalesce(sum(n) filter (side = 1), 0) as t from of_row group by b),
gain as (select b, cast(floor(1000 * ln((t + 1)::double * (sum(s) over () + 10000)::double / ((s + 1)::double * (sum(t) over () + 10000)::double))) as bigint) as g from counted),
mean as (select r, sum(n * g) as total, sum(n) as n from of_row join gain using (b) where side = 0 group by r),
weighted as (
    select doc_id, n_words, len(f) as n_features,
        coalesce(cast((total - ((total % n) + n) % n) / n as bigint), 0) as weight
    from listed left join mean using (r) where side = 0
), scored as (
    select *, weight + cast(floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296))) as bigint) as score from weighted
), placed as (
    select *, row_number() over (partition by n_words >= 20 order by score desc, doc_id) as place, count(*) filter (n_words >= 20) over () as able from scored
)
select doc_id, n_features, weight, score, case when n_words >= 20 and place <= 25 * able // 100 then place end as rank from placed
"""
