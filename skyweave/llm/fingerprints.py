"""Bottom-k sketches of shingle hashes as document fingerprints (operator 3).

A sketch holds the K smallest 64-bit hashes of a document's distinct shingles and, while
the set has no more than K, all of them. The sketch of a union is made from the sketches
of its parts (``merged``), so parts of a text, or many documents, can be sketched apart.
Two sketches give resemblance, containment and the number of distinct shingles.

Defined results: a null text counts as empty; an empty text has the empty fingerprint,
which is like another empty one (1) and unlike all others (0). Rows of the same id follow
each other by the hash of their texts, rows without id come first; equal rows lie in one
range however many they are. Long texts are read in whole.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, rows_of, table
from .shingles import shingle_hashes, words

K = 128
#: Long texts are sketched in parts of so many words.
PART = 100_000
#: Bytes of text in a range of ids, and the most ranges.
RANGE, RANGES = 4 << 20, 20_000


def sketch(text: str | None, k: int = K) -> np.ndarray:
    """The k smallest shingle hashes, ascending."""
    found = words(text)
    if len(found) <= PART:
        return shingle_hashes(found)[:k]
    out = np.empty(0, dtype=np.uint64)
    for at in range(0, len(found) - 4, PART):
        out = merged(out, shingle_hashes(found[at : at + PART + 4])[:k], k)
    return out


def merged(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of the union of what ``a`` and ``b`` were made from."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the Jaccard similarity: how many of the union's smallest hashes both have."""
    if not len(a) and not len(b):
        return 1.0
    union = merged(a, b, k)
    return float(np.isin(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True).sum() / len(union))


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimate of the number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimate of the share of the first set's shingles that the second has."""
    if not len(a):
        return 1.0
    union = distinct(merged(a, b, k), k)
    return float(min(1.0, resemblance(a, b, k) * union / distinct(a, k)))


def packed(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def unpacked(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), dtype="<u8")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(doc_id, fingerprint, distinct_shingles) for each row."""

    def step(ids, texts):
        made = [sketch(t, k) for t in texts]
        yield {"doc_id": ids, "fingerprint": [packed(x) for x in made], "distinct_shingles": [distinct(x, k) for x in made]}

    return map_rows(docs, [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")], step, "doc_id bigint, fingerprint string, distinct_shingles double")


@F.pandas_udf(T.StringType())
def merge_fingerprints(fps: pd.Series) -> str:
    """Grouped aggregate: the fingerprint of a union of sets. Merge by a salted key first where a group is large."""
    out = np.empty(0, dtype=np.uint64)
    for fp in fps.dropna():
        out = merged(out, unpacked(fp))
    return packed(out)


@F.pandas_udf(T.DoubleType())
def fingerprint_resemblance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([resemblance(unpacked(x or ""), unpacked(y or "")) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def fingerprint_containment(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([containment(unpacked(x or ""), unpacked(y or "")) for x, y in zip(a, b, strict=True)], dtype="float64")


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def in_order(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows dealt into ranges of ids, each a partition: (part, own, doc_id, tie, text), sorted.

    There is a range for each RANGE bytes of text, up to RANGES. Rows of one id, or without
    id, that fill several ranges are dealt to them by the hash of their texts, by which they
    are ordered. Each range also gets the first row of the next range, marked as not its own,
    so that every row's successor is in its own range; the last range gets the first of all.
    Only the ranges' bounds and first keys are held by the driver.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 1)).head()[0] or 0
    n = min(RANGES, max(1, -(-size // RANGE)))
    place = F.coalesce("doc_id", F.lit(-(1 << 63)))
    bounds = np.array(rows.agg(F.expr(f"percentile_approx(coalesce(doc_id, {-(1 << 63) + 1}L - 1L), {_shares(n)}, {max(10_000, 10 * n)})")).head()[0] or [], dtype=np.int64) if n > 1 else np.empty(0, np.int64)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series, ties: pd.Series) -> pd.Series:
        low, high = (np.searchsorted(bounds, ids.to_numpy(), side=s) for s in ("left", "right"))
        share = ((ties.to_numpy() >> 32) + (1 << 31)) / (1 << 32)
        return pd.Series(np.where(high - low > 1, low + 1 + (share * (high - low)).astype(np.int64), high).astype("int32"))

    order = F.struct(F.col("doc_id").isNotNull().alias("with_id"), F.col("doc_id"), F.col("tie"))
    tied = rows.withColumn("tie", F.xxhash64("text"))
    keyed = tied.withColumn("part", part_of(place, F.col("tie")))
    firsts = sorted(keyed.groupBy("part").agg(F.min(order).alias("first")).collect(), key=lambda r: r.part)
    before = [(r.first.doc_id, r.first.tie, firsts[i - 1].part) for i, r in enumerate(firsts)]
    also = spark.createDataFrame(before, "f_id bigint, f_tie bigint, part int")
    heads = tied.join(F.broadcast(also), tied.doc_id.eqNullSafe(also.f_id) & (tied.tie == also.f_tie))  # a row for each range
    both = keyed.withColumn("own", F.lit(True)).unionByName(heads.drop("f_id", "f_tie").withColumn("own", F.lit(False)))
    return both.select("part", "own", "doc_id", "tie", "text").repartitionById(n, F.col("part")).sortWithinPartitions("part", F.col("own").desc(), "doc_id", "tie")


def _shares(n: int) -> str:
    return f"array({', '.join(f'{k / n:.8f}D' for k in range(1, n))})"


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that to the next document's."""
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    fields = docs.sparkSession.createDataFrame([], schema).schema

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None  # the last row, with its sketch; rows of a range lie together
        for part, own, doc_id, text in rows_of(b.select(["part", "own", "doc_id", "text"]) for b in batches):
            if held and held[0] != part:
                held = None
            made = sketch(text, k)
            if held:
                yield held[1], held[2], held[3], text, made
            held = (part, doc_id, text, made) if own else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for doc_id, text, made, following, following_made in pairs(batches):
            changed = edited(text, following)
            other = sketch(changed, k)
            out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), packed(made), packed(other), resemblance(made, other, k), resemblance(made, following_made, k)))
            if len(out) == 2000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=fields.names)

    return in_order(docs, id_col, text_col).mapInArrow(run, fields)


_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_likeness(table(spark, sf_dir, "documents"))
