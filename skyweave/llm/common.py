"""What the operators share: written tables, Arrow helpers and sieves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import dropped, mark, release, written

__all__ = ["chosen", "dropped", "let", "map_rows", "mark", "release", "rows_of", "same", "sieve", "slices", "small_batches", "table", "threshold", "written"]

#: Bits of a sieve, 8 MB as a bitmap; a bucket of Spark's bitmap functions has 32,768.
SIEVE = 1 << 26
#: Rows of a batch that are Python objects at one time, and of a batch.
ROWS = 500
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of ROWS rows where the session has Spark's default of 10,000: texts are long, and both sides hold whole batches."""
    if spark.conf.get(BATCH) == "10000":
        spark.conf.set(BATCH, str(ROWS))


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of batches, ROWS of them as Python objects at one time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns), strict=True)


def map_rows(df: DataFrame, columns: list, step: Callable[..., Iterator], schema: str) -> DataFrame:
    """``step(*lists)`` over Arrow batches of ``columns``; it yields dicts of lists, one list for each field of ``schema``."""
    spark = df.sparkSession
    small_batches(spark)
    fields = spark.createDataFrame([], schema).schema
    names = fields.names
    types = [pa.binary() if t == "binary" else _ARROW[t] if t in _ARROW else pa.list_(_ARROW[t[6:-1]]) for t in (f.dataType.simpleString() for f in fields)]
    kind = pa.schema(list(zip(names, types, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for out in step(*(c.to_pylist() for c in batch.slice(at, ROWS).columns)):
                    yield pa.RecordBatch.from_arrays([pa.array(out[n], type=t) for n, t in zip(names, types, strict=True)], schema=kind)

    return df.select(*columns).mapInArrow(run, fields)


_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "float": pa.float32(), "binary": pa.binary(),
}


def slices(n: int, weights: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of 0..n of which each holds about ``most`` of weight, to bound what one output batch holds."""
    begin = total = 0
    for i in range(n):
        total += weights[i]
        if total >= most:
            yield begin, i + 1
            begin, total = i + 1, 0
    if begin < n:
        yield begin, n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def same(a: str, b: str):
    """Null-safe equality of two columns by name."""
    return F.col(a).eqNullSafe(F.col(b))


def threshold(most: int, n: int) -> int:
    """Of 63-bit hashes, so many are below this that about ``most`` of ``n`` rows are chosen; above zero whatever ``n`` is."""
    return (1 << 63) - 1 if n <= most else max(1, (most << 63) // n)


def chosen(key: Column, below: Column) -> Column:
    """Whether the hash of a row's key is below a ``threshold``."""
    return F.shiftrightunsigned(F.xxhash64(key), 1) <= below


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def sieve(rows: DataFrame, key: Column, keys: DataFrame, bits: int = SIEVE) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose integer ``key`` may be in the only column of ``keys``, and those whose key is not; null is a key too.

    The keys' hashes are a bitmap of ``bits`` bits, the only thing that is broadcast: its size
    does not follow the data. So what a join needs not move stays where it is; where keys are
    many more than bits, nearly all rows are in the first part, and the join is as without.
    """
    place = lambda c: F.pmod(F.xxhash64(c.cast("bigint")), F.lit(bits)) + 1
    at = keys.select(place(F.col(keys.columns[0])).alias("x")).select(F.bitmap_bucket_number("x").alias("__bucket"), F.bitmap_bit_position("x").alias("__at"))
    maps = written(at.repartition("__bucket").groupBy("__bucket").agg(F.bitmap_construct_agg("__at").alias("__map")), "sieve")
    marked = rows.withColumn("__x", place(key)).withColumn("__bucket", F.bitmap_bucket_number("__x")).join(F.broadcast(maps), "__bucket", "left")
    byte = F.conv(F.hex(F.substr("__map", F.expr("cast(bitmap_bit_position(__x) div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(byte.bitwiseAND(F.expr("shiftleft(1, cast(bitmap_bit_position(__x) % 8 as int))")) != 0, F.lit(False))
    marked = marked.withColumn("__there", there)
    gone = ("__x", "__bucket", "__map", "__there")
    return marked.where("__there").drop(*gone), marked.where("not __there").drop(*gone)
