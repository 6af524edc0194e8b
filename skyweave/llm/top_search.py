"""Exact top-k search by inner product over an impact-ordered index (operator 13).

Vectors become integers, ``floor(scale * x)``. Equal vectors are one class with its
smallest ids, as many as an answer can name, so a vector that a third of all rows repeat
is indexed once. Classes are dealt by hash into blocks of bounded size. In a block each
dimension has its classes in order of their component, cut into segments of nearly equal
impact; a query takes the segments of all dimensions by descending gain over the least
that the dimension can give, and adds the gain to the score of each class in the segment.
Before the next segment, of gain g, a class whose sum is s and that was met in m of the d
dimensions begun scores at most ``base + s + (d - m) * g`` and what the others can give. When few classes can still reach the
threshold, all others are proven out; those that can are scored exactly from their vectors.

The threshold is the query's k-th exact score in the first block, which is of bounded
size and is sent to all queries; with it each block of queries meets each other block of
the index by an equality join on the block's number.

Defined results: a row with a null id, or whose vector is null or holds a null or
non-finite component, takes no part; shorter vectors are filled up with zeros, so an empty
one scores zero; a repeated row counts once, and an id with several vectors is asked and
found for each of them, never by itself; scores beyond 64 bits become the nearest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_rows, table, written

#: Classes of a block of the index, and queries of a block.
BLOCK = 16_384
QUERIES = 128
#: Segments of a dimension, and slices of a query's postings after which its bound is looked at.
LEVELS = 32
STEPS = 16
#: Copies of the first block, each for a share of the queries.
COPIES = 256
LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component as long; null where the vector takes no part."""
    x = vector.cast("array<double>")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.when(fine, F.transform(x, lambda c: F.floor(c * scale).cast("bigint")))


class Block:
    """Segments of one block of the index: ``order`` has each dimension's classes by ascending component."""

    def __init__(self, vectors: np.ndarray):
        n, dims = vectors.shape
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T
        ordered = np.take_along_axis(vectors.T, self.order, axis=1)
        low, high = (ordered[:, :1], ordered[:, -1:]) if n else (np.zeros((dims, 1)), np.zeros((dims, 1)))
        width = (high - low) / LEVELS
        level = np.minimum(LEVELS - 1, ((ordered - low) / np.where(width > 0, width, 1)).astype(np.int64))
        self.starts = np.array([np.searchsorted(row, np.arange(LEVELS + 1)) for row in level]).reshape(dims, LEVELS + 1)
        self.size = np.diff(self.starts, axis=1)
        self.full = self.size > 0
        first, last = np.minimum(self.starts[:, :-1], max(n - 1, 0)), np.maximum(self.starts[:, 1:] - 1, 0)
        self.low, self.high = (np.take_along_axis(ordered, at, axis=1) if n else np.zeros((dims, LEVELS)) for at in (first, last))

    def exact(self, query: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.vectors[at] @ query

    def possible(self, query: np.ndarray, least: float, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(classes, scores, postings): all classes whose exact score may be among the ``k`` best and at least ``least``; how many postings were read."""
        n = len(self.vectors)
        used = np.flatnonzero(query)
        q = query[used][:, None].astype(np.float64)
        low, high, full = self.low[used], self.high[used], self.full[used]
        gain = np.where(q > 0, q * high, q * low)
        floor = np.where(full, np.where(q > 0, q * low, q * high), np.inf).min(axis=1, initial=np.inf) if n else np.zeros(len(used))
        base = floor.sum()
        gain = np.where(full, gain - floor[:, None], 0)
        none = np.empty(0, dtype=np.int64)
        if not n or base + gain.max(axis=1, initial=0).sum() < least:
            return none, none, 0
        dim, level = np.nonzero(full)
        by_gain = np.argsort(-gain[dim, level], kind="stable")
        dim, level = dim[by_gain], level[by_gain]
        gains = gain[dim, level]
        begins, sizes = self.starts[used][dim, level], self.size[used][dim, level]
        ends = np.cumsum(sizes)
        cuts = np.searchsorted(ends, np.arange(1, STEPS + 1) * (ends[-1] / STEPS if len(ends) else 0)) + 1
        top = gain.max(axis=1)
        share = float(len(used) + 1)  # sums and numbers of segments met go into one number
        both = np.zeros(n)
        alive, read, at = np.arange(n), 0, 0
        for step, cut in enumerate(np.minimum(cuts, len(gains))):
            if cut > at:
                postings = np.concatenate([self.order[used[dim[i]], begins[i] : begins[i] + sizes[i]] for i in range(at, cut)])
                both += np.bincount(postings, weights=np.repeat(gains[at:cut] * share + 1, sizes[at:cut]), minlength=n)
                read, at = read + len(postings), cut
            rest = gains[at] if at < len(gains) else 0.0
            total = np.floor(both / share)
            met = both - total * share
            begun = top > rest
            upper = base + total + (begun.sum() - met) * rest + top[~begun].sum()
            if step % 4 == 1:  # the best so far, scored exactly, may raise the threshold
                some = np.argpartition(-upper, k - 1)[:k] if n > k else np.arange(n)
                each = np.sort(np.repeat(self.exact(query, some), np.minimum(counts[some], k)))[::-1]
                least = max(least, each[k - 1]) if len(each) >= k else least
            alive = np.flatnonzero(upper >= least)
            if at == len(gains) or len(alive) <= max(4 * k, n // 32):
                break
        return alive, self.exact(query, alive), read

    def best(self, query: np.ndarray, least: float, ids: list[list[int]], counts: np.ndarray, k: int) -> list[tuple[int, int]]:
        """(id, score) of the ``k`` best, ties to smaller ids; those below ``least`` may be left out."""
        if len(self.vectors) and max(1, query.size) * float(np.abs(query).max(initial=0)) * float(np.abs(self.vectors).max(initial=0)) * 4 * (len(query) + 1) >= 2.0**52:  # beyond exact doubles
            alive = np.arange(len(self.vectors))
            scores = [min(max(int(s), LONG[0]), LONG[1]) for s in self.vectors.astype(object) @ query.astype(object)]
        else:
            alive, scores, _ = self.possible(query, least, counts, k)
        if len(alive) > 4 * k:
            scores = np.asarray(scores)
            border = np.partition(scores, len(scores) - k)[len(scores) - k]
            alive, scores = alive[scores >= border], scores[scores >= border]
        found = sorted((-int(s), i) for c, s in zip(alive.tolist(), scores, strict=True) for i in ids[c])
        return [(i, -s) for s, i in found[:k]]


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """(h, v, ids): each distinct vector with its ``k`` least ids; of hot vectors each task sends ``k`` ids at most."""
    order = Window.partitionBy("h", "v").orderBy("id")
    least = rows.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= k)
    return least.groupBy("h", "v").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def _matrix(flat: list[list[int]], dims: int) -> np.ndarray:
    out = np.zeros((len(flat), dims), dtype=np.int64)
    for i, v in enumerate(flat):
        out[i, : len(v)] = v
    return out


def _small(x: np.ndarray) -> bytes:
    """The array in the fewest bytes a number that hold it, with their count before it."""
    most = int(np.abs(x).max(initial=0))
    width = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    return bytes([width]) + x.astype(f"<i{width}").tobytes()


def _wide(raw: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<i{raw[0]}", offset=1).astype(np.int64).reshape(-1, dims)


def top_k(queries: DataFrame, rows: DataFrame, k: int, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the ``k`` best of ``rows`` but those of its own id, ties to smaller ids."""
    if k < 1:
        raise ValueError("k must be at least 1")
    wanted = k + 1  # one of them may be the query itself

    def plain(df: DataFrame) -> DataFrame:
        v = df.select(F.col(id_col).cast("bigint").alias("id"), quantised(F.col(vector_col), scale).alias("v")).where("id is not null and v is not null")
        return v.select("id", "v", F.xxhash64("v").alias("h"))

    asked = plain(queries)
    index = written(_classes(plain(rows), wanted), "top-classes")
    n, dims = index.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).head()
    widest = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).head()
    dims, slots, parts = max(dims, widest[1], 1), max(1, -(-n // block)), max(1, -(-widest[0] // QUERIES))

    def deal(df: DataFrame, number: int) -> Column:
        return F.pmod(F.xxhash64("h"), F.lit(number)).cast("int")

    def pack(slot, vectors, ids) -> Iterator[dict]:
        for s, v, i in zip(slot, vectors, ids, strict=True):
            yield {"slot": [s], "vectors": [_small(_matrix(v, dims))], "flat": [np.array([x for c in i for x in c], dtype="<i8").tobytes()], "sizes": [np.array([len(c) for c in i], dtype="<i4").tobytes()]}

    def ask_rows(part, vectors) -> Iterator[dict]:
        for p, v in zip(part, vectors, strict=True):
            yield {"part": [p], "raw": [_small(_matrix(v, dims))], "least": [[None] * len(v)]}

    grouped = index.groupBy(deal(index, slots).alias("slot")).agg(F.collect_list(F.struct("v", "ids")).alias("c"))
    blocks = written(map_rows(grouped, ["slot", "c.v", "c.ids"], pack, "slot int, vectors binary, flat binary, sizes binary"), "top-index")
    one = asked.select("h", "v").distinct()
    of = written(one.groupBy(deal(one, parts).alias("part")).agg(F.collect_list(F.struct("h", "v")).alias("c")), "top-queries")
    sent = written(map_rows(of, ["part", "c.v"], ask_rows, "part int, raw binary, least array<bigint>"), "top-asked")
    stored = blocks.select("slot", F.lit(0).alias("kind"), F.lit(0).alias("part"), F.col("vectors").alias("raw"), F.lit(None).cast("array<bigint>").alias("least"), "flat", "sizes")

    def meet(some: DataFrame, ask: DataFrame, tasks: int) -> DataFrame:
        """(part, at, vec_id, score): queries against the block of their slot, which comes before them in its partition."""
        both = some.unionByName(ask.select("slot", F.lit(1).alias("kind"), "part", "raw", "least", F.lit(None).cast("binary").alias("flat"), F.lit(None).cast("binary").alias("sizes")))
        return both.repartition(4 * tasks, "slot").sortWithinPartitions("slot", "kind").select("kind", "part", "raw", "least", "flat", "sizes").mapInArrow(run, "part int, at int, vec_id bigint, score bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = counts = None
        ids: list[list[int]] = []
        for batch in batches:
            for row in range(batch.num_rows):
                part, raw, least, flat, sizes = (batch.column(c)[row].as_py() for c in range(1, 6))
                if batch.column(0)[row].as_py() == 0:
                    block, counts = Block(_wide(raw, dims)), np.frombuffer(sizes, dtype="<i4")
                    ids = [x.tolist() for x in np.split(np.frombuffer(flat, dtype="<i8"), np.cumsum(counts)[:-1])]
                elif block is not None:
                    found = [block.best(q, -np.inf if t is None else t, ids, counts, wanted) for q, t in zip(_wide(raw, dims), least, strict=True)]
                    yield pa.RecordBatch.from_pylist([{"part": part, "at": i, "vec_id": x, "score": s} for i, f in enumerate(found) for x, s in f], schema=kind)

    kind = pa.schema([("part", pa.int32()), ("at", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
    copies = min(parts, COPIES)
    ask = sent.select(F.pmod("part", F.lit(copies)).alias("slot"), "part", "raw", "least")
    many = stored.where("slot = 0").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    start = written(meet(many, ask, copies), "top-first")
    reached = start.groupBy("part", "at").agg(F.when(F.count("*") == wanted, F.min("score")).alias("t"))
    levels = reached.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("at", "t"))).alias("t"))
    rest = start.limit(0)
    if slots > 1:
        ready = sent.join(levels, "part", "left").withColumn("least", F.expr("transform(least, (x, i) -> try_element_at(t, i))"))
        rest = meet(stored.where("slot > 0"), ready.withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(slots - 1)))), slots)

    order = Window.partitionBy("part", "at").orderBy(F.desc("score"), "vec_id")
    kept = start.unionByName(rest).withColumn("r", F.row_number().over(order)).where(F.col("r") <= wanted)
    lists = kept.groupBy("part", "at").agg(F.sort_array(F.collect_list(F.struct("r", "vec_id", "score"))).alias("found"))
    names = of.select("part", F.posexplode("c").alias("at", "x")).select("part", "at", "x.h", "x.v")
    answers = names.join(lists, ["part", "at"]).select("h", "v", "found")
    own = asked.select(F.col("id").alias("query_id"), "h", "v").distinct().join(answers, ["h", "v"])
    others = F.slice(F.filter("found", lambda x: x.vec_id != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")


def op13_top_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return top_k(rows.where("vec_id % 100 = 0"), rows, 10)


OP13_SQL = """
with v as (
    select vec_id, [floor(1024 * x::double) for x in embedding] as v from embeddings
    where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
    select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
    from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 10
"""
