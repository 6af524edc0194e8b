"""Near-duplicate groups by b-bit MinHash (operator 1).

Each text's set of distinct word shingles gets PERMS minima. BANDS groups of ROWS minima
are band keys; documents that share one are candidates. Of each minimum the low BITS bits
are kept and packed; bit counts of two packed signatures, corrected for chance collisions,
estimate the similarity of a candidate pair, and those above SURE are confirmed on the full
sets. A pair at the threshold shares no band with probability (1 - 0.75 ** 4) ** 32 < 6e-6
and falls below SURE by more than five standard deviations.

Documents with equal sets are one class, so copies are never paired. Within a bucket of a
band only links to one hub are tried first. Then the members that are not yet in one
component with the bucket's main one are compared to all others of the bucket, block by
block: first by their signatures, which gives the members with a likely partner, then these
by their full sets. So no bucket is capped and no component stays apart, while pairs are
never listed and a bucket of near copies moves what it has members.

Long texts are read in whole; a block with one very long text holds few others.

Defined results: a text without words has an empty set and is linked with nothing; a row
without id belongs to its group but never names it, and is kept only where no member has an
id; rows of equal ids and texts are one class and share their result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, rows_of, same, sieve, slices, table, written
from .components import components
from .shingles import WORDS, mixed, shingle_hashes, words

PERCENT = 75
BANDS, ROWS = 32, 4
PERMS = BANDS * ROWS
BITS = 4
PER_LONG = 64 // BITS
LONGS = PERMS // PER_LONG
#: Estimates of this similarity or more are confirmed.
SURE = 0.55
#: The least and largest sizes of the blocks in which a bucket's members are compared, and the shingles that one holds.
LEFT, RIGHT = (256, 4096), (1024, 8192)
SHINGLES = 2_000_000

_SEEDS = mixed(np.arange(1, 2 * PERMS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_XOR, _MULTIPLY = _SEEDS[:PERMS, None], _SEEDS[PERMS:, None] | np.uint64(1)


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(PERMS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        np.minimum(out, ((hashes[at : at + 1024] ^ _XOR) * _MULTIPLY).min(axis=1), out=out)
    return out


def signature(least: np.ndarray) -> list[int]:
    """The low bits of all minima in LONGS integers."""
    low = mixed(least) & np.uint64(2**BITS - 1)
    return (low.reshape(LONGS, PER_LONG) << (np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS))).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def band_keys(least: np.ndarray) -> list[int]:
    rows = least.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64).tolist()


def set_key(hashes: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None


def features(docs: DataFrame, id_col: str, text_col: str, size: int, mark: Column) -> DataFrame:
    """(doc_id, n, node, sig, bands, mark); node stands for the set, null for the empty one."""

    def step(ids, texts, marks):
        for a, b in slices(len(ids), [len(t or "") for t in texts], 4 << 20):
            sets = [shingle_hashes(words(t), size) for t in texts[a:b]]
            least = [minima(s) if len(s) else None for s in sets]
            yield {
                "doc_id": ids[a:b], "n": [len(s) for s in sets], "node": [set_key(s) for s in sets],
                "sig": [None if m is None else signature(m) for m in least], "bands": [None if m is None else band_keys(m) for m in least], "mark": marks[a:b],
            }

    schema = "doc_id bigint, n bigint, node binary, sig array<bigint>, bands array<bigint>, mark binary"
    return map_rows(docs, [F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), mark.alias("mark")], step, schema)


def likely(a: str, b: str) -> Column:
    """Whether the estimate of two classes, from columns n and sig with these prefixes, asks for a check on the sets."""
    differ = F.lit(0)
    ones = F.lit(sum(1 << (BITS * k) for k in range(PER_LONG)))
    for k in range(LONGS):
        x = F.col(f"{a}sig")[k].bitwiseXOR(F.col(f"{b}sig")[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differ = differ + F.bit_count(x.bitwiseAND(ones))
    sizes = F.least(f"{a}n", f"{b}n") * 100 >= F.greatest(f"{a}n", f"{b}n") * PERCENT
    return sizes & (differ <= _MOST_DIFFERENT)


#: An estimate is (equal / PERMS - c) / (1 - c) with the chance c of a collision.
_CHANCE = 2.0**-BITS
_MOST_DIFFERENT = int(PERMS * (1 - SURE) * (1 - _CHANCE))


def alike(s: np.ndarray, t: np.ndarray) -> bool:
    inter = len(np.intersect1d(s, t, assume_unique=True))
    return 100 * inter >= PERCENT * (len(s) + len(t) - inter)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) of which the full sets are alike.

    A hub's text moves once for each of its pairs: as much as the other members' texts, as
    ``likely`` asks for sets of similar sizes.
    """
    both = pairs.join(texts.toDF("a", "a_text"), "a").join(texts.toDF("b", "b_text"), "b")

    def step(a, b, a_texts, b_texts):
        keep, last = [], (None, None)
        for i, (x, y) in enumerate(zip(a_texts, b_texts, strict=True)):
            if y != last[0]:
                last = (y, shingle_hashes(words(y), size))
            if alike(shingle_hashes(words(x), size), last[1]):
                keep.append(i)
        yield {"a": [a[i] for i in keep], "b": [b[i] for i in keep]}

    return map_rows(both, ["a", "b", "a_text", "b_text"], step, "a bigint, b bigint")


def grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[list[tuple]]:
    """Runs of rows whose first ``key`` columns agree."""
    group, rows = None, []
    for row in rows_of(batches):
        if row[:key] != group:
            if rows:
                yield rows
            group, rows = row[:key], []
        rows.append(row)
    if rows:
        yield rows


class Block:
    """The members of one block of a bucket: left ones are compared to right ones.

    A pair is looked at in the bucket of the first band that it shares, and nowhere else.
    """

    def __init__(self, key: int, rows: list[dict]):
        self.key, self.left, self.right = key, [r for r in rows if r["left"]], [r for r in rows if not r["left"]]
        if self.left and self.right:
            self.sig = np.array([r["sig"] for r in self.right], dtype=np.int64).view(np.uint64)
            self.n = np.array([r["n"] for r in self.right])
            self.bands = np.array([r["bands"] for r in self.right], dtype=np.int64)

    def near(self, one: dict) -> list[int]:
        """Places of the right members that are likely near a left one."""
        x = self.sig ^ np.array(one["sig"], dtype=np.int64).view(np.uint64)
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        differ = np.bitwise_count(x & _ONES).sum(axis=1, dtype=np.int64)
        at = np.flatnonzero((differ <= _MOST_DIFFERENT) & (np.minimum(self.n, one["n"]) * 100 >= np.maximum(self.n, one["n"]) * PERCENT))
        band = one["bands"].index(self.key)
        if band and len(at):
            at = at[~(self.bands[at, :band] == np.array(one["bands"][:band])).any(axis=1)]
        return at.tolist()


_ONES = np.uint64(sum(1 << (BITS * k) for k in range(PER_LONG)))


def in_blocks(members: DataFrame) -> DataFrame:
    """Members (key, node, n, root) of buckets with several components, in blocks: key, lb, rb, left, node, root.

    The members outside a bucket's largest component are the left side, all its members the
    right one; each pair of a left and a right block meets once. A side of a block has a
    sixteenth of its members within the limits of LEFT or RIGHT, and about SHINGLES shingles
    at most, so a member is repeated sixteen times in a bucket of up to 16 * 4096 members, and
    in a larger one once for each 4096; only signatures are repeated so, not texts.
    """
    sizes = members.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    buckets = sizes.groupBy("key").agg(F.sum("c").alias("c"), F.sum("w").alias("w"), F.max(F.struct("c", "root", "w")).alias("main"), F.count("*").alias("roots")).where("roots > 1")
    several = lambda c, w, limits: F.greatest(F.ceil(c / F.least(F.greatest(c / 16, F.lit(limits[0])), F.lit(limits[1]))), F.ceil(w / SHINGLES))
    nl, nr = several(F.col("c") - F.col("main.c"), F.col("w") - F.col("main.w"), LEFT), several(F.col("c"), F.col("w"), RIGHT)
    buckets = buckets.select("key", F.col("main.root").alias("main"), nl.alias("nl"), nr.alias("nr"))
    there = written(members.join(written(buckets, "buckets"), "key"), "there")
    place = F.xxhash64("node", "key")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    left = there.where("root <> main").withColumn("lb", F.pmod(place, "nl")).withColumn("rb", upto("nr")).withColumn("left", F.lit(True))
    right = there.withColumn("rb", F.pmod(place, "nr")).withColumn("lb", upto("nl")).withColumn("left", F.lit(False))
    columns = ["key", "lb", "rb", "left", "node", "root"]
    return left.select(columns).unionByName(right.select(columns))


def dealt(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(parts, "key", "lb", "rb").sortWithinPartitions("key", "lb", "rb", F.col("left").desc(), "node")


def suspects(blocks: DataFrame, parts: int) -> DataFrame:
    """The rows of ``blocks`` (with n, sig and bands) that have a likely partner in another component in their block: never more rows than there were."""
    names = blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 3):
            block = Block(rows[0][0], [dict(zip(names, r, strict=True)) for r in rows])
            if not block.left or not block.right:
                continue
            l_found, r_found = [], set()
            for one in block.left:
                if mine := [i for i in block.near(one) if block.right[i]["root"] != one["root"]]:
                    l_found.append(one)
                    r_found.update(mine)
            if l_found:
                found = [*l_found, *(block.right[i] for i in sorted(r_found))]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found]) for c in _PLACE], names=_PLACE)

    return dealt(blocks, parts).mapInArrow(run, "key bigint, lb bigint, rb bigint, left boolean, node bigint")


_PLACE = ["key", "lb", "rb", "left", "node"]


def block_links(blocks: DataFrame, size: int, parts: int) -> DataFrame:
    """Links (a, b) confirmed on full sets between members of blocks (with root, n, sig, bands and text).

    Components that a block has linked are one component to it from then on, so it gives
    fewer links than it has members.
    """
    names = blocks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in grouped(batches, 3):
            block = Block(rows[0][0], [dict(zip(names, r, strict=True)) for r in rows])
            if block.left and block.right and (found := links(block)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])

    def links(block: Block) -> list[tuple[int, int]]:
        above: dict[int, int] = {}
        sets: dict[int, np.ndarray] = {}
        out = []

        def top(root: int) -> int:
            while above.get(root, root) != root:
                above[root] = root = above.get(above[root], above[root])
            return root

        def full(member: dict) -> np.ndarray:
            if member["node"] not in sets:
                sets[member["node"]] = shingle_hashes(words(member["text"]), size)
            return sets[member["node"]]

        for one in block.left:
            for i in block.near(one):
                other = block.right[i]
                if top(one["root"]) != top(other["root"]) and alike(full(one), full(other)):
                    out.append((one["node"], other["node"]))
                    above[top(one["root"])] = top(other["root"])
        return out

    return dealt(blocks, parts).mapInArrow(run, "a bigint, b bigint")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``."""
    return marked_groups(docs, id_col, text_col, size, F.lit(None).cast("binary")).drop("mark")


def marked_groups(docs: DataFrame, id_col: str, text_col: str, size: int, mark: Column) -> DataFrame:
    """``near_groups`` with a column ``mark`` of each row of ``docs``."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(features(docs, id_col, text_col, size, mark), "features")
    classes = rows.where("node is not null").groupBy(F.col("node").alias("set")).agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    light = classes.select("node", "n", "sig")

    banded = classes.select("node", "n", F.explode("bands").alias("key"))
    full = banded.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    members = written(banded.join(full.hint("merge"), "key", "left_semi"), "members")
    hubs = members.groupBy("key").agg(F.min_by("node", F.xxhash64("node", "key")).alias("hub"))
    there = members.select("node").distinct().join(classes.select("node", "doc_id", "set"), "node")
    texts = written(texts_of(docs, written(there, "there"), id_col, text_col, size), "texts")

    stars = members.join(written(hubs, "hubs"), "key").where("node <> hub").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    stars = stars.join(light.toDF("a", "a_n", "a_sig"), "a").join(light.toDF("b", "b_n", "b_sig"), "b").where(likely("a_", "b_")).select("a", "b")
    stars = written(stars, "stars")
    first = stars.groupBy("a").agg(F.min_by("b", F.xxhash64("a", "b")).alias("b"))
    links = written(confirmed(first, texts, size), "near")
    roots = written(components(links), "roots")
    more = written(confirmed(apart(stars.join(first, ["a", "b"], "left_anti"), roots), texts, size), "near")
    if not more.isEmpty():
        links = links.unionByName(more)
        roots = written(components(links), "roots")
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    blocks = written(in_blocks(rooted), "blocks")
    light = classes.select("node", "n", "sig", "bands")
    asked = written(suspects(blocks.join(light, "node").select(*blocks.columns, "n", "sig", "bands"), parts), "asked")
    asked = asked.join(rooted.select("node", "root").distinct(), "node").join(light, "node").join(texts, "node")
    last = written(block_links(asked.select(*_PLACE, "root", "n", "sig", "bands", "text"), size, parts), "near")
    if not last.isEmpty():
        roots = written(components(links.unionByName(last)), "roots")

    roots = classes.select("set", "doc_id", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = written(roots.select("set", "doc_id", "root"), "roots")
    groups = written(roots.groupBy("root").agg(F.min("doc_id").alias("component_id")), "groups")
    named = written(roots.join(groups, "root").select("set", "component_id"), "named")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("node").alias("set"), "mark").join(named, "set", "left")
    out = out.withColumn("component_id", F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", same("doc_id", "component_id").alias("kept"), "mark")


def texts_of(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(node, text) for the classes (node, doc_id, set); of rows that share an id, those whose set is the class's.

    Joined by sorting on both sides at every size: the classes are as many as the near copies.
    """
    wanted = classes.toDF("node", "__id", "set").hint("merge")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def step(nodes, sets, texts):
        keep = [i for i, t in enumerate(texts) if set_key(shingle_hashes(words(t), size)) == sets[i]]
        yield {"node": [nodes[i] for i in keep], "text": [texts[i] for i in keep]}

    return map_rows(rows.join(wanted, same("doc_id", "__id")), ["node", "set", "text"], step, "node bigint, text string").dropDuplicates(["node"])


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components."""
    both = pairs.join(roots.toDF("a", "ra"), "a", "left").join(roots.toDF("b", "rb"), "b", "left")
    return both.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS) -> DataFrame:
    """``docs`` without the rows that ``near_groups`` does not keep, told by id and text; all columns as they were."""
    digest = F.unhex(F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256))
    gone = marked_groups(docs, id_col, text_col, size, digest).where("not kept").select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__mark")).distinct()
    gone = written(gone, "gone")
    some, others = sieve(docs, F.col(id_col), gone.select("__gone"))
    return some.join(gone, F.col(id_col).cast("bigint").eqNullSafe(F.col("__gone")) & digest.eqNullSafe(F.col("__mark")), "left_anti").unionByName(others)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)
), e AS (
  SELECT x, y FROM l UNION ALL SELECT y, x FROM l
), r(v, t) AS (
  SELECT x, x FROM e UNION SELECT e.y, r.t FROM r JOIN e ON e.x = r.v
), k AS (
  SELECT v, min(t) AS component_id FROM r GROUP BY v
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(k.component_id, w.doc_id) AS component_id, w.doc_id = coalesce(k.component_id, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN k ON k.v = w.doc_id
"""
