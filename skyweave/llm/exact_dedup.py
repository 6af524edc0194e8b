"""Exact deduplication by deterministic block naming (operator 2).

A normalised text is cut into blocks of BLOCK bytes. Distinct blocks are sorted and get
integers as names; then adjacent pairs of names get integers in the same way, level by
level, until each text has one name. Texts of equally many blocks have equal names at the
last level exactly if they are equal, so (blocks, name) is an identity without collisions.

A block's text is moved once, to be told apart from others and sorted; what its documents
are joined to is a digest of it. Digests that stand for more than one block are found, and
blocks with such digests are named by their texts instead, so digests decide nothing.
Names are aggregated before they are joined, and both sides of each join are plain
exchanges, which Spark can split where a block or a group of copies is hot.

Texts of any length are read in whole, and become as many blocks as they need. Defined
results: a null text counts as empty, and empty texts are equal; a row without id
comes after all others of its group; of rows that agree in length and id one stays.
"""

from __future__ import annotations

import hashlib

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, same, sieve, slices, table, written

BLOCK = 4096


def normalised(text: str | None) -> bytes:
    """The text in UTF-8 without [\\x20\\x09-\\x0D], which is what ``bytes.split`` splits at."""
    return b"".join(text.encode("utf-8").split()) if text else b""


def digest(block: bytes) -> bytes:
    return xxhash.xxh3_128_digest(block)


def blocks(docs: DataFrame, columns: list[str], size: int, id_col: str, text_col: str, key=digest) -> DataFrame:
    """A row for each block of each text; uid numbers the rows of ``docs`` as they are scanned."""
    row = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def step(uids, ids, texts):
        for a, b in slices(len(uids), [len(t or "") for t in texts], 4 << 20):
            out: list[tuple] = []
            for uid, doc_id, text in zip(uids[a:b], ids[a:b], texts[a:b], strict=True):
                raw = normalised(text)
                n = -(-len(raw) // size) or 1
                sha = hashlib.sha256(raw).hexdigest() if "sha" in columns else None
                for k in range(n):
                    part = raw[k * size : (k + 1) * size]
                    out.append((uid, doc_id, len(text or ""), n, k, key(part), part, sha if k == 0 else None))
            whole = dict(zip(("uid", "doc_id", "n_chars", "n", "pos", "key", "block", "sha"), map(list, zip(*out, strict=True)), strict=True))
            yield {c: whole[c] for c in columns}

    types = {"uid": "bigint", "doc_id": "bigint", "n_chars": "bigint", "n": "int", "pos": "int", "key": "binary", "block": "binary", "sha": "string"}
    return map_rows(row, ["uid", "doc_id", "text"], step, ", ".join(f"{c} {types[c]}" for c in columns))


def named(distinct: DataFrame, by: list[str]) -> DataFrame:
    """Integers as names of distinct rows: the partition and the place in its sorted order."""
    return distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id())


def block_names(docs: DataFrame, size: int, id_col: str, text_col: str, key=digest) -> DataFrame:
    """(uid, doc_id, n_chars, sha, n, pos, name): the names of all blocks."""
    part = lambda *columns: blocks(docs, list(columns), size, id_col, text_col, key)
    names = written(named(part("key", "block").distinct(), ["key", "block"]).select("key", "name"), "blocks")
    shared = written(names.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "shared")
    rows = part("uid", "doc_id", "n_chars", "sha", "n", "pos", "key")
    if shared.isEmpty():
        return rows.join(names, "key").drop("key")
    alike = part("uid", "doc_id", "n_chars", "sha", "n", "pos", "key", "block").join(shared, "key", "left_semi")
    apart = written(named(alike.select("key", "block").distinct(), ["key", "block"]).withColumn("name", -1 - F.col("name")), "apart")
    one = rows.join(names.join(shared, "key", "left_anti"), "key").drop("key")
    return one.unionByName(alike.join(apart, ["key", "block"]).drop("key", "block"))


def identities(docs: DataFrame, size: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", key=digest) -> DataFrame:
    """(uid, doc_id, n_chars, sha, n, name) for each row of ``docs``: (n, name) is its text's identity."""
    level = written(block_names(docs, size, id_col, text_col, key), "level")
    done = [level.where("n = 1").drop("pos")]
    level = level.where("n > 1")
    heads = level.where("pos = 0").select("uid", "doc_id", "n_chars", "sha", "n")
    level = level.select("uid", "n", "pos", "name").withColumn("width", F.col("n"))
    while not level.isEmpty():
        pairs = level.groupBy("uid", "n", "width", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))).alias("b")
        )
        pairs = written(pairs.withColumn("b", F.coalesce("b", F.lit(-1 << 62))).withColumn("width", F.expr("(width + 1) div 2").cast("int")), "pairs")
        names = written(named(pairs.select("a", "b").distinct(), ["a", "b"]), "names")
        level = written(pairs.join(names, ["a", "b"]).select("uid", "n", "pos", "name", "width"), "level")
        done.append(heads.join(level.where("width = 1").select("uid", "name"), "uid").select(*done[0].columns))
        level = level.where("width > 1")
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    return written(whole, "identities")


def exact_groups(docs: DataFrame, size: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", key=digest) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and n_chars, a row for each row of ``docs``."""
    rows = identities(docs, size, id_col, text_col, key)
    order = F.struct((-F.col("n_chars")).alias("chars"), F.col("doc_id").isNull().alias("without"), F.col("doc_id"), F.col("uid"))
    groups = rows.groupBy("n", "name").agg(F.count("*").alias("group_size"), F.min(order).alias("best"), F.count("doc_id").alias("ids"))
    kept = rows.join(written(groups, "groups"), ["n", "name"])
    return kept.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), F.col("sha").alias("text_sha256"), "n_chars")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, norm, length(body) AS n_chars,
    first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w AS place
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(body) DESC, doc_id)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256, CAST(n_chars AS BIGINT) AS n_chars FROM r
"""


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns as they were.

    Rows with ids that lose a row are found again by id, length and digest of their texts; of
    rows that agree in all three, one is taken. All others, by a sieve, stay where they are.
    """
    rows = written(exact_groups(docs, id_col=id_col, text_col=text_col).select("doc_id", "n_chars", "text_sha256", "kept"), "told")
    touched = rows.where("not kept").select("doc_id").distinct()
    docs_, whole = sieve(docs, F.col(id_col).cast("bigint"), touched)
    keep = rows.where("kept").select(F.col("doc_id").alias("__id"), F.col("n_chars").alias("__chars"), F.col("text_sha256").alias("__sha"))
    keep = sieve(keep, F.col("__id"), touched)[0]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.translate(text, " \t\n\x0b\x0c\r", "")
    marked = docs_.withColumns({"__id0": F.col(id_col).cast("bigint"), "__chars0": F.char_length(text).cast("bigint"), "__sha0": F.sha2(bare, 256)})
    on = same("__id0", "__id") & (F.col("__chars0") == F.col("__chars")) & (F.col("__sha0") == F.col("__sha"))
    return marked.join(keep, on).dropDuplicates(["__id0", "__chars0", "__sha0"]).select(*docs.columns).unionByName(whole)
