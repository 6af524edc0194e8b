"""Positions of regular expression matches with SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

#: Matches whose positions are summed together: arrays are copied as they grow, so they grow to this only.
CHUNK = 128
SPANS = "array<struct<start:bigint,end:bigint,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches, in code points.

    What lies between the matches comes from splitting, the matches from extracting; both
    find the same ones, so positions are running sums of lengths, by chunks of matches.
    ``pattern`` must not match the empty string, and must not repeat a group without a bound:
    the matcher of the JVM recurses into those, and long texts would exhaust its stack. Texts
    without a match are found by a search and not split.
    """
    empty = F.array().cast(SPANS)
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return F.when(text.rlike(pattern), let(both, lambda b: placed(b["gaps"], b["found"]))).otherwise(empty)


def placed(gaps: Column, found: Column) -> Column:
    """Array of (start, end, value) of ``found`` with ``gaps`` before each and after the last."""
    empty = F.array().cast(SPANS)
    zero = F.lit(0).cast("bigint")
    size = lambda p: (F.char_length(p["gap"]) + F.char_length(p["value"])).cast("bigint")

    def step(done: Column, p: Column) -> Column:
        end = done["at"] + size(p)
        one = F.struct((end - F.char_length(p["value"])).alias("start"), end.alias("end"), p["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(done["out"], one).alias("out"))

    def whole(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda s, p: s + size(p)))
        begins = F.aggregate(sums, F.array(zero), lambda out, x: F.array_append(out, F.element_at(out, -1) + x))
        return let(begins, lambda at: F.flatten(F.transform(chunks, lambda c, i: F.aggregate(c, F.struct(at[i].alias("at"), empty.alias("out")), step)["out"])))

    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("value"))
    upto = F.expr("cast(0 as int)")
    cut = lambda p: F.transform(F.sequence(upto, F.floor((F.size(p) - 1) / CHUNK).cast("int")), lambda c: F.slice(p, c * CHUNK + 1, F.lit(CHUNK)))
    return F.when(F.size(found) == 0, empty).otherwise(let(pairs, lambda p: let(cut(p), whole)))
