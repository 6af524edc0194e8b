"""Histograms, quantiles and counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import written
from .spatial import large_join


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n) of regular bins; values outside are dropped."""
    inside = df.where((F.col(value) >= low) & (F.col(value) < high))
    return inside.groupBy(F.floor((F.col(value) - low) / ((high - low) / bins)).alias("bin")).agg(F.count("*").alias("n"))


def weighted_quantiles(df: DataFrame, shares: tuple[float, ...], ranges: int | None = None) -> DataFrame:
    """(q, v) from (v, w, id), interpolated between the middles of the weights.

    Rows are added up by value first, keeping the weights of each value's first and last row,
    so a value that many rows share is one row. Values are then cut into ranges of about
    equal size, one for a million values and 256 at least, whose sums are as many rows; only
    within a range are values put in order.
    """
    ranges = ranges or min(10_000, max(256, df.count() // 1_000_000))
    each = df.groupBy("v").agg(F.sum("w").alias("w"), F.min_by("w", "id").alias("first"), F.max_by("w", "id").alias("last"))
    cuts = each.agg(F.percentile_approx("v", [k / ranges for k in range(1, ranges)], max(10_000, 10 * ranges))).head()[0]
    if not cuts:
        return df.sparkSession.createDataFrame([], "q double, v double")
    edges = F.array(*map(F.lit, sorted(set(cuts))))
    placed = each.withColumn("range", F.size(F.filter(edges, lambda e: e < F.col("v"))))
    sums = placed.groupBy("range").agg(F.sum("w").alias("w"), F.min(F.struct("v", "first")).alias("head")).orderBy("range").collect()  # a row for each range
    total, before, rows = sum(r.w for r in sums), 0.0, []
    for r, nxt in zip(sums, [*sums[1:], None], strict=True):
        after = before + r.w
        rows.append((r["range"], before, *((nxt["head"].v, (after + nxt["head"].first / 2) / total) if nxt else (None, None))))
        before = after
    offsets = df.sparkSession.createDataFrame(rows, "range int, before double, next_v double, next_p double")
    ordered = Window.partitionBy("range").orderBy("v")
    inside = placed.join(F.broadcast(offsets), "range").withColumn("done", F.col("before") + F.sum("w").over(ordered) - F.col("w"))
    inside = inside.withColumn("p", (F.col("done") + F.col("first") / 2) / total).withColumn("p_end", (F.col("done") + F.col("w") - F.col("last") / 2) / total)
    inside = inside.withColumn("nv", F.coalesce(F.lead("v").over(ordered), "next_v")).withColumn("np", F.coalesce(F.lead("p").over(ordered), "next_p"))
    asked = inside.withColumn("q", F.explode(F.array(*map(F.lit, shares))))
    here = (F.col("p") <= F.col("q")) & (F.col("np").isNull() | (F.col("np") > F.col("q")))
    hit = asked.where(here | ((F.col("done") == 0) & (F.col("q") < F.col("p"))))
    value = F.when((F.col("q") <= F.col("p_end")) | F.col("nv").isNull(), F.col("v")).otherwise(F.col("v") + (F.col("q") - F.col("p_end")) / (F.col("np") - F.col("p_end")) * (F.col("nv") - F.col("v")))
    return hit.groupBy("q").agg(F.min(value).alias("v"))


def quantiles(df: DataFrame, by: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """(by, n, q): exact quantiles of each group, an array with an entry for each share, interpolated between neighbours.

    Equal values of a group are added up first, so a value that many rows share is one row.
    Then all groups are put in order together, by ranges of (group, value): a group of any
    size lies in as many ranges as it fills. Sums of ranges give each range's first rank, and
    ranks within a range are running sums, so no task holds a group's values.
    """
    rows = df.select(*by, F.col(value).cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    each = rows.groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(each.repartitionByRange(parts, *by, "__v").withColumn("__range", F.spark_partition_id()), "ordered")
    one = list(by) or [F.lit(0)]
    sums = placed.groupBy(*by, "__range").agg(F.sum("__c").alias("__s"))  # a row for each range of each group
    earlier = Window.partitionBy(*one).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "__range", F.coalesce(F.sum("__s").over(earlier), F.lit(0)).alias("__before"), F.sum("__s").over(Window.partitionBy(*one)).alias("n"))
    inner = Window.partitionBy(*by, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = large_join(placed, sums, [*by, "__range"]).withColumn("__end", F.col("__before") + F.sum("__c").over(inner))
    at = [F.lit(float(s)) * (F.col("n") - 1) for s in shares]
    target = lambda i, k: F.struct(F.lit(i).alias("i"), k(at[i // 2]).cast("bigint").alias("k"))
    wanted = F.array(*(target(2 * i + up, F.ceil if up else F.floor) for i in range(len(shares)) for up in (0, 1)))
    hit = F.filter(wanted, lambda t: (t["k"] < F.col("__end")) & (t["k"] >= F.col("__end") - F.col("__c")))
    found = ranked.withColumn("__t", F.explode(hit)).groupBy(*by, "n").agg(*(F.max(F.when(F.col("__t.i") == i, F.col("__v"))).alias(f"__{i}") for i in range(2 * len(shares))))
    between = lambda i: F.col(f"__{2 * i}") + (F.col(f"__{2 * i + 1}") - F.col(f"__{2 * i}")) * (at[i] - F.floor(at[i]))
    return found.select(*by, "n", F.array(*(F.when(F.col(f"__{2 * i}") == F.col(f"__{2 * i + 1}"), F.col(f"__{2 * i}")).otherwise(between(i)) for i in range(len(shares)))).alias("q"))


def cells(df: DataFrame, log_density: Column, mag: Column, dx: float = 0.2, dy: float = 0.25) -> DataFrame:
    """(x, y, n): occupied cells."""
    return df.groupBy(F.floor(log_density / dx).alias("x"), F.floor(mag / dy).alias("y")).agg(F.count("*").alias("n"))


def binned_median(df: DataFrame, x: str, value: str, width: float) -> DataFrame:
    """(bin, value): medians of finite positive values."""
    good = df.where((F.col(value) > 0) & (F.col(value) < F.lit(float("inf"))))
    binned = good.where(F.col(x).isNotNull()).withColumn("bin", F.floor(F.col(x) / width)).select("bin", F.col(value).alias("value"))
    return quantiles(binned, ["bin"], "value", (0.5,)).select("bin", F.col("q")[0].alias("value"))


def first_certain(df: DataFrame, order: str, rate: str, doubt: float) -> DataFrame:
    """The first of a few bins by which a Poisson process has had an event, but for ``doubt``."""
    total = df.withColumn("total", F.sum(rate).over(Window.partitionBy(F.lit(0)).orderBy(order)))
    return total.where(F.col("total") >= -math.log(doubt)).agg(F.min(order).alias(order))


def modal_value(df: DataFrame, value: str) -> DataFrame:
    """(mode): the middle of the fullest bin; bins as fine as range and quartiles, or the number of values, ask for."""
    v = F.col(value)
    span = F.col("hi") - F.col("lo")
    facts = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).crossJoin(quantiles(df, [], value, (0.25, 0.75)))  # one row each
    sturges = span / (F.log2("n") + 1)
    spread = 2 * (F.col("q")[1] - F.col("q")[0]) / F.pow("n", F.lit(1 / 3))
    facts = facts.withColumn("bins", F.ceil(span / F.when(spread > 0, F.least(spread, sturges)).otherwise(sturges)))
    rows = df.where(v.isNotNull()).select(v.alias("v")).join(F.broadcast(facts.withColumn("width", span / F.col("bins"))))  # one row
    counts = rows.groupBy(F.least(F.col("bins") - 1, F.floor((F.col("v") - F.col("lo")) / F.col("width"))).alias("b"), "lo", "width").agg(F.count("*").alias("c"))
    best = counts.agg(F.max_by(F.struct("b", "lo", "width"), F.struct("c", -F.col("b"))).alias("m"))
    return best.select((F.col("m.lo") + (F.col("m.b") + 0.5) * F.col("m.width")).alias("mode"))


def model_counts(sim: DataFrame, area: float, step: float) -> DataFrame:
    """(bin, n, density, error): simulated sources a magnitude and square degree."""
    out = sim.groupBy(F.floor(F.col("mag") / step + 1e-9).alias("bin")).agg(F.count("*").alias("n"))
    return out.withColumn("density", F.col("n") / (area * step)).withColumn("error", F.sqrt("n") / (area * step))
