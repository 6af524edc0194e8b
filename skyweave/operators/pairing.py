"""The most probable matches of each island, with their posterior and the evidence.

Islands with one source on a side have closed forms, which are aggregates. Larger ones,
which the size gate bounds, go to a kernel, many to a batch.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sky import eta, haversine, pair_density, xi
from ..plans.storage import written
from .spatial import large_join

#: Added to the hypothesis without matches alone.
NULL_FLOOR = 1e-10


def pair_grid(members: DataFrame, a: DataFrame, b: DataFrame, keys: tuple[str, ...] = (), extra: tuple[str, ...] = (), density: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All pairs within each island: positions' separation and density, and the hypotheses' factors.

    Sources have id, lon, lat, sig, prior ``n`` and likelihood ``f``. The counterpart prior
    ``nc`` and likelihood ``c`` depend on both sources: they are arrays of the second side,
    which the ``slot`` of the first side's source indexes from 0. ``density`` adds ``g`` to
    pairs with sep, sig_a, sig_b and the columns ``extra`` of both sides, and may add others;
    the closed form without blends is the default.
    """
    k = list(keys)
    side = lambda which, cat, extra: large_join(members.where(F.col("side") == which), cat, [*k, "id"]).select(*k, "island", *(F.col(c).alias(f"{which}_{c}") for c in ("id", "lon", "lat", "sig", "n", "f", *extra)))
    grid = large_join(side("a", a, ("slot", *extra)), side("b", b, ("nc", "c", *extra)), [*k, "island"])
    grid = grid.withColumn("nc", F.element_at("b_nc", F.col("a_slot") + 1)).withColumn("c", F.element_at("b_c", F.col("a_slot") + 1)).drop("b_nc", "b_c")
    grid = grid.withColumn("sep", haversine("a_lon", "b_lon", "a_lat", "b_lat") * 3600)
    both = [f"{w}_{c}" for c in ("sig", *extra) for w in ("a", "b")]
    grid = grid.withColumnsRenamed({f"{w}_{c}": f"{c}_{w}" for w, c in (x.split("_", 1) for x in both)})
    before = grid.columns
    grid = density(grid) if density else grid.withColumn("g", pair_density("sep", "sig_a", "sig_b"))
    more = [c for c in grid.columns if c not in before and c not in ("g", "cdf")]
    return grid.select(
        *k, *more, "island", F.col("a_id").alias("a"), F.col("b_id").alias("b"), "sep", "g",
        (F.col("nc") * F.col("g") * F.col("c")).alias("cw"), (F.col("a_n") * F.col("a_f")).alias("fa"), (F.col("b_n") * F.col("b_f")).alias("fb"),
        eta("c", "a_f", "b_f").alias("eta"), xi("nc", "g", "a_n", "b_n").alias("xi"),
    )


def best_matching(cw: np.ndarray, fa: np.ndarray, fb: np.ndarray) -> tuple[list[tuple[int, int]], float]:
    """The matches of the best hypothesis and its share of the evidence.

    Sources of the larger side are taken one by one; for each set of used sources of the
    smaller side, a bit each, the sum and the greatest of all hypotheses so far are kept, as
    logarithms over that without matches. So the work grows with the sets, not with the
    hypotheses. Of equal ones that with an earlier source left alone wins.
    """
    lr = np.log(np.maximum(cw, 1e-300)) - np.log(fa)[:, None] - np.log(fb)[None, :]
    flip = lr.shape[0] < lr.shape[1]
    lr = lr.T if flip else lr
    n, m = lr.shape
    sets = np.arange(1 << m)
    total, best = np.full(len(sets), -np.inf), np.full(len(sets), -np.inf)
    total[0] = best[0] = 0.0
    chosen = np.full((n, len(sets)), -1, dtype=np.int8)
    for i in range(n):
        more, top = total.copy(), best.copy()
        for j in range(m):
            without = sets[(sets >> j) & 1 == 0]
            to = without | 1 << j
            more[to] = np.logaddexp(more[to], total[without] + lr[i, j])
            value = best[without] + lr[i, j]
            better = value > top[to]
            top[to[better]], chosen[i, to[better]] = value[better], j
        total, best = more, top
    null = np.logaddexp(0.0, math.log(NULL_FLOOR) - np.log(fa).sum() - np.log(fb).sum())
    evidence = np.logaddexp(np.logaddexp.reduce(total[1:]), null)
    used = int(best[1:].argmax()) + 1
    if best[used] <= null:
        return [], float(np.exp(null - evidence))
    p, pick = float(np.exp(best[used] - evidence)), []
    for i in range(n - 1, -1, -1):
        if (j := int(chosen[i, used])) >= 0:
            pick.append((j, i) if flip else (i, j))
            used ^= 1 << j
    return sorted(pick), p


def island_matches(grid: DataFrame, sizes: DataFrame, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(keys, island, a, b) of the best hypothesis, and (keys, island, p) of all islands with both sides."""
    k = [*keys, "island"]
    sized = large_join(grid, sizes.select(*k, "n_a", "n_b"), k)
    small = sized.where((F.col("n_a") == 1) | (F.col("n_b") == 1))
    one_a, one_b = F.col("n_a") == 1, F.col("n_b") == 1
    # With one source on a side, each row has another source of the other side.
    total = small.groupBy(*k).agg(
        (F.when(F.first(one_a), F.log(F.first("fa"))).otherwise(F.sum(F.log("fa")))).alias("la"), (F.when(F.first(one_b), F.log(F.first("fb"))).otherwise(F.sum(F.log("fb")))).alias("lb"),
        F.sum(F.col("cw") / (F.col("fa") * F.col("fb"))).alias("ratios"),
        F.max(F.struct((F.col("cw") / (F.col("fa") * F.col("fb"))).alias("ratio"), (-F.col("a")).alias("na"), (-F.col("b")).alias("nb"))).alias("best"),
    )
    none = F.exp(F.col("la") + F.col("lb"))
    null, first = none + NULL_FLOOR, none * F.col("best.ratio")
    decided = total.withColumn("matched", first > null).withColumn("p", F.greatest(first, null) / (null + none * F.col("ratios")))
    simple = decided.where("matched").select(*k, (-F.col("best.na")).alias("a"), (-F.col("best.nb")).alias("b"))
    large = sized.where((F.col("n_a") > 1) & (F.col("n_b") > 1))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in grid.select(*k).schema) + ", a bigint, b bigint, p double"

    def solved(part: pd.DataFrame) -> list[tuple]:
        ids_a, at_a = np.unique(part["a"], return_inverse=True)
        ids_b, at_b = np.unique(part["b"], return_inverse=True)
        cw, fa, fb = np.zeros((len(ids_a), len(ids_b))), np.empty(len(ids_a)), np.empty(len(ids_b))
        cw[at_a, at_b], fa[at_a], fb[at_b] = part["cw"], part["fa"], part["fb"]
        pick, p = best_matching(cw, fa, fb)
        name = tuple(part[c].iloc[0] for c in k)
        return [(*name, int(ids_a[i]), int(ids_b[j]), p) for i, j in pick] or [(*name, None, None, p)]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the island that the last batch ended in
        for part in parts:
            part = part if held is None else pd.concat([held, part])
            islands = [rows for _, rows in part.groupby(k, sort=False)]
            held = islands.pop()
            yield table([row for rows in islands for row in solved(rows)])
        if held is not None:
            yield table(solved(held))

    def table(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*k, "a", "b", "p"]).astype({"a": "Int64", "b": "Int64"})

    hard = large.select(*k, "a", "b", "cw", "fa", "fb").repartition(*k).sortWithinPartitions(*k).mapInPandas(run, schema)  # many small islands to a batch
    hard = written(hard, "hard")
    matches = simple.unionByName(hard.where("a is not null").select(*k, "a", "b"))
    return matches, decided.select(*k, "p").unionByName(hard.groupBy(*k).agg(F.first("p").alias("p")))


def match_table(grid: DataFrame, matches: DataFrame, evidence: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, island, a, b, match_p, sep, eta, xi)."""
    k = [*keys, "island"]
    return large_join(large_join(matches, grid.drop("g", "cw", "fa", "fb"), [*k, "a", "b"]), evidence, k).withColumnRenamed("p", "match_p")


def nonmatch_table(members: DataFrame, grid: DataFrame, matches: DataFrame, evidence: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, side, id, island, match_p, nnm_sep, nnm_eta, nnm_xi): sources left over, with the nearest one left on the other side."""
    k = [*keys, "island"]
    used = matches.select(*k, F.lit("a").alias("side"), F.col("a").alias("id")).unionByName(matches.select(*k, F.lit("b").alias("side"), F.col("b").alias("id")))
    left = large_join(members, used, [*k, "side", "id"], "left_anti")
    free = lambda which: left.where(F.col("side") == which).select(*k, F.col("id").alias(which))
    open_pairs = large_join(large_join(grid, free("a"), [*k, "a"], "left_semi"), free("b"), [*k, "b"], "left_semi")
    near = None
    for which, other in (("a", "b"), ("b", "a")):
        best = open_pairs.groupBy(*k, which).agg(F.min(F.struct("sep", other, "eta", "xi")).alias("m"))
        best = best.select(*k, F.lit(which).alias("side"), F.col(which).alias("id"), F.col("m.sep").alias("nnm_sep"), F.col("m.eta").alias("nnm_eta"), F.col("m.xi").alias("nnm_xi"))
        near = best if near is None else near.unionByName(best)
    out = large_join(large_join(left, evidence, k, "left"), near, [*k, "side", "id"], "left")
    return out.select(*keys, "side", "id", "island", F.coalesce("p", F.lit(1.0)).alias("match_p"), "nnm_sep", "nnm_eta", "nnm_xi")


def enumerated(n_a: int, n_b: int) -> Iterator[list[tuple[int, int]]]:
    """All partial matchings of two sides, in the order in which they are tried."""
    for k in range(min(n_a, n_b) + 1):
        for ia in itertools.combinations(range(n_a), k):
            for ib in itertools.permutations(range(n_b), k):
                yield list(zip(ia, ib, strict=True))
