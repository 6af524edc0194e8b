"""The columns of what a match writes: both catalogues' own, the match's, and what was taken along."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.spatial import large_join

#: Places in ``Blends.cuts`` of contaminants with a hundredth and a tenth of a source's flux.
SHARES = {"CONT_F1": 1, "CONT_F10": 0}


@dataclass(frozen=True)
class Side:
    """How one catalogue's columns are called: ``name`` begins those that the match adds, ``extras`` are taken along."""

    which: str
    name: str
    bands: tuple[str, ...]
    extras: tuple[str, ...] = ()
    fitted: bool = False

    def own(self, keys: tuple[str, ...]) -> list[Column]:
        """The catalogue's position, quoted uncertainty, magnitudes and best band."""
        return [F.col(c).alias(f"{self.which}_{'sig' if c == 'quoted' else c}") for c in ("lon", "lat", "quoted", *self.bands, "best")]

    def more(self) -> list[Column]:
        """Columns taken along and, if it was fitted, the uncertainty that the match used."""
        return [F.col(f"extra_{c}").alias(f"{self.name}_{c}") for c in self.extras] + ([F.col("sig").alias(f"{self.name}_FIT_SIG")] if self.fitted else [])


def _quoted(cat: DataFrame) -> DataFrame:
    return cat if "quoted" in cat.columns else cat.withColumn("quoted", F.col("sig"))


def matched(matches: DataFrame, a: DataFrame, b: DataFrame, sides: tuple[Side, Side], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, a, b, both catalogues' columns, MATCH_P, SEPARATION, ETA, XI, contamination of both, extras, fitted uncertainties).

    Matches of which both sources are in the halo of their chunk are left out. Without blends,
    contaminating fluxes and shares are zero.
    """
    blended = "flux_a" in matches.columns
    out = matches
    names: list[str] = []
    late: list[str] = []
    for side, cat in zip(sides, (a, b), strict=True):
        own, more = side.own(keys), side.more()
        tagged = _quoted(cat).select(*keys, F.col("id").alias(side.which), F.col("halo").alias(f"__halo_{side.which}"), *own, *more)
        names += tagged.columns[len(keys) + 2 : len(keys) + 2 + len(own)]
        late += tagged.columns[len(keys) + 2 + len(own) :]
        out = large_join(out, tagged, [*keys, side.which])
    zero = F.lit(0.0)
    ours = [F.col("match_p").alias("MATCH_P"), F.col("sep").alias("SEPARATION"), F.col("eta").alias("ETA"), F.col("xi").alias("XI")]
    ours += [(F.col(f"flux_{s.which}") if blended else zero).alias(f"{s.name}_AVG_CONT") for s in sides]
    ours += [(F.get(f"contam_{s.which}", at) if blended else zero).alias(f"{s.name}_{share}") for s in sides for share, at in SHARES.items()]
    return out.where("NOT __halo_a OR NOT __halo_b").select(*keys, "a", "b", *names, *ours, *late)


def unmatched(nonmatches: DataFrame, cat: DataFrame, side: Side, aufs: DataFrame | None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, id, the catalogue's columns, MATCH_P, NNM_SEPARATION, NNM_ETA, NNM_XI, AVG_CONT, extras, fitted uncertainty) of one side's sources outside the halo."""
    own, more = side.own(keys), side.more()
    cell = ["nm"] if aufs is not None else []
    tagged = _quoted(cat).where("not halo").select(*keys, "id", *cell, *own, *more)
    out = large_join(nonmatches.where(F.col("side") == side.which), tagged, [*keys, "id"])
    if aufs is not None:
        out = out.join(aufs.select("nm", F.col("flux").alias("__flux")), "nm", "left")
    flux = F.coalesce("__flux", F.lit(0.0)) if aufs is not None else F.lit(0.0)
    names = tagged.columns[len(keys) + 1 + len(cell) :]
    ours = [F.col("match_p").alias("MATCH_P"), F.col("nnm_sep").alias("NNM_SEPARATION"), F.col("nnm_eta").alias("NNM_ETA"), F.col("nnm_xi").alias("NNM_XI"), flux.alias(f"{side.name}_AVG_CONT")]
    return out.select(*keys, "id", *names[: len(own)], *ours, *names[len(own) :])
