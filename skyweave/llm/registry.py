"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, divergence, exact_dedup, fingerprints, html_text, language, licences, near_dedup, packing, resampling, secrets, surrogates, top_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        near_dedup.op1_near_dedup,
        exact_dedup.op2_exact_dedup,
        fingerprints.op3_fingerprints,
        packing.op4_best_fit_packing,
        secrets.op5_secret_scan,
        licences.op6_licence_scan,
        surrogates.op7_pii_surrogates,
        bpe.op8_byte_bpe,
        language.op9_language_id,
        html_text.op10_html_text,
        divergence.op11_divergence,
        resampling.op12_resampling,
        top_search.op13_top_search,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": near_dedup.OP1_SQL,
    "op2_exact_dedup": exact_dedup.OP2_SQL,
    "op5_secret_scan": secrets.OP5_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op12_resampling": resampling.OP12_SQL,
    "op13_top_search": top_search.OP13_SQL,
}
