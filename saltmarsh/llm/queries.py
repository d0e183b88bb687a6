"""The subpackage's registered queries and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from saltmarsh.llm import contamination, divergence, imatch, langid, limbcodes, linecrf, minhash, secrets, substrings, suffixtree, tokenfile, triebpe, urlrank
from saltmarsh.llm._io import prepare

_QUERIES = {
    "op1_secret_scan": secrets.query,
    "op2_url_filter": urlrank.query,
    "op3_decontamination": contamination.query,
    "op4_language_id": langid.query,
    "op5_minhash_dedup": minhash.query,
    "op6_imatch_fingerprint": imatch.query,
    "op7_suffix_tree_lm": suffixtree.query,
    "op8_trie_bpe": triebpe.query,
    "op9_suffix_array_dedup": substrings.query,
    "op10_token_file": tokenfile.query,
    "op11_source_divergence": divergence.query,
    "op12_line_quality": linecrf.query,
    "op13_limb_codes": limbcodes.query,
    "pipeline": corpus_pipeline.run,
}


def _on_cluster(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _on_cluster(query) for name, query in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": contamination.ORACLE, "op11_source_divergence": divergence.ORACLE, "op13_limb_codes": limbcodes.ORACLE}
