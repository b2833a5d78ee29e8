"""The queries of this subpackage, by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import ann, bpe, line_dedup, mixing, quality, simhash, substring_dedup, suffix_dedup, token_shards, url_filter

QUERIES = {
    "op1_url_filter": url_filter.query,
    "op2_bpe_automaton": bpe.query,
    "op3_temperature_mixing": mixing.query,
    "op4_suffix_dedup": suffix_dedup.query,
    "op5_quality_rules": quality.query,
    "op6_line_dedup": line_dedup.query,
    "op7_simhash_dedup": simhash.query,
    "op8_learned_partitions": ann.query,
    "op9_token_shards": token_shards.query,
    "op10_substring_dedup": substring_dedup.query,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {
    "op1_url_filter": url_filter.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op10_substring_dedup": substring_dedup.ORACLE,
}
