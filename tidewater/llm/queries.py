"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import jaccard_join, license_rules, media_columns, multiprobe_lsh, quality_crf, source_mixing, suffix_pieces, toxicity_grammar, url_rules, warc_salvage

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_quality_classifier": quality_crf.op1,
    "op2_toxicity": toxicity_grammar.op2,
    "op3_ngram_jaccard_join": jaccard_join.op3,
    "op4_source_mixing": source_mixing.op4,
    "op5_sentencepiece": suffix_pieces.op5,
    "op6_license_scans": license_rules.op6,
    "op7_warc": warc_salvage.op7,
    "op8_url_filters": url_rules.op8,
    "op9_nearest_neighbours": multiprobe_lsh.op9,
    "op10_media_columns": media_columns.op10,
}

#: DuckDB SQL for those that SQL can express within reason.
ORACLE_SQL: dict[str, str] = {
    "op7_warc": warc_salvage.ORACLE,
    "op8_url_filters": url_rules.ORACLE,
}
