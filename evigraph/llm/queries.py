"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, jpeg_media, lexical_search, line_dedup, mixing, packing, quality_rules, secret_scan, simhash, suffix_dedup, topk, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_simhash": simhash.op3_simhash,
    "op4_jpeg_media": jpeg_media.op4_jpeg_media,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_topk": topk.op9_topk,
    "op10_packing": packing.op10_packing,
    "op11_collocations": collocations.op11_collocations,
    "op12_quality_rules": quality_rules.op12_quality_rules,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup.OP1_SQL,
    "op2_mixing": mixing.OP2_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op7_secret_scan": secret_scan.OP7_SQL,
    "op8_line_dedup": line_dedup.OP8_SQL,
    "op9_topk": topk.OP9_SQL,
    "op11_collocations": collocations.OP11_SQL,
    "op12_quality_rules": quality_rules.OP12_SQL,
    "op13_lexical_search": lexical_search.OP13_SQL,
}
