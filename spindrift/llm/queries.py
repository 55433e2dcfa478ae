"""The thin queries ``opN_<name>`` over whole tables, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import decontaminate, jaccard_join, language_id, pii_tagger, quality_rules, secret_scan, sharding, source_mixing, suffix_dedup, url_filter
from spindrift.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_tagger": lambda s, d: pii_tagger.detect(read(s, d, "documents")),
    "op2_decontaminate": lambda s, d: decontaminate.contamination(read(s, d, "documents"), read(s, d, "benchmark")),
    "op3_quality_rules": lambda s, d: quality_rules.quality_query(read(s, d, "documents")),
    "op4_suffix_dedup": lambda s, d: suffix_dedup.dedup(read(s, d, "documents")),
    "op5_url_filter": lambda s, d: url_filter.judge(read(s, d, "pages")),
    "op6_secret_scan": lambda s, d: secret_scan.secrets_query(read(s, d, "documents")),
    "op7_sharding": lambda s, d: sharding.sharding_query(read(s, d, "documents")),
    "op8_language_id": lambda s, d: language_id.language_query(read(s, d, "documents")),
    "op9_source_mixing": lambda s, d: source_mixing.mixing_query(read(s, d, "documents")),
    "op10_jaccard_join": lambda s, d: jaccard_join.jaccard_query(read(s, d, "documents")),
    # op6 itself counts documents too, as its SQL does
    "op6_secret_scan_by_owner": lambda s, d: secret_scan.secrets_query(read(s, d, "documents"), max_repos=None),
}

ORACLES: dict[str, str] = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op3_quality_rules": quality_rules.ORACLE,
    "op6_secret_scan": secret_scan.ORACLE,
    "op9_source_mixing": source_mixing.ORACLE,
    "op10_jaccard_join": jaccard_join.ORACLE,
}
