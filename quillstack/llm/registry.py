"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op2_byte_level_bpe
from .html_wrappers import op4_html_extraction
from .line_crf import op9_quality_classifier
from .minhash_dedup import op8_minhash_near_dedup
from .mixing import op5_mixing_sources
from .quality_rules import op7_quality_rules
from .sharding import op1_sharding
from .simhash_trie import op12_simhash_near_dedup
from .spelling import SQL as SPELLING_SQL
from .spelling import op11_spelling_variants
from .substring_dedup import op3_substring_dedup
from .suffix_dedup import op10_suffix_array_dedup
from .whitening import op13_embedding_whitening
from .winnowing import op6_document_fingerprints

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_byte_level_bpe,
        op3_substring_dedup,
        op4_html_extraction,
        op5_mixing_sources,
        op6_document_fingerprints,
        op7_quality_rules,
        op8_minhash_near_dedup,
        op9_quality_classifier,
        op10_suffix_array_dedup,
        op11_spelling_variants,
        op12_simhash_near_dedup,
        op13_embedding_whitening,
    )
}

ORACLE_SQL: dict[str, str] = {"op11_spelling_variants": SPELLING_SQL}
