"""The queries of the operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .bpe_automaton import op9_bpe_automaton
from .chat_trees import op13_reply_trees
from .decontamination import op8_contained_benchmarks
from .divergence import op11_source_divergence
from .importance import op7_importance_resampling
from .line_dedup import op6_line_dedup
from .ngram_join import op3_jaccard_components
from .passages import op1_repeated_passages
from .quality_rules import op4_repetition_coverage
from .sharding import op10_kd_shards
from .target_resampling import op12_target_resampling
from .token_counts import op2_token_counts
from .url_filters import op5_url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_repeated_passages,
        op2_token_counts,
        op3_jaccard_components,
        op4_repetition_coverage,
        op5_url_filters,
        op6_line_dedup,
        op7_importance_resampling,
        op8_contained_benchmarks,
        op9_bpe_automaton,
        op10_kd_shards,
        op11_source_divergence,
        op12_target_resampling,
        op13_reply_trees,
    )
}
ORACLES: dict[str, str] = {k: v for k, v in oracles.SQL.items() if k in QUERIES}
