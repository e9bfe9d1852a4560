"""Queries of the corpus operators and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .conversations import op11_conversation_repair
from .decontaminate import OP5_SQL, op5_benchmark_decontamination
from .language import op10_language_id
from .line_dedup import OP13_SQL, op13_line_dedup
from .neighbours import op9_one_bit_neighbours
from .packing import op6_packing
from .periodic_runs import op12_periodic_runs
from .pseudonyms import op3_pseudonyms
from .secrets import OP4_SQL, op4_secret_scan
from .sharding import op7_uniform_shards
from .simhash import op2_simhash_near_dedup
from .substring_dedup import OP1_SQL, op1_substring_dedup
from .suffix_dedup import OP8_SQL, op8_suffix_dedup

QUERIES = (
    op1_substring_dedup,
    op2_simhash_near_dedup,
    op3_pseudonyms,
    op4_secret_scan,
    op5_benchmark_decontamination,
    op6_packing,
    op7_uniform_shards,
    op8_suffix_dedup,
    op9_one_bit_neighbours,
    op10_language_id,
    op11_conversation_repair,
    op12_periodic_runs,
    op13_line_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1_SQL, "op4_secret_scan": OP4_SQL, "op5_benchmark_decontamination": OP5_SQL, "op8_suffix_dedup": OP8_SQL, "op13_line_dedup": OP13_SQL}
