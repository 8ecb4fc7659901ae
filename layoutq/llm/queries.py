"""Queries of this subpackage for the driver contract, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .embedding_dedup import OP2_SQL, op2_embedding_dedup
from .jaccard_join import OP8_SQL, op8_jaccard_join
from .packing import op5_best_fit_packing
from .private_data import op6_private_data
from .quality_classifier import op10_quality_classifier
from .quality_rules import OP1_SQL, op1_quality_rules
from .secret_scan import op9_secret_scan
from .source_mixing import op7_source_mixing
from .suffix_dedup import op4_suffix_dedup
from .token_files import op3_token_files

OPERATORS = (op1_quality_rules, op2_embedding_dedup, op3_token_files, op4_suffix_dedup, op5_best_fit_packing, op6_private_data, op7_source_mixing, op8_jaccard_join, op9_secret_scan, op10_quality_classifier)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op2_embedding_dedup": OP2_SQL, "op8_jaccard_join": OP8_SQL}
