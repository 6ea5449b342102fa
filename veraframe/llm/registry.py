"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .embedding_dedup import op3_embedding_dedup
from .line_dedup import op9_line_dedup
from .minhash import op5_minhash
from .mixing import op2_mixing
from .packing import op7_packing
from .pii import op10_pii
from .quality_classifier import op6_quality_classifier
from .quality_rules import op8_quality_rules
from .secret_scan import op4_secrets
from .token_counts import op1_token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_token_counts, op2_mixing, op3_embedding_dedup, op4_secrets, op5_minhash, op6_quality_classifier, op7_packing, op8_quality_rules, op9_line_dedup, op10_pii)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    """Of two queries. The others hang on a tokenizer, a model, drawn numbers or a search that finds most links, not all; tests hold them against brute force."""
    return {"op5_minhash": oracles.OP5, "op9_line_dedup": oracles.OP9}
