"""The training-data queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import op9_query
from .decontaminate import op10_query
from .langid import op8_query
from .lines import op2_query
from .lm import op4_query
from .minhash import op7_query
from .oracle import EMBEDDINGS, LEAKS, LINE_DEDUP, NEAR_DUPLICATES
from .order import op5_query
from .packing import op6_query
from .sharding import op1_query
from .vectors import op3_query

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bin_pack_shards": op1_query,
    "op2_line_dedup": op2_query,
    "op3_itq_embeddings": op3_query,
    "op4_pseudo_likelihood": op4_query,
    "op5_training_order": op5_query,
    "op6_mixture_packing": op6_query,
    "op7_prob_minhash": op7_query,
    "op8_language_id": op8_query,
    "op9_chat_windows": op9_query,
    "op10_template_decontamination": op10_query,
}

#: The others train a model, sketch at random or tokenise: they are tested against brute force and exact round trips.
ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": LINE_DEDUP,
    "op3_itq_embeddings": EMBEDDINGS,
    "op7_prob_minhash": NEAR_DUPLICATES,
    "op10_template_decontamination": LEAKS,
}
