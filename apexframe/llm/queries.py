"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .alignment import op12_shared_cuts
from .audio import op4_audio_features
from .chat import OP3_SQL, op3_prefix_target_chat
from .compact_windows import op10_compact_windows
from .decontaminate import op5_simhash_decontamination
from .html_text import op9_host_suffix_text
from .mixing import OP7_SQL, op7_waterfill_mix
from .packing import op13_pattern_packing
from .parity_join import OP8_SQL, op8_parity_sketch_join
from .sharding import op1_hash_tree_shards
from .toxicity import op6_gru_toxicity
from .vector_codes import OP11_SQL, op11_cell_codes
from .warc import op2_warc_splittable

QUERIES = (
    op1_hash_tree_shards, op2_warc_splittable, op3_prefix_target_chat, op4_audio_features, op5_simhash_decontamination, op6_gru_toxicity,
    op7_waterfill_mix, op8_parity_sketch_join, op9_host_suffix_text, op10_compact_windows,
    op11_cell_codes, op12_shared_cuts, op13_pattern_packing,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_prefix_target_chat": OP3_SQL, "op7_waterfill_mix": OP7_SQL, "op8_parity_sketch_join": OP8_SQL, "op11_cell_codes": OP11_SQL}
