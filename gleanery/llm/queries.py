"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bpe import op2_byte_bpe
from .bpe_rounds import op13_bpe_rounds
from .divergence import OP11_SQL, op11_source_divergence
from .graph_dedup import op1_vector_dedup
from .language_id import op9_language_id
from .mixing import OP4_SQL, op4_mixing
from .quantized_search import op3_nearest_neighbours
from .sharding import op8_sharding
from .simhash import op7_simhash
from .toxicity import op6_toxicity
from .token_counts import op5_token_counts
from .token_store import op10_token_store
from .whitening import op12_whitening

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_vector_dedup": op1_vector_dedup,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_nearest_neighbours": op3_nearest_neighbours,
        "op4_mixing": op4_mixing,
        "op5_token_counts": op5_token_counts,
        "op6_toxicity": op6_toxicity,
        "op7_simhash": op7_simhash,
        "op8_sharding": op8_sharding,
        "op9_language_id": op9_language_id,
        "op10_token_store": op10_token_store,
        "op11_source_divergence": op11_source_divergence,
        "op12_whitening": op12_whitening,
        "op13_bpe_rounds": op13_bpe_rounds,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_mixing": OP4_SQL, "op11_source_divergence": OP11_SQL}
