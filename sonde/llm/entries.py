"""Queries and SQL of the training-data operators, for ``__spark_entry__``."""

from __future__ import annotations

from .decontaminate import op10
from .language_id import op1
from .line_dedup import OP5_SQL, op5
from .mixing import OP7_SQL, op7
from .near_dup import op4
from .packing import op9
from .perplexity import op2
from .secrets import OP3_SQL, op3
from .sharding import in_small_shards, op6, op6_sql
from .style_tree import op8


def queries() -> dict:
    return {
        "op1_language_id": op1,
        "op2_perplexity": op2,
        "op3_secret_scan": op3,
        "op4_simhash_near_dedup": op4,
        "op5_line_dedup": op5,
        "op6_sharding": op6,
        "sharding_64_kb": in_small_shards,
        "op7_source_mixing": op7,
        "op8_style_tree": op8,
        "op9_packing": op9,
        "op10_benchmark_decontamination": op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_secret_scan": OP3_SQL, "op5_line_dedup": OP5_SQL, "op6_sharding": op6_sql(), "sharding_64_kb": op6_sql(64 << 10), "op7_source_mixing": OP7_SQL}
