"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .op1_topk import OP1_SQL, op1_topk
from .op2_html import op2_html
from .op3_substring_dedup import OP3_SQL, op3_substring_dedup
from .op4_near_dedup import OP4_SQL, op4_near_dedup
from .op5_token_counts import op5_token_counts
from .op6_mixing import OP6_SQL, op6_mixing
from .op7_packing import op7_packing
from .op8_quality import op8_quality
from .op9_neighbours import OP9_SQL, op9_neighbours
from .op10_pii import OP10_SQL, op10_pii
from .op11_token_files import op11_token_files
from .op12_clusters import OP12_SQL, op12_clusters
from .op13_spelling import OP13_SQL, op13_spelling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_html": op2_html,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_near_dedup": op4_near_dedup,
    "op5_token_counts": op5_token_counts,
    "op6_mixing": op6_mixing,
    "op7_packing": op7_packing,
    "op8_quality": op8_quality,
    "op9_neighbours": op9_neighbours,
    "op10_pii": op10_pii,
    "op11_token_files": op11_token_files,
    "op12_clusters": op12_clusters,
    "op13_spelling": op13_spelling,
}

ORACLES: dict[str, str] = {
    "op1_topk": OP1_SQL,
    "op3_substring_dedup": OP3_SQL,
    "op4_near_dedup": OP4_SQL,
    "op6_mixing": OP6_SQL,
    "op9_neighbours": OP9_SQL,
    "op10_pii": OP10_SQL,
    "op12_clusters": OP12_SQL,
    "op13_spelling": OP13_SQL,
}
