"""What the subpackage adds to the library's queries and to their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planespark.llm import queries as q
from planespark.llm import sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_duplicates": q.op1_near_duplicates,
        "op2_bpe": q.op2_bpe,
        "op3_toxicity": q.op3_toxicity,
        "op4_warc": q.op4_warc,
        "op5_topk": q.op5_topk,
        "op6_chat": q.op6_chat,
        "op7_language": q.op7_language,
        "op8_gif": q.op8_gif,
        "op9_token_counts": q.op9_token_counts,
        "op10_packing": q.op10_packing,
        "op11_alignment": q.op11_alignment,
        "op12_jaccard_join": q.op12_jaccard_join,
        "op13_centroids": q.op13_centroids,
    }


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that DuckDB can express; the others are tested against brute force or the tokenizers library."""
    return {"op1_near_duplicates": sql.NEAR_DUPLICATES, "op4_warc": sql.WARC, "op5_topk": sql.TOPK, "op6_chat": sql.CHAT, "op12_jaccard_join": sql.JACCARD_JOIN, "op13_centroids": sql.CENTROIDS}
