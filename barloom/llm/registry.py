"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import ball_kmeans, chat, exact_dedup, lm_score, mixing, near_dedup, nn_descent, packing, quality, ranked_search, substring_dedup, token_files, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_lm_score": lm_score.op2_lm_score,
        "op3_url_filter": url_filter.op3_url_filter,
        "redirected_pages": url_filter.redirected_pages,
        "op4_quality": quality.op4_quality,
        "op5_nn_descent": nn_descent.op5_nn_descent,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_packing": packing.op8_packing,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_chat": chat.op10_chat,
        "op11_token_files": token_files.op11_token_files,
        "op12_ball_kmeans": ball_kmeans.op12_ball_kmeans,
        "op13_ranked_search": ranked_search.op13_ranked_search,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": url_filter.ORACLE, "redirected_pages": url_filter.REDIRECT_ORACLE, "op7_exact_dedup": exact_dedup.ORACLE, "op10_chat": chat.ORACLE, "op12_ball_kmeans": ball_kmeans.ORACLE, "op13_ranked_search": ranked_search.ORACLE}
