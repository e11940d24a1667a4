"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from papyra.llm import bpe, decontaminate, exact_dedup, lm, near_dedup, quality, sharding, tool_calls, toxicity, url_filter

QUERIES: dict[str, Callable] = {
    "op1_quality": quality.op1_quality,
    "op2_sharding": sharding.op2_sharding,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_lm": lm.op5_lm,
    "op6_bpe": bpe.op6_bpe,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_tool_calls": tool_calls.op8_tool_calls,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_toxicity": toxicity.op10_toxicity,
}
SQL: dict[str, str] = {
    "op2_sharding": sharding.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op7_url_filter": url_filter.SQL,
    "op8_tool_calls": tool_calls.SQL,
    "op9_decontaminate": decontaminate.SQL,
}
