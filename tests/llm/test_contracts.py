"""What the registered queries return, and that they take the tables whole."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from papyra.llm import registry
from papyra.llm.common import read

COLUMNS = {
    "op1": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op3": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op4": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op5": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op6": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op7": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op9": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op10": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
}


def test_ten_operators():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in registry.QUERIES) == list(range(1, 11)) and set(registry.SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("key", sorted(registry.QUERIES))
def test_columns_and_rows(spark, sf, key):
    out = registry.QUERIES[key](spark, sf)
    wanted = COLUMNS.get(key.split("_")[0], {})
    assert {c: t for c, t in out.dtypes if c in wanted} == wanted
    table = {"op7_url_filter": "pages", "op8_tool_calls": "conversations"}.get(key, "documents")
    assert out.count() == read(spark, sf, table).count()


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "bpe"]


@pytest.mark.parametrize("key", ["op2_sharding", "op3_exact_dedup", "op7_url_filter", "op8_tool_calls", "op9_decontaminate"])
def test_native_operators_run_no_python(spark, sf, key):
    plan = registry.QUERIES[key](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
