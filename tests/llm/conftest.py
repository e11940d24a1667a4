from __future__ import annotations

import pytest

CLASH = ["_id", "_text", "_key", "_dropped", "row", "_c", "_h", "_n", "_sha", "host", "rule", "score", "kept", "keep_id"]
LONG = " ".join(f"w{i % 97}x{i % 13}" for i in range(30000))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text): nulls in either, empty, blank and long texts, repeated ids, rows and texts that differ in case."""
    return [
        (None, "one two three four five six seven"), (None, None), (1, None), (2, ""), (2, ""), (3, "One two THREE four five six seven"), (3, "one two three four five six eight"),
        (4, " \t\n "), (5, "word"), (6, "WORD"), (7, LONG), (8, LONG.upper()), (9, "été ÉTÉ Été"), (10, "été ÉTÉ été"), (11, "tool-call, 123! ünïcode space"), (5, "word"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with extra columns whose names clash with those that operators use."""
    schema = "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in CLASH)
    return spark.createDataFrame([(*r, *(["x"] * len(CLASH))) for r in odd_rows], schema)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (5, 0, 1), (None, 1, 1), (7, None, None), (9, 1, 0), (10, 1, 0)], "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
