import pytest

#: What every operator must stand: nulls, empty and long texts, ties, repeated rows, clashing extra columns.
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (None, "no identifier here"),
    (None, None),
    (5, "same text twice"),
    (5, "same text twice"),
    (6, "same  text\ttwice"),
    (7, "word " * 30_000),
    (8, "x" * 100_000),
    (9, "é 你好 \U0001f600 ß ▁ end"),
]


@pytest.fixture()
def odd(spark):
    rows = [(i, t, "k", 1, "s", b"b") for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, k string, shard int, digest string, items binary")


@pytest.fixture()
def docs_of(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
