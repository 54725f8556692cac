"""Tables that several of these tests use."""

import pytest

SMALL = "/root/testdata/sf0.001"

# NULLs, empty and blank texts, one very long text, repeated rows, ties, and texts that imitate control strings.
ODD_TEXTS = [
    None, "", " \n\t ", "a", "The cat sat.", "The cat sat.", "the  cat\tsat .", "ÀÉ ß İ ﬁ é 日本 𝄞  x", "12 345 ²",
    "<|endoftext|> <s> </turn> \\", "home | about | contact | help", "word " * 30000, "no mark here " * 5,
    "One line stands here as it should, quite well.\nOne line stands here as it should, quite well.\nAll rights reserved.",
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, `row` string, score double, shard int"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with every odd text; ids repeat with equal rows, one id is NULL, and other columns carry clashing names."""
    rows = [(i, t, "en" if i % 2 else None, [None, "b", "a"][i % 3], None, 1, "x", 0.5, 2) for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[4], (None, "The cat sat.", None, "a", 3, 1, "x", 0.5, 2)]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")
