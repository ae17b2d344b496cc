from __future__ import annotations

import pytest

#: A table of each kind with awkward rows: nulls, empty texts, ties, repeats, a very long text.
LONG = " ".join(f"word{i % 977} tail{i % 31}" for i in range(40_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here today"),
    (2, "the QUICK brown fox jumps over the lazy dog and runs far away from here today"),
    (3, "The quick brown fox jumps over the lazy dog and runs far away from here now"),
    (4, ""),
    (5, None),
    (6, "   \t\n "),
    (7, "one two"),
    (7, "one two"),
    (None, "a row without an id"),
    (8, LONG),
    (9, LONG + " end"),
    (10, "Éa  double  spaces\nand\r\nlines\x0band <|endoftext|> marks ÉA éa  wide  "),
    (11, "zero\x00byte and \x1c separators \x85 too"),
    (-3, "one two"),
]


@pytest.fixture()
def docs(spark):
    """With extra columns whose names clash with those the operators use inside."""
    rows = [(k, t, "x", 1.5, i) for i, (k, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, id double, row long").withColumnRenamed("id", "key")


@pytest.fixture()
def no_docs(docs):
    return docs.where("false")
