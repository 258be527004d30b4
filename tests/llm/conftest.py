from __future__ import annotations

import pytest

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))

EDGE_TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away from here today."),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from here today."),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "%%% *** 123"),
    (7, "Ünïcode 日本語 🙂 text\u00a0with blanks<|endoftext|> and more"),
    (8, LONG),
    (8, LONG),
    (9, "a"),
    (None, "a row without an id"),
    (10, 'secret = "hunter2hunter2" CC BY all rights reserved'),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    names = "doc_id long, text string, lang string, source string, n_chars long, key long, words string, score string, found string, n long, text_hash int"
    rows = [(i, t, "en", None, len(t) if t else None, 1, "w", "s", "f", None, 7) for i, t in EDGE_TEXTS]
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
