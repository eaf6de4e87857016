"""Small tables for the operators' tests."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, count int, key string, f int, n int"


def documents(spark, texts, schema=SCHEMA):
    """documents with clashing extra columns; texts: text, or (doc_id, text)."""
    rows = []
    for i, t in enumerate(texts):
        doc_id, text = t if isinstance(t, tuple) else (i, t)
        rows.append((doc_id, text, "en", f"src{i % 3}", len(text or ""), 1, "k", 2, 3))
    return spark.createDataFrame(rows, schema)


def prose(seed: int, n: int, vocabulary: int = 400) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


#: Null, empty, blank, ties, repeated rows and null ids.
ODD = [None, "", " \n\t ", "one", "one", (7, "same row of words"), (7, "same row of words"), (None, "no id here"), (None, None), "é ñ 漢字 \U0001f600 x"]
