"""Importance resampling against a plain version."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from curves.llm import resampling
from curves.llm.resampling import BUCKETS, buckets, cleaned, gains, ranked, resample, spans
from tests.llm.data import ODD, documents, prose


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def grams(text, least, most):
    ws = words(text)
    return [" ".join(ws[k : k + n]) for n in range(least, most + 1) for k in range(len(ws) - n + 1)]


def plain(docs, target, ngrams=(1, 1), size=BUCKETS, seed=2024, percent=10, least_words=20):
    """Sorted (doc_id, n_features, weight, score, rank)."""
    bucket = lambda g: zlib.crc32(g.encode()) % size
    s = Counter(bucket(g) for _, text in docs for g in grams(text, *ngrams))
    t = Counter(bucket(g) for text in target for g in grams(text, *ngrams))
    total, aim = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (total + size) / ((s[b] + 1.0) * (aim + size))))
    rows = []
    for doc_id, text in docs:
        found = [gain(bucket(g)) for g in grams(text, *ngrams)]
        unit = (int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16) + 0.5) / 2**32
        weight = sum(found) // len(found) if found else 0
        rows.append([len(words(text)) >= least_words, doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log(unit)))])
    rows.sort(key=lambda r: (not r[0], -r[4], r[1] is not None, r[1] or 0))
    drawn = sum(r[0] for r in rows) * percent // 100
    return sorted((tuple(r[1:]) + (k + 1 if k < drawn and r[0] else None,) for k, r in enumerate(rows)), key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("text", ["", None, " \n", "One", "A-b_c9  d", "é.ñ漢字!x\U0001f600 Y", "x" * 5000 + " y", "a b a b a"])
@pytest.mark.parametrize("n", [1, 2, 3])
def test_spans_are_all_ngrams(text, n):
    clean = cleaned(text)
    assert clean.decode() == " ".join(words(text))
    assert [m[0].decode() for m in spans(n).finditer(clean, overlapped=True)] == grams(text, n, n)
    assert list(buckets(clean, [spans(n)], 100)) == [zlib.crc32(g.encode()) % 100 for g in grams(text, n, n)]


def test_gains_are_of_shares_not_of_sizes():
    import numpy as np

    one, two = np.array([5, 0, 1]), np.array([10_000, 0, 0])
    assert gains(one, one).tolist() == [0, 0, 0] and gains(one, two)[0] > 0 > gains(one, two)[1]


@pytest.mark.parametrize("ngrams, percent, size", [((1, 1), 10, BUCKETS), ((1, 2), 37, 500), ((2, 3), 100, 7), ((1, 1), 0, 50)])
def test_ranks_of_odd_rows(spark, ngrams, percent, size):
    texts = [*ODD, *(prose(i, 40) for i in range(60)), *(prose(3, 40),) * 9, (2**60 + 1, prose(9, 30)), (None, prose(9, 30)), (None, prose(9, 30)), (5, prose(1, 20)), (5, prose(1, 20)), "Long text " * 60_000]
    docs = documents(spark, texts).withColumns({c: F.lit(1) for c in ("id", "rank", "weight", "score", "at", "short")})
    target = [None, "", prose(5, 100, 30), prose(6, 50, 30)]
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = ranked(docs, aim, ngrams=ngrams, percent=percent, size=size)
    assert result(got) == plain(rows, target, ngrams, size, percent=percent)
    drawn = resample(docs, aim, ngrams=ngrams, percent=percent, size=size)
    assert drawn.columns == docs.columns
    assert drawn.count() == got.filter("rank is not null").count() == sum(len(words(t)) >= 20 for _, t in rows) * percent // 100


def test_empty_tables_and_string_ids(spark):
    docs = documents(spark, [prose(i, 30) for i in range(30)])
    none = docs.limit(0)
    assert ranked(none, docs).count() == 0 and resample(none, none).count() == 0
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(ranked(docs, none)) == plain(rows, [])
    named = docs.withColumn("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")))
    assert resample(named, docs).count() == 3


def test_a_draw_leans_to_the_target(spark):
    docs = documents(spark, [prose(i, 60, 50) if i % 4 else " ".join(f"aim{(i * k) % 23}" for k in range(60)) for i in range(200)])
    aim = spark.createDataFrame([(" ".join(f"aim{k % 23}" for k in range(200)),)], "text string")
    drawn = [r.doc_id for r in resample(docs, aim, percent=20).collect()]
    assert len(drawn) == 40 and sum(i % 4 == 0 for i in drawn) >= 25  # by chance 10


def test_query_is_registered_with_its_parameters():
    assert (resampling.BUCKETS, resampling.SEED, resampling.SHARE_PERCENT, resampling.LEAST_WORDS, resampling.NGRAMS) == (10_000, 2024, 10, 20, (1, 1))
