"""One-permutation MinHash: likeness against exact resemblance, pairs of neighbours, odd rows."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from curves.llm import line_dedup, minhash, packing
from curves.llm.minhash import Fingerprinter, fingerprints
from tests.llm.data import ODD, documents, prose


def resemblance(a, b):
    x, y = ({tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1))} for ws in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_likeness_is_close_to_resemblance():
    tool = Fingerprinter()
    errors = []
    for seed in range(40):
        n = 60 + 40 * seed
        a = prose(seed, n, 5000)
        cut = int(n * seed / 40)
        b = " ".join(a.split()[:cut] + prose(seed + 99, n - cut, 5000).split())
        errors.append(tool.likeness(tool(a), tool(b)) - resemblance(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_densification_fills_every_bin_alike():
    tool = Fingerprinter()
    least = tool.minima("one two three four five six")
    assert len(set(least.tolist())) == 2  # two shingles fill all bins
    assert len(set(tool.minima("one").tolist())) == 1
    assert tool("one two") == tool("ONE  two") and tool("") == tool(" \n") == ""
    assert tool.likeness("", "") == 1 and tool.likeness("", tool("a")) == 0


def test_every_row_meets_its_successor(spark):
    texts = [(i * 3, prose(i, 5 + i % 40)) for i in range(300)]
    want = {}
    for (i, t), (_, u) in zip(texts, texts[1:] + texts[:1], strict=True):
        half = len(t) // 2
        want[i] = hashlib.sha256((t[: len(t) - half] + u[:half]).encode()).hexdigest()
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = fingerprints(documents(spark, texts).repartition(5)).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)
        assert {r.doc_id: r.edited_sha256 for r in got} == want and len(got) == 300
        tool, by = Fingerprinter(), dict(texts)
        assert all(r.fingerprint == tool(by[r.doc_id]) and r.n_chars == len(by[r.doc_id]) for r in got)


def test_an_id_on_many_rows_spreads_and_is_followed_in_order(spark):
    """A third of the rows has a null id and a third one id; each row's next is the one after it by id and text hash."""
    texts = [(None, prose(i, 5)) for i in range(200)] + [(5, prose(1000 + i, 5)) for i in range(200)] + [(i, prose(2000 + i, 5)) for i in range(200) if i != 5]
    docs = documents(spark, texts)
    keyed = docs.selectExpr("doc_id", "text", "shiftright(xxhash64(text), 11) AS h").collect()
    order = sorted(keyed, key=lambda r: (-(2**63) if r.doc_id is None else r.doc_id, r.h))
    want = sorted((str(a.doc_id), a.text, b.text) for a, b in zip(order, order[1:] + order[:1], strict=True))
    for parts in ("2", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = minhash.with_next(docs, "doc_id", "text", lambda i, t, u: (i, t, u), "a bigint, b string, c string").collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted((str(r.a), r.b, r.c) for r in got) == want
    rows = docs.selectExpr("coalesce(doc_id, -9223372036854775808) AS key", "shiftright(xxhash64(text), 11) AS h")
    bounds = minhash._bounds(rows, 24)
    at, _ = minhash._placed(*(rows.toPandas()[c].to_numpy() for c in ("key", "h")), bounds)
    assert np.bincount(at).max() < 60 and len(bounds) > 15


def test_ids_beyond_the_precision_of_doubles(spark):
    texts = [(2**62 + 3 * i, prose(i, 5)) for i in range(300)]
    got = minhash.with_next(documents(spark, texts), "doc_id", "text", lambda i, t, u: (i, u), "a bigint, b string").collect()
    assert {r.a: r.b for r in got} == {a: u for (a, _), (_, u) in zip(texts, texts[1:] + texts[:1], strict=True)} and len(got) == 300


def test_equal_rows_and_a_very_long_text(spark):
    docs = documents(spark, [(1, "same"), (1, "same"), (1, "same"), (2, prose(1, 300_000))])
    got = sorted((r.doc_id, r.n_chars, r.near_next) for r in fingerprints(docs).collect())
    assert [r[0] for r in got] == [1, 1, 1, 2] and sorted(r[2] for r in got)[-2:] == [1.0, 1.0]


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    got = fingerprints(docs).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in docs.collect())
    one = fingerprints(documents(spark, ["alone in the world"])).first()
    assert one.near_next == 1.0
    assert fingerprints(docs.limit(0)).count() == 0


def test_huge_ids_beside_a_null_id(spark):
    ids = [*(2**60 + 2 * i + 1 for i in range(6)), None]
    got = fingerprints(documents(spark, [(i, prose(k, 20)) for k, i in enumerate(ids)]))
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in got.collect())


def test_short_unrelated_texts_are_unlike():
    tool = Fingerprinter()
    for n in range(1, 9):
        prints = [tool(prose(1000 * n + i, n, 10**6)) for i in range(120)]
        pairs = [tool.likeness(a, b) for k, a in enumerate(prints) for b in prints[:k]]
        assert max(pairs) < 0.2 and tool.likeness(prints[0], tool(prose(1000 * n, n, 10**6))) == 1.0


@pytest.mark.parametrize("operator", [fingerprints, packing.pack, line_dedup.dedup_lines])
def test_ids_that_are_not_integers_are_refused(spark, operator):
    with pytest.raises(TypeError):
        operator(documents(spark, ["a b"]).selectExpr("concat('n', doc_id) AS doc_id", "text"))
