"""Bottom-k near-duplicates against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curves.llm import bottom_k
from curves.llm.bottom_k import K, drop, estimate, near_duplicates, op11_bottom_k, packed, shingles, unpacked
from tests.compare import DATA
from tests.llm.data import ODD, documents, prose


def grams(text, size=2):
    ws = (text or "").encode().lower().split()
    return {b" ".join(ws[k : k + size]) for k in range(len(ws) - size + 1)} or ({b" ".join(ws)} if ws else set())


def plain(rows, size=2, percent=80):
    """Sorted (doc_id, n_shingles, component_id, kept) of rows (doc_id, text), by all pairs."""
    sets = [grams(t, size) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        met = {}
        for g in s:
            for j in index.setdefault(g, []):
                met[j] = met.get(j, 0) + 1
            index[g].append(i)
        for j, same in met.items():
            if 100 * same >= percent * (len(s) + len(sets[j]) - same):
                up[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    out = [(doc_id, len(sets[i]), least.get(top(i))) for i, (doc_id, _) in enumerate(rows)]
    return sorted(((a, n, c, a == c) for a, n, c in out), key=str)


def result(df):
    return sorted(((r.id, r.n, r.component_id, r.id == r.component_id) for r in df.collect()), key=str)


def changed(text, rng, words):
    ws = text.split()
    for _ in range(words):
        ws[rng.randrange(len(ws))] = f"z{rng.randrange(10**9)}"
    return " ".join(ws)


def family(n, seed=1, words=120):
    """Texts of one base, some so near that they are linked, some not."""
    rng = random.Random(seed)
    base = prose(seed, words)
    return [changed(base, rng, rng.randrange(14)) for _ in range(n)]


def test_sets_sketches_and_estimates():
    assert [len(shingles(t)) for t in ("", " \n", "a", "a b", "a b a b", "A b", "É b")] == [0, 0, 1, 1, 2, 1, 1]
    assert (shingles("A b c") == shingles("a B\tC")).all() and (shingles("É b") != shingles("é b")).all()
    a = shingles(prose(1, 500))
    assert (unpacked(packed(a)) == a >> np.uint64(16)).all()
    b = shingles(prose(1, 400) + " " + prose(2, 100))
    truth = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs(estimate(a, b) - truth) < 0.2 and estimate(a, a) == 1.0
    assert estimate(a, b, 10**6) == truth and estimate(a[:K], b[:K]) == estimate(a, b)


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op11_bottom_k(spark, DATA).collect()), key=str) == plain(rows)


def test_odd_rows(spark):
    texts = [*ODD, (2**60 + 1, prose(1, 80)), (2**60 + 3, prose(1, 80) + " more"), (None, prose(1, 80)), (None, prose(2, 90)), (3, "same row of words"), "x y " * 200_000, "One", "ONE"]
    docs = documents(spark, texts).withColumns({c: F.lit(1) for c in ("v", "t", "root", "id", "component_id")})
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert result(near_duplicates(docs)) == plain(rows)
    assert near_duplicates(docs.limit(0)).count() == 0 and drop(docs.limit(0)).count() == 0
    left = drop(docs)
    assert left.columns == docs.columns
    named = docs.withColumn("doc_id", F.concat(F.lit("n"), F.col("doc_id").cast("string")))
    assert near_duplicates(named).count() == docs.count()


@pytest.mark.parametrize("lists, side", [(32, 256), (4, 16), (0.01, 5)])
def test_families_lose_no_link(spark, monkeypatch, lists, side):
    """Long lists and many blocks, with one family in which most pairs are linked and others in which few are."""
    monkeypatch.setattr(bottom_k, "LIST", lists)
    if lists < 1:
        monkeypatch.setattr(bottom_k, "_COMPARED", 0)
    monkeypatch.setattr(bottom_k, "SIDE", side)
    rng = random.Random(2)
    base = prose(7, 150, 4000)
    loose = [changed(base, rng, 9) for _ in range(60)]  # alike by about 0.78
    pairs = [changed(t, rng, 2) for t in loose[:30]]
    inserted = [" ".join([*base.split()[:k], *(f"in{j}" for j in range(k, k + 12)), *base.split()[k:]]) for k in range(0, 60, 3)]
    texts = [*family(80), *loose, *inserted, *pairs, *(prose(100 + i, 60, 50) for i in range(40)), *(base + " " + prose(200 + i, 160) for i in range(40))]
    rows = list(enumerate(texts))
    want = plain(rows)
    assert result(near_duplicates(documents(spark, texts))) == want
    assert 20 < len({c for _, _, c, _ in want}) < len(texts)


def test_the_last_values_of_a_node_are_not_early(spark):
    """The first value that a pair has in common has all others behind it, so a long list needs no node whose last values it holds."""
    rows = bottom_k.signed(documents(spark, family(60)), "doc_id", "text")
    listed = bottom_k._listed(rows.select("v", "n", "sketch").distinct())
    held = listed.groupBy("v").agg(F.count_if(~F.col("early")).alias("late"), F.max("least").alias("least"), F.count("*").alias("n")).collect()
    assert {r.least for r in held} == {4} and all(r.late == min(3, r.n) for r in held)


def test_a_set_far_from_its_hubs_is_told_once(spark):
    """A node gets one row of its values, not one for each hub that it has little in common with; the bound is one that no link crosses."""
    sets = {0: range(1, 201), 1: range(9, 209), 2: range(1, 61), 3: range(61, 141), 4: range(141, 221), 5: [*range(1, 190), *range(900, 911)]}
    frame = spark.createDataFrame([(v + 10, bytearray(packed(np.array([*g], np.uint64) << np.uint64(16)))) for v, g in sets.items()], "v long, grams binary")
    members = spark.createDataFrame([(h + 10, v + 10, v) for v in (0, 1) for h in (2, 3, 4, 5)], "h long, v long, c long")
    rows = bottom_k._differences(members, frame, 80).collect()
    assert sorted((r.h, r.v, len(r.d)) for r in rows) == [(0, 10, 200), (0, 11, 200), (15, 10, 22), (15, 11, 38)]
    assert all(set(r.d) == set(sets[r.v - 10]) and (r.need, r.reach, r.far) == (160, 160, True) for r in rows if r.h == 0)


def test_texts_of_several_templates_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(bottom_k, "LIST", 4)
    rng = random.Random(4)
    templates = [prose(300 + i, 60, 5000) for i in range(5)]
    texts = [" ".join([*rng.sample(templates, 2), prose(400 + i, rng.choice([5, 20, 60, 120]), 5000)]) for i in range(70)]
    texts += [changed(t, rng, rng.randrange(1, 14)) for t in texts[:50]]
    texts += [" ".join(t.split()[rng.randrange(30) :]) for t in texts[:30]]
    told = []
    monkeypatch.setattr(bottom_k, "_differences", lambda *a, f=bottom_k._differences: told.append(f(*a)) or told[-1])
    rows = list(enumerate(texts))
    assert result(near_duplicates(documents(spark, texts))) == plain(rows)
    seen = [(r.h, r.v) for r in told[0].collect()]
    assert len(seen) == len(set(seen)) and {h == 0 for h, _ in seen} == {True, False}


def test_five_words_and_other_likeness(spark):
    texts = family(40, 5, 200)
    docs = documents(spark, texts)
    for size, percent in ((5, 80), (2, 95), (1, 90)):
        assert result(near_duplicates(docs, size=size, percent=percent)) == plain(list(enumerate(texts)), size, percent)
    with pytest.raises(ValueError):
        near_duplicates(docs, percent=50).count()
