"""Budgets, prefixes and bins against plain Python."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from curves.llm import mixing, packing
from tests.llm.data import ODD, documents, prose

PATH = ("domain", "lang", "source")


def fill(budget, children):
    """children: {name: (weight, cap)}; shares by weight, shortages to siblings, by repeated rounds."""
    open_, out, left = dict(children), {}, budget
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {n: c for n, (w, c) in open_.items() if c * total <= left * w}
        if not full:
            out |= {n: left * w // total for n, (w, c) in open_.items()}
            break
        for n, c in full.items():
            out[n] = c
            left -= c
            del open_[n]
    return out


def allot(leaves, weights, share, epochs):
    cap = lambda pre: sum(t * epochs for p, t in leaves.items() if p[: len(pre)] == pre)
    budgets = {(): min(cap(()), int(sum(leaves.values()) * share))}
    for i in range(3):
        for pre in [p for p in budgets if len(p) == i]:
            names = {p[: i + 1] for p in leaves if p[:i] == pre}
            got = fill(budgets[pre], {n: (weights[i].get(n[-1], 1), cap(n)) for n in names})
            budgets |= got
    return {p: budgets[p] for p in leaves}


def test_budgets_and_prefixes(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice("ab"), rng.choice(["en", "de"]), f"s{rng.choice([0, 0, 0, 1, 2])}", rng.randrange(0, 40)) for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, domain string, lang string, source string, tok bigint")
    weights, leaves = ({"a": 9}, {"en": 3}, {"s2": 5}), {}
    for _, *p, n in rows:
        leaves[tuple(p)] = leaves.get(tuple(p), 0) + n
    for share, epochs in ((0.5, 2), (0.9, 1), (1.7, 2), (3.0, 2)):
        want = {}
        for p, a in allot(leaves, weights, share, epochs).items():
            full, rest = divmod(a, leaves[p])
            key = lambda i, e=full + 1: int(hashlib.md5(f"17:{e}:{i}".encode()).hexdigest()[:15], 16)
            cum = 0
            for i, n in sorted(((r[0], r[4]) for r in rows if tuple(r[1:4]) == p), key=lambda r: key(r[0])):
                cum += n
                want[i] = full + (cum <= rest)
        got = mixing.copies(docs, tokens=F.col("tok"), weights=weights, share=share, epochs=epochs)
        assert {r.doc_id: r["__copies"] for r in got.collect()} == want


def test_shortage_stays_among_siblings():
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("b", "x", "1"): 1000}
    assert allot(leaves, ({}, {}, {}), 400 / 2010, 1) == {("a", "x", "1"): 10, ("a", "x", "2"): 190, ("b", "x", "1"): 200}


def test_mix_of_odd_rows(spark):
    docs = documents(spark, [*ODD, prose(1, 30)]).withColumn("domain", F.lit(None).cast("string"))
    out = mixing.copies(docs)
    assert out.columns == [*docs.columns, "__copies"] and out.count() == docs.count()
    twice = mixing.copies(docs.unionByName(docs))
    assert twice.count() == 2 * docs.count() == 2 * twice.select("doc_id", "text", "source", "__copies").distinct().count() + 2 * (docs.count() - docs.distinct().count())
    assert mixing.select(docs).columns == docs.columns
    assert mixing.copies(docs.limit(0)).count() == 0


def test_a_very_long_text_counts_with_all_its_words(spark):
    docs = documents(spark, ["w " * 300_000, *(prose(i, 10) for i in range(9))]).withColumn("domain", F.lit("dom0"))
    read = {r.doc_id: r["__copies"] for r in mixing.copies(docs, share=0.0005, epochs=1).collect()}
    assert read[0] == 0 and sum(read.values()) > 0  # its leaf's share ends before it


def test_clashing_names_of_the_mix(spark):
    docs = documents(spark, [prose(i, 30) for i in range(20)]).selectExpr("*", "'d' AS w", "'x' AS __full", "1 AS __thr", "2 AS __copies", "3 AS range", "4 AS `a.b`")
    out = mixing.select(docs, path=("w", "lang", "source"), share=0.5, epochs=1)
    assert out.columns == docs.columns and 0 < out.count() < 20
    assert mixing.copies(docs, path=("w", "lang", "source")).count() == 20


def plain_best_fit(lengths, capacities, floor, by=packing.cost):
    bins = []
    for i, n in enumerate(lengths):
        fits = [b for b in bins if b[0] >= n]
        if fits:
            best = min(fits, key=lambda b: b[0])
            left = best[0]
            best = [b for b in fits if b[0] == left]  # any of them: the bins differ in number only
            best = max(best, key=lambda b: b[2])
        else:
            best = [min((c for c in capacities if c >= max(n, floor)), key=by), [], 0]
            bins.append(best)
        best[1].append(i)
        best[0] -= n
        best[2] = i
    return [b[1] for b in bins]


def test_best_fit_equals_plain_version():
    rng = random.Random(1)
    for caps in ((8, 16, 32), (5, 50)):
        lengths = sorted((rng.randint(1, caps[-1]) for _ in range(200)), reverse=True)
        for floor in caps:
            for by in (packing.cost, packing.rate):
                assert packing.best_fit(lengths, caps, floor, by) == plain_best_fit(lengths, caps, floor, by)
        bins, sizes = packing.pack_items(lengths, caps)
        cost = sum(map(packing.cost, sizes))
        for floor, by in [(c, f) for c in caps for f in (packing.cost, packing.rate)]:
            other = [packing.downsized(sum(lengths[i] for i in b), caps) for b in plain_best_fit(lengths, caps, floor, by)]
            assert cost <= sum(map(packing.cost, other)) + 1e-9
        assert sorted(i for b in bins for i in b) == list(range(200))


def test_every_token_is_in_one_bin(spark):
    texts = [prose(i, n) for i, n in enumerate([0, 1, 5, 31, 32, 33, 100, 64, 7, 7])]
    out = packing.pack(documents(spark, texts), capacities=(32, 8, 16), docs_a_shard=4).collect()
    seen = set()
    for r in out:
        assert r.n_tokens == sum(r.lengths) <= r.capacity and r.capacity in (8, 16, 32)
        assert not any(c >= r.n_tokens and c < r.capacity for c in (8, 16, 32))
        for d, s, n in zip(r.doc_ids, r.starts, r.lengths, strict=True):
            seen |= {(d, k) for k in range(s, s + n)}
    assert sum(r.n_tokens for r in out) == len(seen) == sum(len(t.split()) for t in texts)
    assert len({r.bin_id for r in out}) == len(out)


def test_equal_rows_are_dealt_evenly(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 1000)
    docs = spark.range(60_000).selectExpr("7L AS doc_id", "'same words here' AS text")
    out = packing.pack(docs, docs_a_shard=2000)
    sizes = [r.n for r in out.groupBy(F.split("bin_id", "-")[0]).agg(F.sum(F.size("doc_ids")).alias("n")).collect()]
    assert sum(sizes) == 60_000 and len(sizes) == 30 and max(sizes) < 2400
    long = spark.range(50).selectExpr("7L AS doc_id", "repeat('w ', 40) AS text")
    bins = packing.pack(long, capacities=(8, 16)).collect()
    assert len({r.bin_id for r in bins}) == len(bins) and sum(r.n_tokens for r in bins) == 2000


def test_a_very_long_text_is_many_bins(spark):
    docs = documents(spark, ["w " * 100_000, None])
    out = packing.pack(docs).collect()
    assert sum(r.n_tokens for r in out) == 100_000 and sum(r.capacity == 8192 and r.n_tokens == 8192 for r in out) == 12


def test_packing_of_odd_rows(spark):
    docs = documents(spark, ODD)
    ids = [d for r in packing.pack(docs).collect() for d in r.doc_ids]
    assert sorted(map(str, ids)) == sorted(["3", "4", "7", "7", "None", "9"])
    assert packing.pack(docs, length=F.col("n")).count() > 0
    assert packing.pack(docs.limit(0)).count() == 0
