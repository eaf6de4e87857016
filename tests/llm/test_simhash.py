"""SimHash fingerprints, links and components against brute force."""

from __future__ import annotations

import random

import xxhash

from curves.llm import components as linked
from curves.llm import simhash
from tests.llm.data import ODD, documents, prose


def plain(text):
    ws = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).split(" ")
    ws = [w for w in ws if w]
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(prints):
    """Least index reachable, by all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints():
    for t in ("", "A", "a b", "The cat SAT on É the mat", prose(1, 500)):
        assert simhash.fingerprint(t) % 2**64 == plain(t)


def _links(spark, prints, **options):
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "f bigint")
    back = {s: i for i, s in enumerate(signed)}
    got = {back[r.node]: r.root for r in linked.components(simhash.links(df, **options)).collect()}
    groups = {}
    for i in range(len(prints)):
        groups.setdefault(got.get(i, signed[i]), set()).add(i)  # a root is not among the nodes
    return sorted(map(sorted, groups.values()))


def _wanted(prints):
    groups = {}
    for i, r in enumerate(components(prints)):
        groups.setdefault(r, set()).add(i)
    return sorted(map(sorted, groups.values()))


def test_links_by_tables_and_by_balls(spark):
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):  # chains of near fingerprints, and some just too far
        for _ in range(3):
            q = p
            for _ in range(rng.choice([1, 2, 2, 3])):
                q ^= 1 << rng.randrange(64)
            prints.add(q)
            p = q
    crowd = rng.getrandbits(64)
    prints |= {crowd ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32)) for _ in range(60)}
    prints = sorted(prints)
    want = _wanted(prints)
    assert _links(spark, prints) == want
    assert _links(spark, prints, bucket=3) == want
    assert _links(spark, prints, bucket=0) == want


def test_near_duplicates_and_odd_rows(spark):
    long = prose(9, 3000)
    texts = [*ODD, long, long + " end", long.upper(), prose(10, 3000)]
    docs = documents(spark, texts)
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(texts)
    by = {}
    for r in found:
        by.setdefault(r["f"], set()).add(r.component_id)
    assert all(len(v) == 1 for v in by.values())
    n = len(ODD)
    ids = {r.id: r.component_id for r in found if r.id is not None}
    assert ids[n] == ids[n + 1] == ids[n + 2] == n and ids[n + 3] == n + 3
    assert ids[0] == ids[1] == ids[2] == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert {n, n + 3} <= {r.doc_id for r in kept.collect()} and n + 1 not in {r.doc_id for r in kept.collect()}
    assert len([r for r in kept.collect() if r.doc_id == 7]) == 2  # equal rows are one document
    assert len([r for r in kept.collect() if r.doc_id is None]) == 1  # the empty one without an id has a twin with one
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_a_very_long_text_is_read_whole(spark):
    long = prose(1, 200_000, 90_000)
    changed = " ".join(f"x{w}" for w in long.split()[100_000:])
    docs = documents(spark, [long, f"{long} end", long[: len(long) // 2] + " " + changed, None])
    got = {r.id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert got[0] == got[1] == 0 and got[2] == 2 and got[3] == 3
    assert simhash.fingerprint(long) == simhash.fingerprint(long.upper())
