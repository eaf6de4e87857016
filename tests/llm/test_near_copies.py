"""Near copies against all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
from curves.llm import near_copies, simhash
from tests.llm.data import ODD, documents, prose


def likeness(a, b):
    x, y = ({tuple(ws[i : i + 5]) for i in range(max(len(ws) - 4, 1))} for ws in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def edited(text, seed, n):
    """text with n words replaced."""
    ws, rng = text.split(), random.Random(seed)
    for i in rng.sample(range(len(ws)), n):
        ws[i] = f"new{seed}x{i}"
    return " ".join(ws)


def survivors(texts):
    """Least index of each component, by all pairs."""
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if likeness(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sorted(set(root))


def test_edited_copies_go(spark):
    texts = [prose(i, 150 + 40 * i, 5000) for i in range(12)]
    texts += [edited(texts[i % 12], i, k) for i in range(12) for k in (1, 2, 3, 12)]
    kept = corpus_pipeline.near_duplicates(spark, documents(spark, texts), "")
    want = survivors(texts)
    assert len(want) < len(texts) - 20
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_crowded_keys(spark, monkeypatch):
    base, own = prose(1, 300, 5000), [prose(100 + i, 60, 5000) for i in range(30)]
    texts = [f"{base} {x}" for x in own]  # a common passage, alike by about 0.7
    texts += [edited(t, i, 2) for i, t in enumerate(texts)]
    texts += [edited(prose(2, 300, 5000), i, 1) for i in range(60)]
    want = survivors(texts)
    monkeypatch.setattr(near_copies, "BUCKET", 4)
    kept = near_copies.drop_near_copies(documents(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_columns_with_clashing_names_stay(spark):
    docs = documents(spark, [prose(1, 80), prose(1, 80), prose(2, 80)]).selectExpr("*", "1 AS __i", "2 AS __h", "3 AS root", "4 AS v", "5 AS t", "6 AS i", "7 AS `x.y`")
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2]
    other = simhash.drop_near_duplicates(docs)
    assert other.columns == docs.columns and sorted(r.doc_id for r in other.collect()) == [0, 2]


def test_recall_of_edited_copies_by_the_share_of_words_changed(spark):
    """Pairs of likeness 0.8 or more are found though they differ in many SimHash bits."""
    texts, near = [prose(i, 400, 50_000) for i in range(40)], 0
    for i in range(40):
        texts.append(edited(texts[i], i, 1 + i % 12))
        near += likeness(texts[i], texts[-1]) >= 0.8
    apart = [(simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)) % 2**64 for a, b in zip(texts, texts[40:], strict=False)]
    kept = {r.doc_id for r in near_copies.drop_near_copies(documents(spark, texts)).collect()}
    assert kept == set(survivors(texts)) and len(kept) == 80 - near and near >= 25
    assert sum(x.bit_count() > 2 for x in apart) >= 20  # the multi-index alone would have left these


def test_odd_rows(spark):
    docs = documents(spark, ODD)
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len([r for r in rows if r.doc_id == 7]) == 2 and len([r for r in rows if r.doc_id == 0]) == 1
    assert near_copies.near_copies(docs).count() == len(ODD)
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


def test_a_very_long_text_is_read_whole(spark):
    long = prose(1, 100_000, 90_000)
    kept = near_copies.drop_near_copies(documents(spark, [long, edited(long, 1, 500), long[: len(long) // 2], prose(2, 50)]))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_huge_ids_beside_a_null_id(spark):
    docs = documents(spark, [(2**60 + 2 * i + 1, prose(i, 40)) for i in range(6)] + [(None, prose(9, 40))])
    for drop in (near_copies.drop_near_copies, simhash.drop_near_duplicates):
        assert sorted(str(r.doc_id) for r in drop(docs).collect()) == sorted(str(i) for i in [*(2**60 + 2 * i + 1 for i in range(6)), None])


def test_string_ids(spark):
    docs = documents(spark, [prose(1, 40), prose(1, 40), prose(2, 40)]).selectExpr("concat('n', doc_id) AS doc_id", "text")
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(docs).collect()) == ["n0", "n2"]


def test_near_pairs_in_a_family_just_below_the_likeness(spark):
    """Each text has a partner at 0.8 or more, in a family whose members are alike by less."""
    base, texts = prose(3, 400, 50_000), []
    for i in range(150):
        one = edited(base, i, 5)
        texts += [one, edited(one, 1000 + i, 3)]
    want = survivors(texts)
    assert sorted(r.doc_id for r in near_copies.drop_near_copies(documents(spark, texts)).collect()) == want
    assert len(want) <= 150
