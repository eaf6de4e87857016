"""The Merkle manifest against a plain construction."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from curves.llm import merkle
from curves.llm.merkle import FAN, Manifest, Subtree, address, cells, spans, verify
from tests.compare import DATA, connection
from tests.llm.data import ODD, documents


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def climb(nodes):
    """The levels from the leaves to the one node that remains."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i - i % 8 : i - i % 8 + 8]
        out.append((run[: i % 8], run[i % 8 + 1 :]))
        i //= 8
    return out


def low(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> the contract's rows, as a sorted list."""
    made = [(lang, i, h(*map(field, (i, s, lang, n, t))), h(*map(field, (i, s, lang, n, low(t))))) for i, s, lang, n, t in rows]
    langs = sorted({r[0] for r in made}, key=lambda x: b"" if x is None else b"=" + x.encode())
    trees = {x: sorted((r for r in made if r[0] == x), key=lambda r: (r[1] is not None, r[1] or 0, r[2])) for x in langs}
    levels = {x: climb([r[2] for r in trees[x]]) for x in langs}
    top, out = climb([levels[x][-1][0] for x in langs]), []
    for k, x in enumerate(langs):
        for i, (_, doc_id, leaf, lowered) in enumerate(trees[x]):
            path = siblings(levels[x], i) + siblings(top, k)
            fold = lowered if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0 else leaf
            for a, b in path:
                fold = h(*a, fold, *b)
            proof = h(*[d for a, b in path for d in (*a, *b)])
            out.append((doc_id, leaf, levels[x][-1][0], top[-1][0], proof, fold, fold == top[-1][0]))
    return sorted(out, key=str)


def run(docs, row=merkle.ROW_HEIGHT):
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = [F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz") if c == "text" else F.col(c) for c in merkle.COLUMNS]
    return sorted((tuple(r) for r in verify(docs, F.when(third, merkle.leaf(lowered)), row=row).collect()), key=str)


@pytest.mark.parametrize("height", [1, 2, 3, 4, 5])
def test_addresses_are_a_layout(height):
    every = [address(height, d, i) for d in range(1, height + 1) for i in range(FAN**d)]
    assert sorted(every) == list(range(cells(height)))
    runs = [[address(height, d, i + k) for k in range(FAN)] for d in range(1, height + 1) for i in range(0, FAN**d, FAN)]
    assert all(run == list(range(run[0], run[0] + FAN)) for run in runs)  # children lie side by side


@pytest.mark.parametrize("height, row", [(1, 4), (5, 4), (7, 2), (13, 4), (21, 4), (6, 1)])
def test_rows_are_subtrees_of_the_layout(height, row):
    heights = spans(height, row)
    assert sum(heights) == height and max(heights) <= row
    below = 0
    for span in heights:
        depth = height - below - span
        if depth < 5:
            for block in {0, 1, FAN**depth - 1} & set(range(FAN**depth)):
                base = address(height, depth + 1, block * FAN)
                assert all(address(height, depth + d, block * FAN**d + i) == base + address(span, d, i) for d in range(1, span + 1) for i in range(0, FAN**d, 3))
        below += span


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 511, 512])
def test_a_subtree_gives_back_its_siblings(n):
    leaves = [h(str(i)) for i in range(n)]
    built, root = Subtree.build(3, leaves)
    levels = [leaves]
    for _ in range(3):
        levels.append([h(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
    assert root == levels[-1][0]
    for i, (lefts, rights) in enumerate(built.paths(n)):
        assert merkle.fold(leaves[i], lefts, rights) == root
        assert list(zip(lefts, rights, strict=True)) == [("".join(a), "".join(b)) for a, b in siblings(levels, i)]


def test_query_equals_a_plain_construction(spark):
    rows = connection().sql("SELECT doc_id, source, lang, n_chars, text FROM documents").fetchall()
    assert sorted((tuple(r) for r in merkle.op13_merkle(spark, DATA).collect()), key=str) == plain(rows)


@pytest.mark.parametrize("row", [1, 4])
def test_trees_of_several_heights_and_odd_rows(spark, row):
    rng = random.Random(4)
    langs = [None, "", "en", "de", "é", "\U0001f600", *(f"x{i}" for i in range(9))]
    rows = [(rng.choice([None, i, i, 2**60 + i]), rng.choice([None, "S", "src"]), "en" if i < 600 else rng.choice(langs), rng.choice([None, i]), rng.choice([None, "", "A b", f"Ünï {i}", "x" * 3000])) for i in range(700)]
    rows += rows[:20] * 3 + [(7, "s", "alone", 1, "One leaf")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars bigint, text string").withColumns({c: F.lit(1) for c in ("tree", "i", "n", "digest", "held", "height")})
    assert run(docs, row) == plain(rows)


def test_odd_texts_one_row_and_none(spark):
    docs = documents(spark, [*ODD, "LONG text " * 100_000])
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    assert run(docs) == plain(rows)
    for one in (docs.limit(1), docs.limit(0)):
        assert run(one) == plain([(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in one.collect()])
    assert Manifest(docs.limit(0)).rows().count() == 0 and Manifest(docs.limit(0)).root is None


def test_string_ids_and_any_change_is_found(spark):
    docs = documents(spark, ["a", "b", "c d"] * 40).withColumn("doc_id", F.concat(F.lit("id"), F.col("doc_id").cast("string")))
    out = verify(docs, F.when(F.col("doc_id") == "id5", F.sha2(F.lit("else"), 256)))
    assert out.schema["doc_id"].dataType.simpleString() == "string"
    assert [r.doc_id for r in out.collect() if not r.verified] == ["id5"]


def test_rows_in_order_are_the_layout_of_the_whole_tree(spark):
    made = Manifest(documents(spark, [str(i) for i in range(600)]), row=2)
    rows = made.rows().filter("tree = '=en'").orderBy("at").collect()
    assert [r.span for r in rows if r.below == 0][:1] == [2] and rows[0].at == 0 and rows[0].height == 4
    whole = b"".join(bytes(r.cells) + b"\0" * (32 * cells(r.span) - len(r.cells)) for r in rows)
    leaves = [r.digest for r in made.leaves.orderBy("i").collect()]
    assert [whole[32 * address(4, 4, i) :][:32].hex() for i in range(600)] == leaves
