"""Merkle dataset manifest in a van Emde Boas layout.

Every row of a table is a leaf, every language a tree, and the trees' roots the leaves of one more tree. Each node is the
SHA-256 of up to FAN nodes below it.

A tree of some height is cut at half of it: into a top and, below each leaf of the top, a bottom whose root that leaf is.
Cut again and again, this puts a node's children side by side wherever the blocks of a store begin and end:
`address` is the place of a node by that rule alone, without pointers, whatever the height. A subtree of ROW_HEIGHT or less,
which the same cuts give, is one row of the manifest with its digests in that order, so that rows sorted by their first
address are the whole layout.

Construction goes up by the rows' heights: leaves are dealt to their lowest subtrees, a task builds each (at most FAN **
ROW_HEIGHT digests) bottoms first, and the rows' roots are the leaves of the next heights. Proofs go down: a row gets the
siblings that lie above its root, once for all its leaves, and each leaf adds those of its own row, a slice for each level.

Shuffles: the digests, twice to number the leaves of each tree by ranges of (tree, order), and once each up and down; texts are hashed
where they are read. A large tree spreads over as many tasks as it has rows.

Cases: a null in any column is hashed as such and differs from an empty text; null ids are the first leaves of their tree and are not
tampered with; leaves of equal id follow each other by their digests, and repeated rows are leaves each; a null
language is a tree by itself, before all others; a very long text is hashed in one piece; a tree of one leaf has it as its root; an
empty table gives an empty result; other input columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curves.functions.joins import sized
from curves.functions.places import numbered
from curves.llm.common import quoted, stored, table

FAN, ROW_HEIGHT = 8, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Heights that a tree of longs may have.
_HEIGHTS = 22
_SIZE = 32


def spans(height: int, row: int = ROW_HEIGHT) -> list[int]:
    """Heights of the rows on the way from a leaf to the root, lowest first."""
    if height <= row:
        return [height] if height else []
    return spans(height - height // 2, row) + spans(height // 2, row)


def cells(height: int) -> int:
    """Nodes below the root of a full tree."""
    return (FAN ** (height + 1) - FAN) // (FAN - 1)


def address(height: int, depth: int, index: int) -> int:
    """Place of a node at a depth, 1 or more, of a full tree."""
    if height == 1:
        return index
    top = height // 2
    if depth <= top:
        return address(top, depth, index)
    below, bottom = FAN ** (depth - top), height - top
    return cells(top) + index // below * cells(bottom) + address(bottom, depth - top, index % below)


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Subtree:
    """The nodes below a root, over some leaves' digests in hex; missing ones have no digest."""

    def __init__(self, height: int, store: bytes):
        self.height, self.store = height, store

    @classmethod
    def build(cls, height: int, leaves: list[str]) -> tuple[Subtree, str]:
        """The subtree of the leaves, and its root."""
        store = bytearray(cells(height) * _SIZE)
        root = cls._fill(store, 0, height, leaves)[0]
        last = max(address(height, d, -(-len(leaves) // FAN ** (height - d)) - 1) for d in range(1, height + 1))
        return cls(height, bytes(store[: (last + 1) * _SIZE])), root

    @classmethod
    def _fill(cls, store: bytearray, base: int, height: int, leaves: list[str]) -> list[str]:
        """Put a subtree's digests at base; returns its root as a list of one."""
        if height == 1:
            store[base * _SIZE : (base + len(leaves)) * _SIZE] = bytes.fromhex("".join(leaves))
            return [digest(*leaves)]
        top, bottom = height // 2, height - height // 2
        width, first = FAN**bottom, base + cells(top)
        roots = [cls._fill(store, first + k * cells(bottom), bottom, leaves[k * width : (k + 1) * width])[0] for k in range(-(-len(leaves) // width))]
        return cls._fill(store, base, top, roots)

    def siblings(self, depth: int, index: int, count: int) -> tuple[str, str]:
        """Digests before and after a node among its parent's children; count: the nodes at that depth."""
        first = index - index % FAN
        at = address(self.height, depth, first) * _SIZE
        own = at + index % FAN * _SIZE
        return self.store[at:own].hex(), self.store[own + _SIZE : at + min(FAN, count - first) * _SIZE].hex()

    def paths(self, leaves: int) -> list[tuple[list[str], list[str]]]:
        """For each leaf the siblings before and after, level by level from the lowest."""
        known = [([], [])]
        for depth in range(1, self.height + 1):
            n = -(-leaves // FAN ** (self.height - depth))
            sides = [self.siblings(depth, i, n) for i in range(n)]
            known = [([a, *known[i // FAN][0]], [b, *known[i // FAN][1]]) for i, (a, b) in enumerate(sides)]
        return known


def fold(leaf: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf and its siblings give."""
    return reduce(lambda node, sides: digest(sides[0], node, sides[1]), zip(lefts, rights, strict=True), leaf)


def leaf(columns: list[Column]) -> Column:
    """A row's digest, of a mark or the length and value of each column."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


_ROW = "tree string, height int, below int, span int, block long, at long, leaves int, cells binary, digest string"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _height(n: Column) -> Column:
    """Levels above n leaves."""
    return reduce(lambda a, b: a + b, [(n > F.lit(FAN**k)).cast("int") for k in range(_HEIGHTS - 1)])


def _span(height: Column, turn: int, row: int) -> Column:
    """The height of the rows of a turn, null in trees that have fewer."""
    every = [spans(h, row) for h in range(_HEIGHTS)]
    return F.element_at(F.array(*[F.lit(s[turn] if turn < len(s) else None).cast("int") for s in every]), height + 1)


def _built(items: DataFrame) -> DataFrame:
    """Rows (tree, height, below, span, block, at, leaves, cells, digest) over items (tree, height, below, span, block, i, digest)."""

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree, height, below, span, block = key
        own, root = Subtree.build(int(span), pdf.sort_values("i")["digest"].tolist())
        at = address(int(height), int(height - below - span) + 1, int(block) * FAN)
        return _frame([(tree, height, below, span, block, at, len(pdf), own.store, root)], _ROW)

    return items.groupBy("tree", "height", "below", "span", "block").applyInPandas(build, _ROW)


def _shares(items: DataFrame, turn: int, row: int) -> DataFrame:
    """items (tree, height, below, i) of the trees that have rows in this turn, with their span and block."""
    here = items.withColumn("span", _span(F.col("height"), turn, row)).filter("span is not null")
    width = F.element_at(F.array(*[F.lit(FAN**k).cast("long") for k in range(1, row + 1)]), F.col("span"))
    return here.withColumn("block", F.floor(F.col("i") / width).cast("long"))


def build(items: DataFrame, row: int = ROW_HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """The written rows of each turn, lowest first, and (tree, digest), the root of each tree. items: (tree, height, i, digest)."""
    most = items.agg(F.max("height")).first()[0] or 0
    turns, at = [], items.withColumn("below", F.lit(0))
    roots = [at.filter("height = 0").select("tree", "digest")]
    for turn in range(len(spans(most, row))):
        rows = stored(_built(_shares(at, turn, row)))
        turns.append(rows)
        roots.append(rows.filter("below + span = height").select("tree", "digest"))
        at = rows.filter("below + span < height").select("tree", "height", F.col("block").alias("i"), "digest", (F.col("below") + F.col("span")).alias("below"))
    return turns, reduce(DataFrame.unionByName, roots)


_SIDES = "lefts array<string>, rights array<string>"


def _climbed(items: DataFrame, rows: DataFrame, turn: int, row: int, each, schema: str) -> DataFrame:
    """each(item, lefts, rights) for every item, below rows (tree, block, leaves, cells, span, lefts, rights)."""

    def climb(items: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for own in rows.itertuples():  # one
            paths = Subtree(own.span, own.cells).paths(own.leaves)
            above = list(own.lefts), list(own.rights)
            for item in items.itertuples():
                lefts, rights = paths[item.i - own.block * FAN**own.span]
                out.append(each(item, [*lefts, *above[0]], [*rights, *above[1]]))
        return _frame(out, schema)

    left, right = _shares(items, turn, row).groupBy("tree", "block"), rows.groupBy("tree", "block")
    return left.cogroup(right).applyInPandas(climb, schema)


def proofs(items: DataFrame, turns: list[DataFrame], above: DataFrame, each, schema: str, row: int = ROW_HEIGHT) -> DataFrame:
    """each(item, lefts, rights) for every item (tree, height, i ..), with its siblings up to the roots that `above`
    (tree, lefts, rights) starts from."""
    paths = None
    for turn in reversed(range(len(turns))):
        rows = turns[turn]
        last = rows.filter("below + span = height").join(above.hint("merge"), "tree")
        if paths is not None:
            inner = rows.filter("below + span < height").join(paths.withColumnRenamed("i", "block").hint("merge"), ["tree", "block"])
            last = last.unionByName(inner)
        under = items if turn == 0 else turns[turn - 1].filter("below + span < height").select("tree", "height", F.col("block").alias("i"))
        if turn:
            paths = stored(_climbed(under, last, turn, row, lambda item, a, b: (item.tree, item.i, a, b), f"tree string, i long, {_SIDES}"))
        else:
            return _climbed(under, last, turn, row, each, schema)
    return items.sparkSession.createDataFrame([], schema)


def tree(lang: Column) -> Column:
    """A key that is never null and orders as languages do, null first."""
    return F.coalesce(F.concat(F.lit("="), lang), F.lit("-"))


class Manifest:
    """The trees of a table: its leaves with their places, the rows of all subtrees, the trees' roots, and the root."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", tree_col: str = "lang", columns: tuple[str, ...] = COLUMNS, more: dict[str, Column] | None = None, row: int = ROW_HEIGHT):
        """more: further columns to keep with each leaf."""
        self.row, more = row, more or {}
        made = stored(docs.select(tree(quoted(tree_col)).alias("tree"), quoted(id_col).alias("id"), leaf([quoted(c) for c in columns]).alias("digest"), *[c.alias(k) for k, c in more.items()]))
        placed = numbered(made, [F.col("id").asc_nulls_first(), F.col("digest").asc()], ["tree"], "i")
        self.leaves = stored(placed.withColumns({"id": F.col("id").cast("string"), "height": _height(F.col("n"))}).drop("n"))
        self.turns, roots = build(self.leaves, row)
        self.roots = stored(roots)
        tops = numbered(self.roots.withColumn("key", F.col("tree")), [F.col("key").asc()], None, "i")
        self.tops = stored(tops.select(F.lit("").alias("tree"), _height(F.col("n")).alias("height"), "i", "digest", "key"))
        self.top_turns, root = build(self.tops, row)
        found = root.first()
        self.root = found["digest"] if found else None

    def rows(self) -> DataFrame:
        """The stored manifest, (tree, height, below, span, block, at, leaves, cells, digest); in order of `at`, a tree's
        rows are its layout."""
        empty = self.leaves.sparkSession.createDataFrame([], _ROW)
        return reduce(DataFrame.unionByName, [*self.turns, *self.top_turns], empty)

    def proofs(self, each, schema: str) -> DataFrame:
        """each(leaf, lefts, rights) for every leaf, siblings level by level up to the root."""
        empty = F.array().cast("array<string>")
        start = self.tops.select("tree").limit(1).withColumns({"lefts": empty, "rights": empty})
        only = self.tops.filter("height = 0").select(F.col("key").alias("tree"), empty.alias("lefts"), empty.alias("rights"))
        several = proofs(self.tops, self.top_turns, start, lambda item, a, b: (item.key, a, b), f"tree string, {_SIDES}", self.row)
        above = stored(only.unionByName(several))

        def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield _frame([each(item, list(item.lefts), list(item.rights)) for item in pdf.itertuples()], schema)

        single = self.leaves.filter("height = 0").join(above.hint("merge"), "tree").mapInPandas(alone, schema)
        return single.unionByName(proofs(self.leaves.filter("height > 0"), self.turns, above, each, schema, self.row))


def verify(docs: DataFrame, changed: Column, id_col: str = "doc_id", tree_col: str = "lang", columns: tuple[str, ...] = COLUMNS, row: int = ROW_HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row. changed: the digest of what is held
    against the manifest in a row's place, null for the row itself."""
    made = Manifest(docs, id_col, tree_col, columns, {"held": changed}, row)

    def each(item, lefts: list[str], rights: list[str]) -> tuple:
        own = item.digest if item.held is None else item.held
        return item.id, item.tree, item.digest, digest(*chain.from_iterable(zip(lefts, rights, strict=True))), fold(own, lefts, rights)

    found = made.proofs(each, "doc_id string, tree string, leaf string, proof_sha256 string, folded_root string")
    root = F.lit(made.root).cast("string")
    return found.join(sized(made.roots.withColumnRenamed("digest", "subroot")), "tree").select(
        F.col("doc_id").cast(docs.select(quoted(id_col)).schema[0].dataType), "leaf", "subroot", root.alias("root"),
        "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"),
    )


def op13_merkle(spark, sf_dir):
    """Proofs of all documents; a third of them, by id, are held against the manifest with their text in lower case."""
    docs = table(spark, sf_dir, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    lowered = [F.translate("text", upper, lower) if c == "text" else quoted(c) for c in COLUMNS]
    third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return verify(docs, F.when(third, leaf(lowered)))


#: Levels of the SQL: enough for 8 ** 7 rows.
_LEVELS = 7


def crc_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, bit by bit."""
    byte = f"list_transform(range(length(hex(encode({text}))) // 2), lambda k: ('0x' || substr(hex(encode({text})), (2 * k + 1)::BIGINT, 2))::BIGINT)"
    step = "lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {byte}), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), {step})), 4294967295)"


def _leaf_sql(text: str) -> str:
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    return "sha256(" + " || ".join(field(text if c == "text" else c) for c in COLUMNS) + ")"


def _up_sql(name: str, k: int) -> str:
    """A level of trees: nodes with their children in order; a tree of one node keeps it."""
    return f"""
{name}{k + 1} AS (SELECT tree, i // {FAN} AS i, list(d ORDER BY i) AS kids, any_value(n) > 1 AS more,
        CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY i)) ELSE any_value(d) END AS d, (any_value(n) + {FAN - 1}) // {FAN} AS n
    FROM {name}{k} GROUP BY tree, i // {FAN})"""


def _climb_sql(name: str, source: str, k: int) -> str:
    """Each row's siblings of a level added to its proof, and its fold taken one level up."""
    left, right = f"array_to_string(kids[1:place % {FAN}], '')", f"array_to_string(kids[place % {FAN} + 2:], '')"
    return f"""
{name}{k + 1} AS (SELECT p.* REPLACE (place // {FAN} AS place, CASE WHEN more THEN proof || {left} || {right} ELSE proof END AS proof,
        CASE WHEN more THEN sha256({left} || fold || {right}) ELSE fold END AS fold)
    FROM {name}{k} p JOIN {source}{k + 1} t ON t.tree = p.{"tree" if name == "p" else "top"} AND t.i = p.place // {FAN})"""


_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""
WITH l AS (SELECT *, {_leaf_sql("text")} AS d, CASE WHEN {crc_sql("doc_id::VARCHAR")} % 3 = 0 THEN {_leaf_sql(_LOW)} END AS held, coalesce('=' || lang, '-') AS tree FROM documents),
n0 AS (SELECT doc_id, tree, d, held, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM l),
{",".join(_up_sql("n", k) for k in range(_LEVELS))},
t0 AS (SELECT '' AS tree, tree AS own, d, row_number() OVER (ORDER BY encode(tree)) - 1 AS i, count(*) OVER () AS n FROM n{_LEVELS}),
{",".join(_up_sql("t", k) for k in range(_LEVELS))},
p0 AS (SELECT doc_id, tree, d AS leaf, i AS place, '' AS proof, coalesce(held, d) AS fold FROM n0),
{",".join(_climb_sql("p", "n", k) for k in range(_LEVELS))},
q0 AS (SELECT p.* REPLACE (t0.i AS place), '' AS top, t0.d AS subroot FROM p{_LEVELS} p JOIN t0 ON t0.own = p.tree),
{",".join(_climb_sql("q", "t", k) for k in range(_LEVELS))}
SELECT doc_id, leaf, subroot, t.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = t.d AS verified FROM q{_LEVELS}, t{_LEVELS} t
"""
