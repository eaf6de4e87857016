"""SimHash near-dedup by multi-index hashing.

Fingerprints are computed batch by batch with numpy and xxhash; equal fingerprints are merged before any search.
A fingerprint is cut into two 32-bit segments. Two fingerprints at distance 2 or less agree within one bit in
the first segment or exactly in the second, so each probes the first segment's table with its Hamming ball of
radius 1 (33 keys) and the second's with its own value, and every match is verified on all 64 bits.

A table key with more than BUCKET members would pair them all. The fingerprints that are in such a bucket or probe
one list their full 64-bit ball of radius 1 instead: two fingerprints differ in at most 2 bits exactly if their
balls share a member, and a ball's member is shared by 65 fingerprints at most, so linking each to the least of
them keeps every component whole with at most 65 links for each fingerprint.

Cases: null text counts as empty; a text without words has fingerprint zero and is linked like any other; rows
with a null id get a fingerprint and the least non-null id of their component (null if there is none); repeated
rows give repeated rows; of tied documents of a component the one with the least text hash stays; a very long text is
one row, whose shingles' bits are counted in blocks; an empty table gives an empty result; other input columns don't
matter and are returned by `drop_near_duplicates` as they were.
"""

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from curves.llm.common import free, quoted, stored, table
from curves.llm.components import components

SHINGLE, DISTANCE, BUCKET = 3, 2, 64
#: Hashes whose bits are counted at a time.
_BLOCK = 1 << 15


def majority(hashes: np.ndarray) -> int:
    """Signed fingerprint of 64-bit hashes: bit i is set if it is in over half of them."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        part = hashes[at : at + _BLOCK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of the word shingles of a text, 0 without words."""
    ws = text.encode().lower().split()
    if not ws:
        return 0
    grams = ws if shingle == 1 else [b" ".join(g) for g in zip(*(ws[k:] for k in range(shingle)), strict=False)] or [b" ".join(ws)]
    return majority(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), np.uint64, len(grams)))


def fingerprints(text: Column) -> Column:
    """Column of fingerprints, made by a pandas UDF."""

    @F.pandas_udf(LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return of(text)


def _balls(width: int, radius: int) -> list[int]:
    """Masks of all changes to at most `radius` of `width` bits."""
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _segments(distance: int) -> list[tuple[int, int]]:
    """(shift, radius) of the two segments: radii r and distance - r - 1, so that one of them must match."""
    high = distance // 2
    return [(32, high), (0, distance - high - 1)]


def _keys(col: Column, shift: int, radius: int) -> Column:
    own = F.shiftrightunsigned(col, shift).bitwiseAND(F.lit((1 << 32) - 1))
    return F.transform(F.array(*[F.lit(m).cast("long") for m in _balls(32, radius)]), lambda m: own.bitwiseXOR(m))


def _table(prints: DataFrame, name: str, distance: int, probe: bool) -> DataFrame:
    """A row for each segment and key of a fingerprint: its own key, or those of its ball."""
    parts = [
        F.struct(F.lit(i).cast("byte").alias("seg"), _keys(F.col("f"), shift, radius if probe else min(radius, 0)).alias("keys"))
        for i, (shift, radius) in enumerate(_segments(distance))
        if radius >= 0
    ]
    rows = prints.select(F.col("f").alias(name), F.inline(F.array(*parts)))
    return rows.select(name, "seg", F.explode("keys").alias("key"))


def links(prints: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints f whose components are those of all pairs within `distance`,
    which is 2 at most."""
    if distance not in (1, 2):
        raise ValueError("distance is 1 or 2")
    slots, probes = _table(prints, "v", distance, False), _table(prints, "u", distance, True)
    full = stored(slots.groupBy("seg", "key").count().filter(F.col("count") > bucket).select("seg", "key"))
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance
    pairs = (
        slots.join(full.hint("merge"), ["seg", "key"], "left_anti")
        .hint("merge")
        .join(probes, ["seg", "key"])
        .filter((F.col("u") != F.col("v")) & near("u", "v"))
        .select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    )
    crowded = probes.join(full.hint("merge"), ["seg", "key"], "left_semi").select(F.col("u").alias("f")).distinct()
    masks = F.array(*[F.lit(_signed(m)) for m in _balls(64, 1)])
    balls = crowded.select("f", F.explode(F.transform(masks, lambda m: F.col("f").bitwiseXOR(m))).alias("near"))
    groups = balls.groupBy("near").agg(F.sort_array(F.collect_set("f")).alias("fs")).filter(F.size("fs") > 1)
    stars = groups.select(F.col("fs")[0].alias("u"), F.explode(F.slice("fs", 2, 64)).alias("v"))
    return pairs.unionByName(stars.filter(near("u", "v"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f, t, root, component_id) of every row of docs: its fingerprint, its text's hash, the least
    fingerprint of its component and the least id."""
    text = quoted(text_col)
    rows = stored(docs.select(quoted(id_col).alias("id"), fingerprints(F.coalesce(text, F.lit(""))).alias("f"), F.xxhash64(text).alias("t")))
    prints = stored(rows.groupBy("f").agg(F.min("id").alias("least")))
    roots = components(links(prints.select("f")))
    named = prints.join(roots.hint("merge"), F.col("f") == F.col("node"), "left").withColumn("root", F.coalesce("root", "f"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = stored(named.select("f", "root").join(least.hint("merge"), "root").select("f", "root", "component_id"))
    return rows.join(groups.hint("merge"), "f").select("id", "f", "t", "root", "component_id")


def keep_least(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component: the one with the least id, of several such the one with the least text hash.
    Rows equal in id and text count as one document, and stay together. found: id, t, root, component_id."""
    i, h = free(docs, "i", "h")
    best = found.filter(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("id").alias(i), F.min("t").alias(h))
    same = quoted(id_col).eqNullSafe(F.col(i)) & (F.xxhash64(quoted(text_col)) == F.col(h))
    return docs.join(best.select(i, h).distinct().hint("merge"), same, "left_semi")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, as keep_least chooses it."""
    return keep_least(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)


def op3_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")
