"""SimHash near-dedup at a likeness of 0.8 or more over five-word shingles: the pipeline's stage.

Edited copies at a Jaccard likeness of 0.8 differ in about 10 of 64 SimHash bits. Hamming balls that wide can't be
listed, and segments short enough to agree by chance hold a large corpus in a few buckets. So there are two sources of
pairs of nodes, which are distinct shingle sets:

* multi-index hashing as in simhash, over the fingerprints of the five-word shingles: nodes within its 2 bits
* for pairs beyond, the inverted lists of bottom_k, which lose no pair in long lists

A pair of either source is linked if its sets' Jaccard likeness is at least 0.8, so no two documents that differ more are
linked by chance bits.

Cases: null text counts as empty; texts without words are one component; a text of fewer than SHINGLE words is one shingle; null ids,
repeated ids, ties and repeated rows as in simhash; ids never pass through Python; a very long text is one row, hashed in
one piece; an empty table gives an empty result; other input columns don't matter and are returned as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curves.llm import bottom_k, simhash
from curves.llm.common import stored
from curves.llm.simhash import majority

SHINGLE, LIKE_PERCENT = 5, 80
#: Nodes of an inverted list up to which all of its pairs are listed.
BUCKET = 32


def print_pairs(nodes: DataFrame) -> DataFrame:
    """(u, v): pairs of nodes (v, f) within simhash's distance. Nodes of one fingerprint are paired with the least of
    them, and those of two linked fingerprints by their least."""
    prints = stored(nodes.groupBy("f").agg(F.min("v").alias("u")))
    same = nodes.join(prints.hint("merge"), "f").filter("u <> v").select("u", "v")
    of = lambda name: prints.select(F.col("f").alias(name), F.col("u").alias(f"{name}_node")).hint("merge")
    met = simhash.links(prints.select("f")).join(of("u"), "u").join(of("v"), "v").select(F.col("u_node").alias("u"), F.col("v_node").alias("v"))
    return same.unionByName(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, t, n, root, component_id) of every row of docs: its text's hash, the number of its shingles, the node that
    names its component, and the least id of it."""
    rows = bottom_k.signed(docs, id_col, text_col, SHINGLE, majority)
    nodes = stored(rows.filter("n > 0").groupBy("v").agg(F.first("f").alias("f")))
    edges = bottom_k.links(docs, rows, text_col, SHINGLE, LIKE_PERCENT, print_pairs(nodes), BUCKET)
    return bottom_k.grouped(rows, edges, empty_alike=True)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, as simhash.keep_least chooses it."""
    return simhash.keep_least(docs, near_copies(docs, id_col, text_col), id_col, text_col)
