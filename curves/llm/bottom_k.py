"""Near-duplicates by bottom-k sketches: links are pairs whose sets of word shingles have a Jaccard likeness of 0.8 or more.

One hash function orders all shingles, and a set's sketch is its K least values. A node is a distinct set, so that exact
copies are one. Of two sketches the K least values of the union are a sample of the union of the sets, and the share of
them that is in both estimates the likeness. For a pair of likeness 0.8 that share is below LEAST with probability 4e-6 at most, and
never where both sets are known in full; so both sketches have many values in common (`in_common`).

* Inverted lists. Values are put in one order, by the number of nodes that retain them, rare ones first. Two sketches of s
  values with o in common share MATCHES of the first s - o + MATCHES in that order, so only those make lists, without the ones that
  nobody else has. What pairs have in common over the lists are their overlaps.
* Hubs. Each node is paired with the hub of the lists that it shares most of, the node of a list whose values most others
  retain too. So a group of many copies has as many pairs as nodes. What holds gives nodes their tops, the hubs of their hubs.
* The rest. Lists whose nodes have one top are done. Of the others, short ones (LIST nodes at most) pair their nodes
  of different tops, and pairs with MATCHES overlaps go on. Pairs that have all their values in long lists share the first of them, so
  each node is in the long lists without its MATCHES - 1 last values, the most common ones. There, sets are told apart by what sets them off from the
  hub: if a node isn't linked to the hub, a link of it to another node means that over half of the other's difference
  from the hub is in its own. So the rarer half of each node's difference makes new lists, which all values of the difference of the
  nodes that aren't linked to the hub look up; a family of texts that most shingles unite falls apart there. Nodes that differ from a hub by
  half of its size or more are told apart by their whole sets instead, once for all their hubs. Lists of such values that are still long are
  compared in blocks, at most SIDE against SIDE sets a task, which return a link for each node and component. Nothing is
  capped: a long list costs blocks in proportion to its nodes.
* Pairs are held against the estimate of their union's sketch, then against their full sets, which are made again from the
  texts of just these nodes.

Shuffles: two longs a retained value, to count it and to rank a node's; the distinct texts once. Tasks get partial counts before
the shuffle; joins on a hot value or node are plain exchanges that Spark can split.

Cases: a null, empty or wordless text has no set, is linked with nothing and is its own component; a text of fewer words
than a shingle is one shingle; rows with a null id get the least id of their component that isn't null (null if there is
none); ties and repeated rows are in one component; a very long text is one row, hashed in one piece; ids of any type that has an order
never pass through Python; an empty table gives an empty result; other input columns don't matter, and `drop` returns them as they were.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curves.llm.common import quoted, stored, table
from curves.llm.components import components

SHINGLE, LIKE_PERCENT = 2, 80
K, LEAST, MATCHES = 64, 0.55, 4
#: Standard deviations below its mean that a sample of a pair of likeness 0.8 may lie.
DEVIATIONS = 4.6
LIST, SIDE = 32, 256
#: Shingles of one side of a block, and common values compared at a time.
_BLOCK, _COLUMNS = 1 << 18, 1 << 12
#: Comparisons of two numbers that a join makes within a list, for each node of a short list.
_COMPARED = 1 << 15
#: Bytes of a hash in sets and sketches.
_BYTES = 6
_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_ODD[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_ODD[2])
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles, A-Z in lower case."""
    ws = text.encode().lower().split()
    if not ws:
        return np.empty(0, np.uint64)
    k = min(size, len(ws))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
    grams = np.full(len(ws) - k + 1, k, np.uint64)
    for i in range(k):
        grams = _mixed(grams * np.uint64(_ODD[0]) + hashes[i : len(ws) - k + 1 + i])
    return np.unique(grams)


def node(grams: np.ndarray) -> int:
    """The signed name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64))


def packed(grams: np.ndarray) -> bytes:
    """Sorted hashes, cut to their upper bytes."""
    return np.ascontiguousarray(grams.astype(">u8")).view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // _BYTES, 8), np.uint8)
    out[:, 8 - _BYTES :] = np.frombuffer(data, np.uint8).reshape(-1, _BYTES)
    return out.view(">u8").ravel().astype(np.uint64)


def estimate(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Jaccard likeness of two sets by the k least values of their union; exact if there are no more. a, b: sorted sets, or sketches of k values."""
    union = np.union1d(a[:k], b[:k])[:k]
    both = np.intersect1d(a[:k], b[:k], assume_unique=True)
    return np.searchsorted(both, union[-1], side="right") / len(union)


def alike(a: np.ndarray, b: np.ndarray, percent: int = LIKE_PERCENT) -> bool:
    """Whether two sorted sets have a likeness of `percent` hundredths."""
    if estimate(a, b) < LEAST:
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return same * 100 >= (len(a) + len(b) - same) * percent


def signed(docs: DataFrame, id_col: str, text_col: str, size: int = SHINGLE, of: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """Written rows (id, t, v, n, f, sketch): a text's hash, its node, the size of its set, what `of` makes of the set, and its
    least values."""

    @F.pandas_udf("struct<v:long,n:long,f:long,sketch:binary>")
    def sign(texts: pd.Series) -> pd.DataFrame:
        sets = [shingles(t, size) for t in texts]
        more = [of(s) if of and len(s) else 0 for s in sets]
        return pd.DataFrame({"v": [node(s) for s in sets], "n": [len(s) for s in sets], "f": more, "sketch": [packed(s[:K]) for s in sets]})

    text = quoted(text_col)
    rows = stored(docs.select(quoted(id_col).alias("id"), F.xxhash64(text).alias("t"), sign(F.coalesce(text, F.lit(""))).alias("s")))
    return rows.select("id", "t", "s.*")


def _retained(nodes: DataFrame) -> DataFrame:
    """(v, n, x): a row for each value of a sketch."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = np.array([len(b) // _BYTES for b in pdf["sketch"]], np.int64)
            yield pd.DataFrame({"v": np.repeat(pdf["v"].to_numpy(), sizes), "n": np.repeat(pdf["n"].to_numpy(), sizes), "x": unpacked(b"".join(pdf["sketch"])).astype(np.int64)})

    return nodes.select("v", "n", "sketch").mapInPandas(spread, "v long, n long, x long")


def in_common(n: Column) -> Column:
    """Values that a sketch of a set of n has in common with that of any set of likeness 0.8. If the union, 1.25 n at most, isn't
    longer than a sketch, all are known; else the K least of it are a sample, of which a share beyond 0.8 by more than DEVIATIONS is
    left to chance."""
    union = n / 0.8
    sampled = F.floor(F.lit(0.8 * K) - DEVIATIONS * F.sqrt(F.greatest(0.16 * K * (1 - K / union), F.lit(0.0))))
    return F.when(union <= K, F.ceil(n * 0.8)).otherwise(sampled).cast("int")


def _listed(nodes: DataFrame) -> DataFrame:
    """(x, v, least, w, early): the nodes in each inverted list. least: the overlaps that a pair of the node must have; w: how
    common its values are; early: whether x is early enough in the node's order to be the first value that a pair has in common."""
    values = _retained(nodes)
    common = stored(values.groupBy("x").agg(F.count("*").alias("df")).filter("df > 1"))
    shared = values.join(common.hint("merge"), "x")
    own = Window.partitionBy("v")
    need = in_common(F.col("n"))
    ranked = shared.withColumns({"k": F.row_number().over(own.orderBy("df", "x")), "m": F.count("*").over(own), "w": F.sum(F.floor(F.log2("df") * 16)).over(own), "least": F.least(need, F.lit(MATCHES))})
    # values that no other node has come first in the order
    at = F.col("k") - F.col("m")
    first = ranked.filter(at <= F.col("least") - need).select("x", "v", "least", "w", (at <= 1 - need).alias("early"))
    return stored(first)


def _hubs(listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists (x, n, h) of two or more nodes, h the hub, and (u, v), each node with the hub that it shares most lists with."""
    lists = stored(listed.groupBy("x").agg(F.count("*").alias("n"), F.max_by("v", F.struct("w", "v")).alias("h")).filter("n > 1"))
    met = listed.join(lists.hint("merge"), "x").filter("h <> v").groupBy("v", "h").agg(F.count("*").alias("same"), F.max("least").alias("least"))
    best = met.filter("same >= least").groupBy("v").agg(F.max_by("h", F.struct("same", "h")).alias("u"))
    return lists, stored(best.select("u", "v"))


def _tops(up: DataFrame) -> DataFrame:
    """(v, c): the hub of the hub of each node that is linked to its hub, or the hub if that has none; written. up: (u, v) with
    u the hub. A hub has commoner values than its nodes, so hubs of hubs make no circle. Nodes of one c are linked; those of different c may be, too."""
    of = lambda name: up.select(F.col("v").alias(name), F.col("u").alias(f"{name}_hub")).hint("merge")
    return stored(up.join(of("u"), "u", "left").select("v", F.coalesce("u_hub", "u").alias("c")))


def _open(listed: DataFrame, lists: DataFrame, tops: DataFrame, most: int) -> DataFrame:
    """(x, v, least, early, c, n, h, more): the lists whose nodes have several tops c, without nodes that are in too few of them. A node
    without a hub is its own top. more: the number of a node's lists with over `most` nodes."""
    named = listed.join(tops.hint("merge"), "v", "left").select("x", "v", "least", "early", F.coalesce("c", "v").alias("c"))
    named = stored(named.join(lists.hint("merge"), "x"))
    # the top of a list's hub serves as its hub, so that the lists of a family have one
    tops_of = named.groupBy("x").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.max(F.when(F.col("v") == F.col("h"), F.col("c"))).alias("top"))
    several = stored(tops_of.filter("lo < hi").select("x", "top"))
    own = Window.partitionBy("v")
    open_ = named.join(several.hint("merge"), "x").withColumn("h", F.col("top")).drop("top")
    counted = open_.withColumns({"more": F.count_if(F.col("n") > most).over(own), "held": F.count("*").over(own)})
    return stored(counted.filter("held >= least").drop("held"))


def _short(rows: DataFrame) -> DataFrame:
    """Pairs (u, v) of different tops of the short lists' rows with enough overlaps. Long lists don't count overlaps, so a pair
    may have all of its own in them."""
    own = rows.select("x", "v", "c", "least", "more")
    other = own.toDF("x", "u", "c_u", "least_u", "more_u")
    met = own.join(other.hint("merge"), "x").filter("u < v and c <> c_u").groupBy("u", "v").agg(
        F.count("*").alias("same"), F.max(F.least("least", "least_u")).alias("least"), F.max(F.least("more", "more_u")).alias("more")
    )
    return stored(met.filter("same + more >= least").select("u", "v"))


def _differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(h, v, c, d, n, need, reach, far), written: what sets the members (h, v, c), of n values, off from their hubs. need: how many of those values
    a node that isn't linked to the hub must share to be linked to v; reach: how many any node must; far: whether v isn't linked to the hub.

    Linked sets differ by (100 - percent) / (100 + percent) of their sizes' sum at most. So with a bound of half the hub's size, both nodes of a link
    are less that share of their own sizes beyond it (tight), or both are with it (loose). Nodes near the bound are both. A loose node has about a fifth
    of its values, as many as name it in its whole set, beside the hub's. It gets one row for all hubs that it is loose to, with h 0 and its set as d."""
    more, less = 100 + percent, 100 - percent

    @F.pandas_udf("struct<d:array<long>,n:long,need:long,reach:long,far:boolean,tight:boolean,loose:boolean>")
    def differ(hubs: pd.Series, owns: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(hubs, owns, strict=True):
            hub, own = unpacked(x), unpacked(y)
            d = np.setxor1d(hub, own, assume_unique=True)
            reach = max(len(d) - len(own) * less // percent, 1)
            need = max((len(d) * more + less * (len(hub) - len(own))) // (2 * more) + 1, reach)
            tight = 2 * (more * len(d) - less * len(own)) <= more * len(hub)
            loose = 2 * (more * len(d) + less * len(own)) > more * len(hub)
            out.append((d.astype(np.int64) if tight else [], len(own), need, reach, len(d) * more > less * (len(hub) + len(own)), tight, loose))
        return pd.DataFrame(out, columns=["d", "n", "need", "reach", "far", "tight", "loose"])

    @F.pandas_udf("array<long>")
    def whole(owns: pd.Series) -> pd.Series:
        return pd.Series([unpacked(x).astype(np.int64) for x in owns])

    of = lambda name: sets.select(F.col("v").alias(name), F.col("grams").alias(f"{name}_grams")).hint("merge")
    told = stored(members.join(of("h"), "h").join(of("v"), "v").select("h", "v", "c", differ("h_grams", "v_grams").alias("d")).select("h", "v", "c", "d.*"))
    tight = told.filter("tight").select("h", "v", "c", "d", "n", "need", "reach", "far")
    share = F.ceil(F.col("n") * percent / 100)
    loose = told.filter("loose").select("v", "c", "n").distinct().join(of("v"), "v")
    loose = loose.select(F.lit(0).cast("long").alias("h"), "v", "c", whole("v_grams").alias("d"), "n", share.alias("need"), share.alias("reach"), F.lit(True).alias("far"))
    return stored(tight.unionByName(loose))


def _long(rows: DataFrame, sets: DataFrame, percent: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (u, v) to verify, and links (u, v), of different tops of the long lists' rows (x, v, c, h)."""
    members = rows.filter("v <> h").select("h", "v", "c").distinct()
    told = _differences(members, sets, percent)
    parts = told.select("h", "v", "c", "n", "need", "reach", "far", F.size("d").alias("size"), F.explode("d").alias("token"))
    common = stored(parts.groupBy("h", "token").agg(F.count("*").alias("df"), F.max("far").alias("any")).filter("df > 1 and any"))
    shared = parts.join(common.select("h", "token", "df").hint("merge"), ["h", "token"])
    own = Window.partitionBy("h", "v")
    # a value's place in the order of its node, in which those that no other node has come first
    at = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "token"))
    rest = shared.withColumn("rest", F.col("size") - at)
    listed = rest.withColumns({"near": F.col("rest") >= F.col("need") - 1, "far": F.col("far") & (F.col("rest") >= F.col("reach") - 1)}).filter("near or far")
    listed = stored(listed.select(F.xxhash64("h", "token").alias("x"), "v", "c", "n", "size", "rest", "near", "far"))
    sizes = listed.groupBy("x").agg(F.count_if("near").alias("nears"), F.count_if("far").alias("fars"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    sizes = stored(sizes.filter("nears > 0 and fars > 0 and lo < hi").select("x", "nears", "fars"))
    named = stored(listed.join(sizes.hint("merge"), "x"))
    few = F.col("nears") * F.col("fars") <= F.lit(_COMPARED * most)
    small = named.filter(few)
    other = small.filter("far").select("x", "v", "c", "n", "size", "rest", "near").toDF("x", "u", "c_u", "n_u", "size_u", "rest_u", "near_u")
    # the first value that two differences share in their order has all others that they share behind it
    could = 2 * (100 + percent) * (F.least("rest", "rest_u") + 1) >= (100 + percent) * (F.col("size") + F.col("size_u")) - (100 - percent) * (F.col("n") + F.col("n_u"))
    once = (F.col("u") > F.col("v")) | (F.col("u") < F.col("v")) & ~(F.col("far") & F.col("near_u"))
    met = small.filter("near").select("x", "v", "c", "n", "size", "rest", "far").join(other.hint("merge"), "x").filter(once & (F.col("c") != F.col("c_u")) & could)
    pairs = stored(met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    large = named.filter(~few).select("x", "v", "c", "near", "far", "nears", "fars")
    links = told.filter("not far").select(F.least("h", "v").alias("u"), F.greatest("h", "v").alias("v"))
    return pairs, links.unionByName(_blocks(large, sets, percent)) if large.head(1) else links


def _blocks(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v), written, of the far nodes of each list of rows (x, v, c, near, far, nears, fars) with its near nodes of
    other components, one for each far node, block and component. nears and fars count them. Sets are compared with those of their own class of size
    and its neighbours, and blocks of large sets have fewer of them."""
    ratio = 100 / percent
    full = rows.join(sets.hint("merge"), "v").withColumn("size", F.floor(F.log(F.length("grams") / _BYTES) / math.log(ratio)).cast("int"))
    side = F.greatest(F.least(F.lit(SIDE), F.floor(F.lit(_BLOCK) / F.pow(F.lit(ratio), F.col("size") + 1))), F.lit(1)).cast("long")
    parts = lambda n: F.ceil(F.col(n) / side).cast("long")
    deal = lambda n: F.pmod(F.xxhash64("v"), parts(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), parts(n) - 1))
    left = full.filter("far").select("x", "size", deal("fars").alias("a"), every("nears").alias("b"), "v", "c", "grams")
    near = full.filter("near").withColumn("size", F.explode(F.array(*[F.col("size") + k for k in (-1, 0, 1)])))
    met = stored(full.filter("far").select("x", "size").distinct())
    right = near.join(met.hint("merge"), ["x", "size"], "left_semi").select("x", "size", every("fars").alias("a"), deal("nears").alias("b"), "v", "c", "grams")
    right = right.toDF(*right.columns)  # columns of its own

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"u": [], "v": []}, dtype="int64")
        sets = [[unpacked(b) for b in part["grams"]] for part in (left, right)]
        sizes = [np.array([len(s) for s in part]) for part in sets]
        values = [np.concatenate(part) for part in sets]
        at = [np.repeat(np.arange(len(size)), size) for size in sizes]
        both, same = np.intersect1d(*values), np.zeros((len(left), len(right)), np.int64)
        for first in range(0, len(both), _COLUMNS):
            part, grids = both[first : first + _COLUMNS], []
            for value, own, size in zip(values, at, sizes, strict=True):
                where = np.searchsorted(part, value)
                known = part[np.minimum(where, len(part) - 1)] == value
                grid = np.zeros((len(size), len(part)), np.float32)
                grid[own[known], where[known]] = 1
                grids.append(grid)
            same += (grids[0] @ grids[1].T).astype(np.int64)
        union = sizes[0][:, None] + sizes[1][None, :] - same
        u, v, c, d = (x.to_numpy() for x in (left["v"], right["v"], left["c"], right["c"]))
        i, j = np.nonzero((same * 100 >= union * percent) & (c[:, None] != d[None, :]))
        out = pd.DataFrame({"u": u[i], "v": v[j], "d": d[j]}).drop_duplicates(["u", "d"])
        return pd.DataFrame({"u": np.minimum(out["u"], out["v"]), "v": np.maximum(out["u"], out["v"])})

    keys = ["x", "size", "a", "b"]
    return stored(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "u long, v long").distinct())


def _sets(docs: DataFrame, text_col: str, rows: DataFrame, pairs: DataFrame, size: int) -> DataFrame:
    """(v, grams): the full sets of the nodes in pairs, from a text of each."""
    needed = pairs.select(F.explode(F.array("u", "v")).alias("v")).distinct()
    one = rows.filter("n > 0").groupBy("v").agg(F.min("t").alias("t")).join(needed.hint("merge"), "v", "left_semi")
    text = quoted(text_col)
    texts = docs.select(F.xxhash64(text).alias("t"), text.alias("text")).groupBy("t").agg(F.first("text").alias("text"))

    @F.pandas_udf("binary")
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series([packed(shingles(t or "", size)) for t in texts])

    return stored(texts.join(stored(one).hint("merge"), "t").select("v", whole("text").alias("grams")))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are alike."""

    @F.pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alike(unpacked(x), unpacked(y), percent) for x, y in zip(a, b, strict=True)], dtype=bool)

    of = lambda name: sets.select(F.col("v").alias(name), F.col("grams").alias(f"{name}_grams")).hint("merge")
    both = pairs.join(of("u"), "u").join(of("v"), "v")
    return stored(both.filter(close("u_grams", "v_grams")).drop("u_grams", "v_grams"))


def links(docs: DataFrame, rows: DataFrame, text_col: str = "text", size: int = SHINGLE, percent: int = LIKE_PERCENT, also: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Edges (u, v) between the nodes of signed rows whose components are those of all pairs of a likeness of `percent`
    hundredths, 80 at least. also: more pairs (u, v) to look at. most: nodes of a short list."""
    if percent < 80:
        raise ValueError("the sketches find a likeness of 0.8 or more")
    nodes = stored(rows.filter("n > 0").groupBy("v").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    listed = _listed(nodes)
    lists, hubs = _hubs(listed)
    tried = hubs.withColumn("hub", F.lit(True))
    if also is not None:
        tried = stored(tried.unionByName(also.select("u", "v", F.lit(False).alias("hub")).distinct()))
    first = _verified(tried, _sets(docs, text_col, rows, tried, size), percent)
    most = most or LIST
    open_ = _open(listed, lists, _tops(first.filter("hub")), most)
    # the first value in common of a pair that no short list holds is early in both orders, and its list is long
    long = open_.filter((F.col("n") > most) & F.col("early"))
    pairs = _short(open_.filter(F.col("n") <= most))
    crowded = bool(long.head(1))
    needed = pairs.unionByName(long.select(F.col("h").alias("u"), "v").distinct()) if crowded else pairs
    sets = _sets(docs, text_col, rows, needed, size)
    edges = first.drop("hub").unionByName(_verified(pairs, sets, percent))
    if crowded:
        more, links = _long(long, sets, percent, most)
        edges = edges.unionByName(_verified(more, sets, percent)).unionByName(links)
    return edges


def grouped(rows: DataFrame, edges: DataFrame, empty_alike: bool = False) -> DataFrame:
    """(id, t, n, root, component_id) of every signed row: the node that names its component, and the least id of it.
    empty_alike: whether rows without words are one component, or one each."""
    roots, bare = components(edges), F.lit(False) if empty_alike else F.col("n") == 0
    least = rows.filter(~bare).groupBy("v").agg(F.min("id").alias("least"))
    named = stored(least.join(roots.hint("merge"), F.col("v") == F.col("node"), "left").select("v", "least", F.coalesce("root", "v").alias("root")))
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = stored(named.select("v", "root").join(ids.hint("merge"), "root").select("v", "root", "component_id"))
    own = rows.filter(bare).select("id", "t", "n", F.lit(None).cast("long").alias("root"), F.col("id").alias("component_id"))
    return rows.filter(~bare).join(groups.hint("merge"), "v").select("id", "t", "n", "root", "component_id").unionByName(own)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = LIKE_PERCENT) -> DataFrame:
    """(id, t, n, root, component_id) of every row of docs; root is null for texts without words, which have no links."""
    rows = signed(docs, id_col, text_col, size)
    return grouped(rows, links(docs, rows, text_col, size, percent))


def kept(found: DataFrame) -> Column:
    return F.col("id").eqNullSafe(F.col("component_id"))


def drop(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that have the least id of their component; rows of equal id in it stay together."""
    found = near_duplicates(docs, id_col, text_col, **options)
    gone = found.filter(~kept(found)).select(F.col("id").alias("__gone"), F.col("t").alias("__hash")).distinct()
    same = quoted(id_col).eqNullSafe(F.col("__gone")) & (F.xxhash64(quoted(text_col)) == F.col("__hash"))
    return docs.join(gone.hint("merge"), same, "left_anti")


def op11_bottom_k(spark, sf_dir):
    """Size of the shingle set and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", kept(found).alias("kept"))
