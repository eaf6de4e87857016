"""Document fingerprints: one-permutation MinHash.

Each five-word shingle (lower-cased; a shorter text is one shingle) is hashed once; the top bits choose one of
BINS bins, which keeps its least hash. An empty bin takes the value of a filled one by optimal densification: a
fixed random sequence of bins for each bin, followed to the first filled one, the same for every document, and
mixes the bin's number into it. The
BITS low-order bits of each bin are packed and written as hex. The likeness of two fingerprints corrects the share
of agreeing bins for chance: ``(agree - c) / (1 - c)`` with ``c = 2 ** -BITS``, cut to 0 .. 1.

`with_next` pairs each document with the next by ascending id (the last with the first) in one shuffle of the
texts: boundaries are ids of the table, rows go to the range they fall in, and the first row of each range also
goes to the range before it, so every range holds its rows' successors. An id with more rows than a range has boundaries
at hashes of its texts too, so that null ids, or one id on a third of all rows, spread over many tasks.

Cases: ids are integers, others are refused with a TypeError; null text counts as empty; a text without words has the empty fingerprint, which is like itself (1) and
unlike all others (0); null ids come first; rows of equal id follow each other by their texts' hashes, and rows equal in
both each have an equal next, or the first row after them; such rows are in one range; a very long text is hashed word by word in
one task; a table of one row is its own next; an empty table gives an empty result; other input columns don't matter.
"""

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curves.llm.common import integer_ids, order_id, quoted, table

SHINGLE, BINS, BITS = 5, 256, 4
#: Ranges for each shuffle partition.
RANGES = 3
LEAST = -(2**63)
_MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX[1])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX[2])
    return x ^ (x >> np.uint64(31))


def _probes(bins: int, steps: int) -> np.ndarray:
    """Row t: the bin that each empty bin tries at step t."""
    return (_mixed(np.arange(1, bins * steps + 1, dtype=np.uint64) * np.uint64(_MIX[0])) % np.uint64(bins)).astype(np.int64).reshape(steps, bins)


class Fingerprinter:
    """Fingerprints and their likeness, for one setting."""

    def __init__(self, bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE):
        if bins & (bins - 1) or bits not in (1, 2, 4, 8):
            raise ValueError("bins is a power of two; bits is 1, 2, 4 or 8")
        self.bins, self.bits, self.shingle = bins, bits, shingle
        self.probes = _probes(bins, 64)

    def minima(self, text: str) -> np.ndarray | None:
        """The densified bins of a text, None without words."""
        found = self._bins(text)
        return None if found is None else found[0]

    def _bins(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The densified bins, and which of them borrowed their value."""
        ws = text.lower().split()
        if not ws:
            return None
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in ws), np.uint64, len(ws))
        k = min(self.shingle, len(ws))
        grams = np.full(len(ws) - k + 1, k, np.uint64)
        for i in range(k):
            grams = _mixed(grams * np.uint64(_MIX[0]) + hashes[i : len(hashes) - k + 1 + i])
        least = np.full(self.bins, np.uint64(2**64 - 1))
        where = (grams >> np.uint64(64 - self.bins.bit_length() + 1)).astype(np.int64) if self.bins > 1 else np.zeros(len(grams), np.int64)
        np.minimum.at(least, where, grams)
        filled = np.zeros(self.bins, bool)
        filled[where] = True
        empty = np.flatnonzero(~filled)
        for step in self.probes:
            if not len(empty):
                break
            tried = step[empty]
            hit = filled[tried]
            least[empty[hit]] = least[tried[hit]]
            empty = empty[~hit]
        if len(empty):  # few filled bins: each remaining bin takes a fixed one of them
            full = np.flatnonzero(filled)
            least[empty] = least[full[empty % len(full)]]
        return least, np.flatnonzero(~filled)

    @staticmethod
    def _borrowed(values: np.ndarray, bins: np.ndarray) -> np.ndarray:
        """Values mixed with the bins that borrow them. Their low bits would else agree in all bins of two texts at once."""
        return _mixed(values ^ (bins.astype(np.uint64) + np.uint64(1)) * np.uint64(_MIX[0]))

    def __call__(self, text: str) -> str:
        found = self._bins(text)
        if found is None:
            return ""
        least, empty = found
        least[empty] = self._borrowed(least[empty], empty)
        low = (least & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        return np.packbits(np.unpackbits(low[:, None], axis=1)[:, 8 - self.bits :].ravel()).tobytes().hex()

    def likeness(self, a: str, b: str) -> float:
        if a == b:
            return 1.0
        if not a or not b:
            return 0.0
        x, y = (np.unpackbits(np.frombuffer(bytes.fromhex(s), np.uint8)).reshape(self.bins, self.bits) for s in (a, b))
        chance = 2.0**-self.bits
        return float(min(1.0, max(0.0, ((x == y).all(axis=1).mean() - chance) / (1 - chance))))


def _bounds(rows: DataFrame, ranges: int) -> list[tuple[int, int]]:
    """First (key, text hash) of each range, in order. The hash of an id with one boundary is the least there is. Hashes
    have 53 bits, so that a quantile of them is one of them."""
    wanted = [(i + 1) / ranges for i in range(ranges - 1)]
    first, cuts = rows.agg(F.min("key"), F.percentile_approx("key", wanted, F.lit(100_000))).first()
    if first is None:
        return [(0, LEAST)]
    near = np.unique(np.array([first, *(cuts or [])], np.int64))  # quantiles are doubles: large ids come rounded

    @F.pandas_udf("int")
    def place(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(near, keys.to_numpy(), side="right").astype("int32"))

    least = rows.groupBy(place("key").alias("part")).agg(F.min("key").alias("least")).collect()
    at = {r["part"]: r["least"] for r in least}
    times = Counter(k for c in [first, *(cuts or [])] if (k := at.get(int(np.searchsorted(near, c, side="right")))) is not None)
    times |= {k: max(times[k], 1) for k in at.values()}
    hot = [k for k, n in times.items() if n > 1]
    bounds = [(k, LEAST) for k, n in times.items() if n == 1]
    if hot:
        found = rows.filter(F.col("key").isin(hot)).groupBy("key").agg(F.min("h").alias("low"), F.percentile_approx("h", wanted, F.lit(10_000)).alias("cuts"))
        for r in found.collect():
            step = max(1, len(r["cuts"]) // times[r["key"]])
            bounds += {(r["key"], h) for h in [r["low"], *r["cuts"][step - 1 :: step]]}
    return sorted(bounds)


def _placed(keys: np.ndarray, hashes: np.ndarray, bounds: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the range of each row, and whether the row may be the first of it."""
    ids, hs = (np.array(x, np.int64) for x in zip(*bounds, strict=True))
    at = np.searchsorted(ids, keys, side="right") - 1
    first = ids[at] == keys
    for k in np.unique(ids[1:][ids[1:] == ids[:-1]]):
        own, low, high = keys == k, np.searchsorted(ids, k, side="left"), np.searchsorted(ids, k, side="right")
        at[own] = low + np.searchsorted(hs[low:high], hashes[own], side="right") - 1
        first[own] = hs[at[own]] == hashes[own]
    return at, first


def with_next(docs: DataFrame, id_col: str, text_col: str, visit, schema: str) -> DataFrame:
    """visit(id, text, next text) -> row, the id first, for each document and the next one."""
    integer_ids(docs, id_col)
    spark, text = docs.sparkSession, F.coalesce(quoted(text_col), F.lit(""))
    rows = docs.select(quoted(id_col).isNull().alias("none"), order_id(quoted(id_col)).alias("key"), F.shiftright(F.xxhash64(text), 11).alias("h"), text.alias("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = _bounds(rows, RANGES * parts)

    @F.pandas_udf("struct<part:int,first:boolean>")
    def ranged(keys: pd.Series, hashes: pd.Series) -> pd.DataFrame:
        at, first = _placed(keys.to_numpy(), hashes.to_numpy(), bounds)
        return pd.DataFrame({"part": at.astype("int32"), "first": first})

    placed = rows.withColumn("at", ranged("key", "h"))
    own = F.struct(F.col("at.part").alias("part"), F.lit(False).alias("ahead"))
    before = F.struct(F.pmod(F.col("at.part") - 1, F.lit(len(bounds))).alias("part"), F.lit(True).alias("ahead"))
    copies = placed.select("none", "key", "h", "text", F.inline(F.when(F.col("at.first"), F.array(own, before)).otherwise(F.array(own))))
    dealt = copies.repartition(parts, "part").sortWithinPartitions("part", "ahead", "key", "h", "text")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, names = None, [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            out = []
            for part, ahead, none, key, text in zip(pdf["part"], pdf["ahead"], pdf["none"], pdf["key"], pdf["text"], strict=True):
                if last and last[0] == part:
                    out.append(visit(last[1], last[2], text))
                last = None if ahead else (part, None if none else key, text)
            yield pd.DataFrame(out, columns=names, dtype=object)  # else a null id turns its column into doubles

    return dealt.select("part", "ahead", "none", "key", "text").mapInPandas(walk, schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bins: int = BINS, bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document,
    where the edited text has its last half replaced by the beginning of the next document."""
    tool, cache = Fingerprinter(bins, bits, shingle), {}

    def visit(i, text, after_text):
        own = tool(text) if (had := cache.get(text)) is None else had
        half = len(text) // 2
        edited = text[: len(text) - half] + after_text[:half]
        other, following = tool(edited), tool(after_text)
        cache.clear()
        cache[after_text] = following  # the next visit's own
        digest = hashlib.sha256(edited.encode()).hexdigest()
        return i, len(text), digest, own, other, tool.likeness(own, other), tool.likeness(own, following)

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, id_col, text_col, visit, schema)


def op6_minhash(spark, sf_dir):
    """Fingerprints of every document and of its edited text, and their likenesses."""
    return fingerprints(table(spark, sf_dir, "documents"))
