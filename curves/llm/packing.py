"""Best-fit packing with several bin capacities.

Documents are cut into pieces of at most the largest capacity; a piece that fills it is a bin by itself. The rest
are dealt to shards by hash, about DOCS of them each, and each shard is packed by best fit, longest piece first: a
piece goes to the open bin with the least room that takes it; else a bin opens. The capacities are weighed against each
other by running the packing once for each way to open bins, and keeping the result with the least total cost after
every bin has been downsized to the smallest capacity that holds its contents. A way has a floor, and opens either the
smallest capacity that takes the piece and the floor, or of those the one with the least cost a token. A bin costs
``OVERHEAD + c + c * c / QUADRATIC``: setup, tokens and attention.

Rows equal in id, text and length are counted first and dealt by their number among each other, so that a row that
repeats a billion times fills no shard beyond the others: the items of a shard are bounded whatever the corpus. The copies of a row
are numbered in blocks of BLOCK, which are dealt before they are.

Lengths are words by default (no tokenizer is trained or needed); pass a column of token counts for exact ones.

Cases: ids are integers, others are refused with a TypeError; null, empty and blank texts have length zero and no piece; negative or null lengths count as zero; rows
of equal id are packed each; a null id is a null in the bin's list; a very long text is cut into many bins, of which only
its id and numbers are kept; an empty table gives an empty result; other input columns don't matter. The result doesn't
depend on the partitioning: items are ordered by length, id, start and number.
"""

from collections.abc import Callable
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curves.llm.common import integer_ids, n_words, order_id, quoted, stored, table

CAPACITIES, OVERHEAD, QUADRATIC, DOCS, BLOCK = (512, 1024, 2048, 4096, 8192), 32, 32768, 20_000, 4096
SCHEMA = "bin_id string, capacity int, n_tokens int, doc_ids array<bigint>, starts array<bigint>, lengths array<int>"
NULL_ID = -(2**63)


def cost(capacity: int) -> float:
    return OVERHEAD + capacity + capacity * capacity / QUADRATIC


def rate(capacity: int) -> float:
    """Cost of a token in a full bin."""
    return cost(capacity) / capacity


def best_fit(lengths: list[int], capacities: tuple[int, ...], floor: int, by: Callable[[int], float] = cost) -> list[list[int]]:
    """Bins (lists of positions) by best fit over lengths in descending order; a bin opens at the capacity, of those
    that take the piece and the floor, with the least value of `by`.

    Open bins stand in one stack for each amount of room; the bits of `rooms` say which stacks have any."""
    bins: list[list[int]] = []
    stacks: list[list[int]] = [[] for _ in range(capacities[-1] + 1)]
    rooms = 0
    for i, n in enumerate(lengths):
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            found = stacks[room].pop()
            if not stacks[room]:
                rooms ^= 1 << room
            bins[found].append(i)
        else:
            room = min((c for c in capacities if c >= max(n, floor)), key=by)
            found = len(bins)
            bins.append([i])
        left = room - n
        if not stacks[left]:
            rooms |= 1 << left
        stacks[left].append(found)
    return bins


def downsized(total: int, capacities: tuple[int, ...]) -> int:
    return min(c for c in capacities if c >= total)


def pack_items(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES) -> tuple[list[list[int]], list[int]]:
    """The least-cost packing over all ways to open bins, and each bin's final capacity."""
    best, seen = None, set()
    for floor, by in product(capacities, (cost, rate)):
        opened = tuple(min((c for c in capacities if c >= max(n, floor)), key=by) for n in capacities)
        if opened in seen:
            continue
        seen.add(opened)
        bins = best_fit(lengths, capacities, floor, by)
        sizes = [downsized(sum(lengths[i] for i in b), capacities) for b in bins]
        total = sum(map(cost, sizes))
        if best is None or total < best[0]:
            best = total, bins, sizes
    return best[1], best[2]


def pack(docs: DataFrame, length: Column | None = None, id_col: str = "doc_id", text_col: str = "text", capacities: tuple[int, ...] = CAPACITIES, docs_a_shard: int = DOCS) -> DataFrame:
    """One row a bin: its capacity and tokens, and the id, first token and length of each piece in it."""
    integer_ids(docs, id_col)
    capacities = tuple(sorted(capacities))
    top = capacities[-1]
    n = F.greatest(F.coalesce((n_words(quoted(text_col)) if length is None else length).cast("long"), F.lit(0)), F.lit(0))
    keyed = docs.select(order_id(quoted(id_col)).alias("key"), F.xxhash64(quoted(id_col), quoted(text_col)).alias("h"), n.alias("n"))
    items = stored(keyed.filter("n > 0").groupBy("key", "h", "n").agg(F.count("*").alias("rows")))
    total = items.agg(F.sum("rows")).first()[0] or 0
    shards = max(1, -(-total // docs_a_shard))
    blocks = items.select("*", F.explode(F.sequence(F.lit(0), F.expr(f"(rows - 1) div {BLOCK}"))).alias("block")).repartition("h", "block")
    numbers = F.sequence(F.col("block") * BLOCK, F.least(F.col("rows"), (F.col("block") + 1) * BLOCK) - 1)
    copies = blocks.select("key", "h", "n", F.explode(numbers).alias("no"))
    real = F.nullif(F.col("key"), F.lit(NULL_ID))
    starts = F.when(F.col("n") >= top, F.sequence(F.lit(0), F.expr(f"n div {top} - 1"))).otherwise(F.array().cast("array<bigint>"))
    full = copies.select("key", "h", "no", F.explode(starts).alias("k")).select(
        F.concat_ws("-", F.lit("full"), F.coalesce(real.cast("string"), F.lit("null")), F.lower(F.hex("h")), "no", "k").alias("bin_id"),
        F.lit(top).alias("capacity"), F.lit(top).alias("n_tokens"), F.array(real).alias("doc_ids"),
        F.array(F.col("k") * top).alias("starts"), F.array(F.lit(top)).alias("lengths"),
    )
    rest = copies.select(
        F.pmod(F.xxhash64("h", "no"), F.lit(shards)).alias("shard"), "key", "h", "no",
        (F.col("n") - F.col("n") % top).alias("start"), (F.col("n") % top).cast("int").alias("len"),
    ).filter("len > 0")

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["len", "key", "start", "h", "no"], ascending=[False, True, True, True, True])
        name, keys, at, lens = int(pdf["shard"].iloc[0]), pdf["key"].tolist(), pdf["start"].tolist(), pdf["len"].tolist()
        bins, sizes = pack_items(lens, capacities)
        return pd.DataFrame(
            [
                (f"{name}-{k}", size, sum(lens[i] for i in b), [None if keys[i] == NULL_ID else keys[i] for i in b], [at[i] for i in b], [lens[i] for i in b])
                for k, (b, size) in enumerate(zip(bins, sizes, strict=True))
            ],
            columns=["bin_id", "capacity", "n_tokens", "doc_ids", "starts", "lengths"],
        )

    return rest.groupBy("shard").applyInPandas(shard, SCHEMA).unionByName(full)


def op5_packing(spark, sf_dir):
    """Every document's words packed into sequences of 512 to 8192."""
    return pack(table(spark, sf_dir, "documents"))
