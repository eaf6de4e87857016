"""Mixing sources to target weights: hierarchical budgeting.

The leaves of a tree (domain, language, source) hold tokens; a leaf can be read up to `epochs` times, and what it
can give at most is its capacity, a node's that of its leaves. A budget goes down from the root: a node's children
share it by weight, a child that can't use its share is filled up, and what it lacks goes to its siblings, by
weight; as no node is given more than its capacity, only what a whole family can't use is passed on to the family of
its parent. Shares are whole tokens, rounded down. Each level is one window over the sums of its nodes.

A leaf with allotment a of T tokens is read a div T times in full, and then a prefix of one more epoch, in the order
of a hash of seed, epoch and id: its documents up to the first that would pass the allotment. The cut is found
without sorting the leaf: tokens are summed in ranges of the hash, about RANGE documents each, and only the
documents of the range with the cut are put in order. Documents whose hashes are equal are read or left together.

Cases: null and blank texts have no tokens, and are read with the prefix that they fall in; null path names count as
""; unknown names weigh 1; a weight of 0 leaves a node's tokens out; null ids count as an empty text in the hash;
repeated rows are read alike; a very long text counts with all its words; an empty table gives an empty result; input
columns other than the id, the text and the path are returned by `select` as they were. The leaf table is broadcast up to MAX_LEAVES leaves, and joined by sorting beyond.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from curves.llm.common import WORD_RE, free, n_words, quoted, stored, table

PATH = ("domain", "lang", "source")
MAX_LEAVES, RANGE, SEED, BUDGET_SHARE, EPOCHS = 50_000, 1000, 17, 0.5, 2
#: Target weights of the query, by level and name; other names weigh 1.
WEIGHTS = ({"dom0": 4, "dom1": 3, "dom2": 2, "dom3": 1}, {"en": 6, "de": 2, "fr": 2, "es": 1}, {})
BITS = 60


def domain(source: Column) -> Column:
    """The query's domain of a source: its number modulo 4."""
    number = F.coalesce(F.regexp_extract(F.coalesce(source, F.lit("")), r"([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.concat(F.lit("dom"), (number % 4).cast("string"))


def _hash(doc_id: Column, epoch: Column, seed: int) -> Column:
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _shared(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """nodes (w, cap, b: the parent's budget) with alloc: b shared by weight up to the capacities."""
    family = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = family.orderBy("ratio", "name")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    out = nodes.withColumn("ratio", F.col("cap") / F.col("w")).withColumns(
        {"taken": F.coalesce(F.sum("cap").over(before), F.lit(0)), "open": F.sum("w").over(rest)}
    )
    out = out.withColumn("full", F.col("b") * F.col("w") >= F.col("taken") * F.col("w") + F.col("cap") * F.col("open"))
    out = out.withColumns(
        {
            "taken": F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), F.lit(0)),
            "open": F.sum(F.when(~F.col("full"), F.col("w"))).over(family),
        }
    )
    return out.withColumn("alloc", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(b - taken) * w div open"))).drop("ratio", "taken", "open", "full")


def allot(leaves: DataFrame, path: list[str], weights, share: float, epochs: int) -> DataFrame:
    """leaves (path, tokens, docs) with each leaf's alloc."""

    def weight(level: int) -> Column:
        known = weights[level]
        if not known:
            return F.lit(1).cast("long")
        named = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.lit(v))])
        return F.coalesce(F.try_element_at(named, F.col(path[level])), F.lit(1)).cast("long")

    ws = [f"__w{i}" for i in range(len(path))]
    usable = reduce(lambda a, b: a & b, [F.col(w) > 0 for w in ws])
    base = leaves.withColumns({w: weight(i) for i, w in enumerate(ws)}).withColumn("cap", F.when(usable, F.col("tokens") * epochs).otherwise(0))
    whole = F.least(F.sum("cap"), F.floor(F.sum("tokens") * F.lit(share)))
    budget, budgets = base.agg(whole.cast("long").alias("b")).first()["b"], None
    for i in range(len(path)):
        nodes = base.groupBy(*path[: i + 1]).agg(F.sum("cap").alias("cap"), F.greatest(F.max(ws[i]), F.lit(1)).alias("w"))
        nodes = nodes.withColumn("name", F.col(path[i]))
        given = nodes.withColumn("b", F.lit(budget)) if budgets is None else nodes.join(budgets.hint("merge"), path[:i])
        budgets = _shared(given, path[:i]).select(*path[: i + 1], F.col("alloc").cast("long").alias("b"))
    return leaves.join(budgets.hint("merge"), path).withColumnRenamed("b", "alloc")


def plan(docs: DataFrame, id_col: str, tokens: Column, path: list[str], weights, share: float, epochs: int, seed: int) -> tuple[DataFrame, int]:
    """(path, full, thr): how often each leaf is read in full, and up to which hash in the next epoch; and the
    number of leaves."""
    own, path = path, [f"__p{i}" for i in range(len(path))]
    rows = stored(docs.select(*[F.coalesce(quoted(p), F.lit("")).alias(k) for p, k in zip(own, path, strict=True)], quoted(id_col).alias("__id"), tokens.alias("n")))
    leaves = rows.groupBy(*path).agg(F.sum("n").alias("tokens"), F.count("*").alias("docs"))
    reads = stored(
        allot(leaves, path, weights, share, epochs)
        .withColumn("full", F.coalesce(F.expr("alloc div nullif(tokens, 0)"), F.lit(0)))
        .withColumn("rest", F.expr("alloc - full * tokens"))
        .withColumn("width", F.expr(f"({1 << BITS} + greatest(docs div {RANGE}, 1) - 1) div greatest(docs div {RANGE}, 1)"))
        .select(*path, "full", "rest", "width")
    )
    count = reads.count()
    placed = (
        joined(rows, reads, path, count).withColumn("h", _hash(F.col("__id"), F.col("full") + 1, seed)).withColumn("range", F.expr("h div width"))
    )
    sums = placed.groupBy(*path, "range").agg(F.sum("n").alias("s"), F.first("rest").alias("rest"))
    so_far = F.sum("s").over(Window.partitionBy(*path).orderBy("range"))
    cuts = stored(sums.withColumn("cum", so_far).filter("cum > rest and cum - s <= rest").select(*path, "range", (F.col("cum") - F.col("s")).alias("before")))
    cum = F.sum("n").over(Window.partitionBy(*path).orderBy("h").rangeBetween(Window.unboundedPreceding, 0))
    fits = joined(placed, cuts, [*path, "range"], count).withColumn("cum", cum)
    found = fits.groupBy(*path).agg(
        F.coalesce(F.max(F.when(F.col("before") + F.col("cum") <= F.col("rest"), F.col("h"))), F.min(F.col("range") * F.col("width")) - 1).alias("thr")
    )
    return stored(reads.join(found.hint("merge"), path, "left").select(*path, "full", F.coalesce("thr", F.lit(-1)).alias("thr"))), count


def joined(rows: DataFrame, leaves: DataFrame, on: list[str], count: int) -> DataFrame:
    """rows with the columns of a table that has a row for each leaf at most."""
    return rows.join(F.broadcast(leaves) if count <= MAX_LEAVES else leaves.hint("merge"), on)


def copies(docs: DataFrame, id_col: str = "doc_id", tokens: Column | None = None, path: tuple[str, ...] = PATH, weights=WEIGHTS, share: float = BUDGET_SHARE, epochs: int = EPOCHS, seed: int = SEED, copies_col: str = "__copies") -> DataFrame:
    """docs with ``copies_col``, how often each document is read. The budget is a share of all tokens."""
    docs = docs.drop(copies_col)
    tokens = n_words(F.col("text")) if tokens is None else tokens
    reads, count = plan(docs, id_col, tokens, list(path), weights, share, epochs, seed)
    *keys, full, thr = free(docs, *[f"k{i}" for i in range(len(path))], "full", "thr")
    out = joined(docs.withColumns({k: F.coalesce(quoted(p), F.lit("")) for k, p in zip(keys, path, strict=True)}), reads.toDF(*keys, full, thr), keys, count)
    read = F.col(full) + (_hash(quoted(id_col), F.col(full) + 1, seed) <= F.col(thr)).cast("long")
    return out.withColumn(copies_col, read).select(*map(quoted, docs.columns), copies_col)


def select(docs: DataFrame, **options) -> DataFrame:
    """The mix: each document as often as it is read."""
    times, copy = free(docs, "times", "copy")
    read = copies(docs, copies_col=times, **options).filter(F.col(times) > 0)
    return read.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(copy, times)


def op8_mixing(spark, sf_dir):
    """How often each document is read when half the corpus's tokens are mixed to the target weights."""
    docs = table(spark, sf_dir, "documents").withColumns({"domain": domain(F.col("source")), "n_tokens": n_words(F.col("text"))})
    out = copies(docs, tokens=F.col("n_tokens"))
    return out.select("doc_id", "domain", "lang", "source", "n_tokens", F.col("__copies").alias("copies"))


def _weight_sql(level: int) -> str:
    known = " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items())
    return f"CASE {PATH[level]} {known} ELSE 1 END" if known else "1"


def _level_sql(i: int) -> str:
    keys, parent = ", ".join(PATH[: i + 1]), ", ".join(PATH[:i])
    by = f"PARTITION BY {parent}" if parent else ""
    given = "CROSS JOIN whole" if i == 0 else f"JOIN b{i - 1} USING ({parent})"
    return f"""
n{i} AS (SELECT n.*, b, {PATH[i]} AS name FROM (SELECT {keys}, sum(tokens) * {EPOCHS} AS cap, max({_weight_sql(i)}) AS w FROM leaf GROUP BY {keys}) n {given}),
f{i} AS (SELECT *, b * w >= coalesce(sum(cap) OVER ({by} ORDER BY cap / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * w
                + cap * sum(w) OVER ({by} ORDER BY cap / w, name ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS done FROM n{i}),
b{i} AS (SELECT {keys}, CASE WHEN done THEN cap ELSE (b - coalesce(sum(cap) FILTER (done) OVER ({by}), 0)) * w
                // nullif(sum(w) FILTER (NOT done) OVER ({by}), 0) END AS b FROM f{i})"""


ORACLE = rf"""
WITH d AS (SELECT doc_id, 'dom' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS INT), 0) % 4) AS domain,
                  lang, source, len(regexp_extract_all(coalesce(text, ''), '{WORD_RE}'))::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, count(*) AS docs FROM d GROUP BY ALL),
whole AS (SELECT least(sum(tokens) * {EPOCHS}, floor(sum(tokens) * {BUDGET_SHARE})::HUGEINT) AS b FROM leaf),
{",".join(_level_sql(i) for i in range(3))},
r AS (SELECT domain, lang, source, b // tokens AS full_reads, b - (b // tokens) * tokens AS rest FROM leaf JOIN b2 USING (domain, lang, source)),
h AS (SELECT d.*, full_reads, rest, ('0x' || substr(md5('{SEED}:' || (full_reads + 1) || ':' || doc_id), 1, {BITS // 4}))::BIGINT AS h
      FROM d JOIN r USING (domain, lang, source)),
c AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h RANGE UNBOUNDED PRECEDING) AS cum FROM h)
SELECT doc_id, domain, lang, source, n_tokens, (full_reads + (cum <= rest)::INT)::BIGINT AS copies FROM c
"""
