"""Raw bars: loading, saving, and the feed derived from the test tables."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curves.functions import storage
from curves.functions.joins import sized
from curves.functions.storage import stored
from curves.functions.vocab import MONTHS

RAW_SCHEMA = (
    "ts_event string, rtype int, publisher_id int, instrument_id bigint, open double, high double, low double, close double, "
    "volume bigint, symbol string, ingest_seq bigint"
)
FAMILIES = ("outrights", "calendars", "cracks", "brent_wti", "quarterly", "semestral", "yearly", "flies")


def with_date(raw: DataFrame) -> DataFrame:
    """raw with its naive UTC trade date, from ISO-8601 event times."""
    return raw.withColumn("date", F.to_date(F.to_timestamp("ts_event")))


def load_raw(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Bars from parquet or CSV files, with ingest_seq, the feed order that deduplication needs. A feed without that
    column gets it from where its rows stand: files by name, and rows by their place in a file.
    For parquet it is one number, of up to 2^40 rows a file."""
    load = lambda schema=None: (spark.read.schema(schema) if schema else spark.read).option("header", True).format(fmt).load(path)
    if "ingest_seq" in load().columns:
        return with_date(load(RAW_SCHEMA))
    rows = load(RAW_SCHEMA.removesuffix(", ingest_seq bigint"))
    name = F.col("_metadata.file_path")
    if fmt == "parquet":
        place = [F.col("_metadata.row_index").alias("__row")]
    else:
        place = [F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__row")]
    # only the files' names are put in one order
    names = stored(load().select(name.alias("__path")).distinct())
    files = stored(names.withColumn("__file", F.row_number().over(Window.orderBy("__path")).cast("bigint")))
    placed = rows.select("*", name.alias("__path"), *place).join(sized(files), "__path")
    seq = F.shiftleft("__file", 40) + F.col("__row") if fmt == "parquet" else F.struct("__file", "__block", "__row")
    return with_date(placed.select(*rows.columns, seq.alias("ingest_seq")))


#: The year by which each frame is saved in folders, if asked for.
YEARS = {
    "outrights": "expiry_year", "calendars": "near_year", "cracks": "expiry_year", "brent_wti": "wti_year",
    "quarterly": "near_year", "semestral": "near_year", "yearly": "near_year", "flies": "front_year",
}


#: Rows of a file of a frame saved by year.
ROWS_A_FILE = 1_000_000


def by_ranges(df: DataFrame, year: str, rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """df dealt to tasks by ranges of year, date and contract with about rows_a_file rows each, so that tasks grow with the
    rows, and a year with most of them has many; a folder of a year gets files of neighbouring dates. df is written out
    first, as the ranges are sampled from it, and it is counted."""
    rows = stored(df)
    ranges = max(1, math.ceil(rows.count() / rows_a_file))
    keys = [c for c in (year, "date", "contract") if c in df.columns]
    return rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)


def in_order(df: DataFrame, order: str, rows_a_file: int = ROWS_A_FILE) -> DataFrame:
    """df in an order over all its tasks, which are ranges of about rows_a_file rows: more rows make more tasks, not larger ones.
    df is counted first."""
    return df.repartitionByRange(max(1, math.ceil(df.count() / rows_a_file)), order).sortWithinPartitions(order)


def save_frames(frames: dict[str, DataFrame], out: str, fmt: str = "parquet", years: dict[str, str] | None = None, rows_a_file: int = ROWS_A_FILE) -> None:
    """A folder for each frame; with years, in it one for each value of the frame's column."""
    for name, df in frames.items():
        year = (years or {}).get(name)
        writer = (by_ranges(df, year, rows_a_file).write.partitionBy(year).option("maxRecordsPerFile", rows_a_file) if year else df.write).mode("overwrite")
        (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(f"{out}/{name}")


def commit_frames(frames: dict[str, DataFrame], out: str, years: dict[str, str] | None = None, rows_a_file: int = ROWS_A_FILE) -> str:
    """Save a version of the frames below out, and name it in a manifest once all of it is written: each frame's schema, rows,
    and files with their sizes. Readers follow the newest manifest, so they see all of a version or nothing of it, and a build that
    is killed leaves the version before. The first version lies in out itself, if nothing else does, and later ones in
    folders of their own. Returns the version's folder."""
    spark = next(iter(frames.values())).sparkSession
    version = f"{time.time_ns():020d}-{uuid4().hex[:8]}"
    base = f"{out}/{version}" if storage.taken(spark, out) else out
    save_frames(frames, base, years=years, rows_a_file=rows_a_file)
    entries = {}
    for name in frames:
        saved = spark.read.parquet(f"{base}/{name}")
        entries[name] = {"schema": saved.schema.json(), "rows": saved.count(), "files": storage.files(spark, f"{base}/{name}")}
    storage.publish(spark, f"{out}/{MANIFESTS}/{version}.json", json.dumps({"folder": base.removeprefix(out), "frames": entries}))
    return base


#: Folder of the manifests; each is named for its version, and names grow with time.
MANIFESTS = "_manifests"


def manifest(spark: SparkSession, out: str) -> dict | None:
    """The newest manifest whose frames are all there, in full."""
    for path in sorted(storage.files(spark, f"{out}/{MANIFESTS}"), reverse=True):
        found = json.loads(spark.read.text(f"{out}/{MANIFESTS}/{path}", wholetext=True).first()[0])
        held = found["frames"]
        if set(held) >= set(FAMILIES) and all(storage.files(spark, f"{out}{found['folder']}/{n}") == e["files"] for n, e in held.items()):
            return found
    return None


def load_frames(spark: SparkSession, out: str) -> dict[str, DataFrame] | None:
    """The committed families, or None unless a manifest says that all eight are complete and their files are there."""
    if (found := manifest(spark, out)) is None:
        return None
    schemas = {name: StructType.fromJson(json.loads(found["frames"][name]["schema"])) for name in FAMILIES}
    return {name: spark.read.schema(schema).parquet(f"{out}{found['folder']}/{name}") for name, schema in schemas.items()}


def remove_old_frames(spark: SparkSession, out: str, keep: int = 1) -> None:
    """Remove all committed versions but the newest `keep`, their manifests first."""
    for path in sorted(storage.files(spark, f"{out}/{MANIFESTS}"), reverse=True)[keep:]:
        old = json.loads(spark.read.text(f"{out}/{MANIFESTS}/{path}", wholetext=True).first()[0])
        storage.remove(spark, f"{out}/{MANIFESTS}/{path}")
        for name in old["frames"]:
            storage.remove(spark, f"{out}{old['folder']}/{name}")


def load_or_build(spark: SparkSession, out: str, build: Callable[[], dict[str, DataFrame]], years: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The committed families; without a complete version, all are built and committed first."""
    if (found := load_frames(spark, out)) is None:
        commit_frames(build(), out, years)
        found = load_frames(spark, out)
    return found


def _symbol(ym: Column) -> Column:
    """The outright's symbol of a month: looked up, as symbols repeat after ten years."""
    names = F.array(*[F.lit(f"CL{MONTHS[i % 12]}{i // 12}") for i in range(120)])
    return F.get(names, (ym % 120).cast("int"))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if its files are too few to keep them busy."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def feed(spark: SparkSession, sf_dir: str, at: DataFrame | None = None) -> DataFrame:
    """The raw feed that lineitem stands for (FIXTURES.md, fixture A). at: (number), the order keys whose lines are wanted, -1 for
    none; the others go before bars are made of them."""
    columns = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount", "l_shipdate")
    li = spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(*columns))
    if at is not None:
        li = li.join(F.broadcast(at), F.coalesce("l_orderkey", F.lit(-1)) == F.col("number"), "left_semi")
    line, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    day = F.to_date("l_shipdate")
    ym = F.year(day) * 12 + F.month(day) + 1 + part % 11 + F.when(line == 7, 12).when(line == 6, 24).otherwise(0)
    o = F.col("l_extendedprice") / 1000
    c = o * (1 + F.col("l_tax") - F.col("l_discount"))
    # a line's bars: 0, its outright, and its own number if it has one more
    each = F.explode(F.when(line.between(1, 4), F.array(F.lit(0), line)).otherwise(F.array(F.lit(0))))
    base = li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", day.alias("date"),
        ym.alias("ym"), o.alias("o"), c.alias("c"), (supp % 12).alias("k"), (supp % 2).alias("p"), each.alias("bar"),
    )
    bar, y, k, p = F.col("bar"), F.col("ym"), F.col("k"), F.col("p")
    of = lambda zero, one, two, three, four: F.when(bar == 0, zero).when(bar == 4, four).when(bar == 3, three).when(bar == 2, two).otherwise(one)
    price = lambda x: of(x, x, -x / 20, x / 5, x / 50 - 1)
    own, product = _symbol(y), F.when(p == 0, "HO").otherwise("RB")
    out = base.withColumns(
        {
            "instrument_id": of(y, 400_000 + y, 300_000 + y * 2 + p, 200_000 + y * 2 + p, 100_000 + y * 20 + k).cast("bigint"),
            "symbol": of(
                own, F.concat(F.lit("M"), own), F.concat(own, F.lit("-BZ"), F.substring(_symbol(y + p), 3, 2)),
                F.concat(F.lit("CL:C1 "), product, F.lit("-CL "), F.substring(own, 3, 2)), F.concat(own, F.lit("-"), _symbol(y + 1 + k)),
            ),
            "open": price(F.col("o")),
            "close": price(F.col("c")),
        }
    )
    top = F.greatest("open", "close")
    return out.select(
        F.lit(35).alias("rtype"), F.lit(1).alias("publisher_id"), "instrument_id", "open", top.alias("high"),
        F.when(F.col("l_quantity") == 1, top + 0.01).otherwise(F.least("open", "close")).alias("low"), "close",
        F.col("l_quantity").cast("bigint").alias("volume"), "symbol", "date",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ingest_seq"),
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(structure, vintage, date, close): the last value of each hour for each event type (FIXTURES.md, fixture B)."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    return (
        ev.groupBy(F.col("event_type").alias("structure"), hour.alias("date"))
        .agg(F.max_by("value", F.struct("ts", "event_id")).alias("close"))
        .select("structure", F.lit(0).alias("vintage"), "date", (F.col("close") - 35).alias("close"))
    )
