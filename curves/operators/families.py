"""Contract families from raw bars: cleaning, expiry years, and synthetic spreads."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StructType

from curves.functions import vocab as V
from curves.functions.joins import fits
from curves.functions.storage import stored

CONTRACT = ["instrument_id", "symbol"]


def parsed(raw: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    """The bars whose symbol fits the pattern, with its groups as columns."""
    return _with_groups(raw.filter(F.col("symbol").rlike(pattern)), pattern, names)


def _with_groups(rows: DataFrame, pattern: str, names: list[str]) -> DataFrame:
    return rows.withColumns({n: F.regexp_extract("symbol", pattern, i + 1) for i, n in enumerate(names)})


#: Makes the bars of a feed whose order's first number is among those given, as (number), -1 for null.
At = Callable[[DataFrame], DataFrame]

#: Pairs of a date and a symbol up to which their first places are broadcast: a date, a name and a number each.
MOST_PAIRS = 1_000_000


def _foremost(raw: DataFrame, order: str, pattern: str | None = None, at: At | None = None) -> DataFrame:
    """raw without most bars that aren't the first of their date and symbol, and without symbols that don't fit the pattern: only
    those at the least value of the order's first number, which is null if there is one without it, stay, and are written.
    That value is found by hashing, so no task sorts its bars, which min_by over a struct would do, and the pattern is tried
    once a pair. `at` spares the second pass the bars that are at no such value. With more than MOST_PAIRS pairs all bars that fit stay."""
    fitting = lambda rows: rows if pattern is None else rows.filter(F.col("symbol").rlike(pattern))
    kind = raw.schema[order].dataType
    lead, kind = (F.col(f"{order}.`{kind[0].name}`"), kind[0].dataType) if isinstance(kind, StructType) else (F.col(order), kind)
    if not isinstance(kind, IntegralType):
        return fitting(raw)
    least = F.when(F.count_if(lead.isNull()) == 0, F.min(lead)).alias("first")
    firsts = fitting(stored(raw.groupBy("date", "symbol").agg(least))).toDF("__date", "__symbol", "__first")
    if not fits(firsts, MOST_PAIRS):
        return fitting(raw)
    near = raw if at is None else at(firsts.select(F.coalesce("__first", F.lit(-1)).alias("number")).distinct()).select(*raw.columns)
    pair = F.col("date").eqNullSafe(F.col("__date")) & F.col("symbol").eqNullSafe(F.col("__symbol")) & lead.eqNullSafe(F.col("__first"))
    return stored(near.join(F.broadcast(firsts), pair, "left_semi"))


def dedup_clean(raw: DataFrame, order: str = "ingest_seq", pattern: str | None = None, at: At | None = None) -> DataFrame:
    """The first bar of each date and symbol in feed order; then those with high below low go, and constant columns. pattern: of
    the symbols asked for. at: how to make some of the feed only, here and below."""
    raw = _foremost(raw, order, pattern, at)
    kept = [c for c in raw.columns if c not in ("date", "symbol", "rtype", "publisher_id", order)]
    first = raw.groupBy("date", "symbol").agg(F.min_by(F.struct(*kept), F.struct(order)).alias("__first"))
    return first.select("*", "__first.*").drop("__first").filter("high >= low").select(*[c for c in raw.columns if c not in ("rtype", "publisher_id", order)])


def last_12_months(frame: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The rows of each contract's final 12 calendar months."""
    last = F.max("date").over(Window.partitionBy(*(keys or CONTRACT)))
    return frame.withColumn("__last", last).filter(F.col("date") >= F.add_months("__last", -12)).drop("__last")


def basic_clean(raw: DataFrame) -> DataFrame:
    return last_12_months(dedup_clean(raw))


def _family(raw: DataFrame, pattern: str, names: list[str], trim: bool = True, deduped: bool = False, at: At | None = None) -> DataFrame:
    """The clean bars of a family with each contract's last trade date as __last, which trimming doesn't change."""
    rows = parsed(raw, pattern, names) if deduped else _with_groups(dedup_clean(raw, pattern=pattern, at=at), pattern, names)
    rows = rows.withColumn("__last", F.max("date").over(Window.partitionBy(*CONTRACT)))
    return rows.filter(F.col("date") >= F.add_months("__last", -12)) if trim else rows


def expiry_year(month: Column, token: Column, last: Column) -> Column:
    """Full year of a year token: 10 and above is 2000 + n; a single digit is the first year ending in it whose
    contract month doesn't begin before the last trade date."""
    base = F.year(last) - F.year(last) % 10 + token
    fits = [F.when(F.make_date(base + k, month, F.lit(1)) >= last, base + k) for k in (-10, 0, 10)]
    return F.when(token >= 10, token + 2000).otherwise(F.coalesce(*fits, base + 20))


def far_year(month: Column, token: Column, near_year: Column, near_month: Column) -> Column:
    """The same for a far leg: the first year that puts it after the near leg."""
    base = near_year - near_year % 10 + token
    after = near_year * 12 + near_month
    fits = [F.when((base + k) * 12 + month > after, base + k) for k in (-10, 0, 10)]
    return F.when(token >= 10, token + 2000).otherwise(F.coalesce(*fits, base + 20))


def with_expiry(frame: DataFrame, month: str, token: str, out: str) -> DataFrame:
    """frame, which has __last, with the year of a leg."""
    return frame.withColumn(out, expiry_year(F.col(month), F.col(token), F.col("__last")))


def _numbers(frame: DataFrame, *legs: str) -> DataFrame:
    """Month numbers and year tokens of legs, named by their prefix."""
    for p in legs:
        frame = frame.withColumn(f"{p}month", V.month_number(F.col(f"{p}month_code"))).withColumn(f"{p}year_digit", F.col(f"{p}year_digit").cast("int"))
    return frame


def _label(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def outrights(raw: DataFrame, trim: bool = True, deduped: bool = False, at: At | None = None) -> DataFrame:
    """deduped, here and below: whether raw went through dedup_clean already."""
    rows = _numbers(_family(raw, V.OUTRIGHT, ["month_code", "year_digit"], trim, deduped, at), "")
    rows = with_expiry(rows, "month", "year_digit", "expiry_year").drop("__last")
    return rows.withColumn("contract", _label("CL", F.col("month_code"), F.col("expiry_year")))


def calendars(raw: DataFrame, deduped: bool = False, at: At | None = None) -> DataFrame:
    names = ["near_month_code", "near_year_digit", "far_month_code", "far_year_digit"]
    rows = _numbers(_family(raw, V.CALENDAR, names, deduped=deduped, at=at), "near_", "far_")
    rows = with_expiry(rows, "near_month", "near_year_digit", "near_year").drop("__last")
    rows = rows.withColumn("far_year", far_year(F.col("far_month"), F.col("far_year_digit"), F.col("near_year"), F.col("near_month")))
    return rows.withColumn("contract", _label("CL", F.col("near_month_code"), F.col("near_year"), "-CL", F.col("far_month_code"), F.col("far_year")))


def cracks(raw: DataFrame, deduped: bool = False, at: At | None = None) -> DataFrame:
    rows = _numbers(_family(raw, V.CRACK, ["product", "month_code", "year_digit"], deduped=deduped, at=at), "")
    rows = with_expiry(rows, "month", "year_digit", "expiry_year").drop("__last")
    return rows.withColumn("contract", _label("CL:C1 ", F.col("product"), "-CL ", F.col("month_code"), F.col("expiry_year")))


def brent_wti(raw: DataFrame, deduped: bool = False, at: At | None = None) -> DataFrame:
    """Brent minus WTI: the listed WTI minus Brent bars negated, high and low swapped."""
    names = ["wti_month_code", "wti_year_digit", "brent_month_code", "brent_year_digit"]
    rows = _numbers(_family(raw, V.BRENT, names, deduped=deduped, at=at), "wti_", "brent_")
    rows = with_expiry(with_expiry(rows, "wti_month", "wti_year_digit", "wti_year"), "brent_month", "brent_year_digit", "brent_year").drop("__last")
    rows = rows.withColumns({"open": -F.col("open"), "high": -F.col("low"), "low": -F.col("high"), "close": -F.col("close")})
    return rows.withColumn("contract", _label("CL", F.col("wti_month_code"), F.col("wti_year"), "-BZ", F.col("brent_month_code"), F.col("brent_year")))


def with_later(legs: DataFrame, gaps: Iterable[int]) -> DataFrame:
    """legs with `later_<gap>` for each gap: the closes, on the same date, of the contract so many months later.

    All gaps are frames of one window by date, so the legs are shuffled and sorted once for all spreads and butterflies,
    where joins would shuffle both sides of each. A date has the contracts of a few years.
    """
    at = Window.partitionBy("date").orderBy(F.col("expiry_year") * 12 + F.col("month"))
    return legs.withColumns({f"later_{g}": F.collect_list(F.struct("close")).over(at.rangeBetween(g, g)) for g in gaps})


def _later(legs: DataFrame, *gaps: int) -> DataFrame:
    missing = [g for g in gaps if f"later_{g}" not in legs.columns]
    return with_later(legs, missing) if missing else legs


def calendar_spread(legs: DataFrame, gap: int, name: str, trim: bool = True) -> DataFrame:
    """Near minus far outright, the far one `gap` months later, on dates when both traded."""
    out = _later(legs, gap).select(
        "date", V.shift_contract(F.col("month"), F.col("expiry_year"), gap).alias("far_contract"),
        F.col("contract").alias("near_contract"), F.col("close").alias("near_close"), F.col("month").alias("near_month"),
        F.col("month_code").alias("near_month_code"), F.col("expiry_year").alias("near_year"), F.explode(f"later_{gap}.close").alias("far_close"),
    ).withColumns(
        {
            "close": F.col("near_close") - F.col("far_close"),
            "contract": F.concat("near_contract", F.lit("-"), "far_contract"),
            "structure": F.lit(name), "gap_months": F.lit(gap), "n_legs": F.lit(2),
        }
    )
    return last_12_months(out, ["contract"]) if trim else out


def flies(legs: DataFrame, name: str = "fly", trim: bool = True, months: tuple[str, ...] = V.FLY_MONTHS) -> DataFrame:
    """Same-month butterflies over three consecutive years."""
    later = lambda k: _label("CL", F.col("month_code"), F.col("expiry_year") + k)
    front = _later(legs, 12, 24).filter(F.col("month_code").isin(*months)).select(
        "date", later(1).alias("mid_contract"), later(2).alias("back_contract"), F.col("contract").alias("front_contract"),
        F.col("close").alias("front_close"), "month", "month_code", F.col("expiry_year").alias("front_year"), "later_24", F.explode("later_12.close").alias("mid_close"),
    )
    out = front.select("*", F.explode("later_24.close").alias("back_close")).drop("later_24").withColumns(
        {
            "close": F.col("front_close") - 2 * F.col("mid_close") + F.col("back_close"),
            "contract": F.concat_ws("-", "front_contract", "mid_contract", "back_contract"),
            "structure": F.lit(name), "n_legs": F.lit(3),
        }
    )
    return last_12_months(out, ["contract"]) if trim else out


def build_all(raw: DataFrame, trim_synthetic: bool = True, at: At | None = None) -> dict[str, DataFrame]:
    """The eight families. The feed is deduplicated once for all listed families; the untrimmed outrights, which are the
    legs of four families and once trimmed the first, are written once, and once again with the later legs' closes."""
    clean = stored(dedup_clean(raw, at=at))
    whole = stored(outrights(clean, trim=False, deduped=True))
    legs = stored(with_later(whole.select("date", "contract", "close", "month", "month_code", "expiry_year"), {*V.TENORS.values(), 12, 24}))
    spreads = {name: calendar_spread(legs, gap, name, trim_synthetic) for name, gap in V.TENORS.items()}
    listed = {name: build(clean, deduped=True) for name, build in (("calendars", calendars), ("cracks", cracks), ("brent_wti", brent_wti))}
    return {"outrights": last_12_months(whole), **listed, **spreads, "flies": flies(legs, trim=trim_synthetic)}


def symbol_family(symbol: Column) -> Column:
    """Family of any symbol of the feed, those that are never parsed included."""
    kinds = (("outright", V.OUTRIGHT), ("calendar", V.CALENDAR), ("crack", V.CRACK), ("brent_wti", V.BRENT), ("micro", "^MCL"),
             ("butterfly", "^CL:BF"), ("brent", "^BZ|^CL:BZ"), ("strip", "^CL:FS|^CL:SA"), ("user_defined", "^UD:"))
    out = F.when(symbol.rlike(kinds[0][1]), kinds[0][0])
    for name, pattern in kinds[1:]:
        out = out.when(symbol.rlike(pattern), name)
    return out.otherwise("other")
