"""Season calendar: date scalars, decade arithmetic and calendar tables.

A *decade* is a third of a month. Its ordinal, ``year * 36 + calendar decade - 1``, turns every range,
lag and slice into integer arithmetic, so no calendar table has to be joined to find a period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import PANEL_EPOCH, PANEL_EPOCH_YEAR, SEASON_MONTHS


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _idiv(a: Column, n: int) -> Column:
    """Integer quotient for non-negative operands, kept as INT."""
    return F.floor(a / F.lit(n)).cast("int")


# --- dates -------------------------------------------------------------------------------------

def excel_serial(c) -> Column:
    """Spreadsheet serial day number (1900 system) to timestamp, rounded to milliseconds.

    Serials below 60 precede the phantom 29 February 1900 and count from one day later."""
    v = _c(c).cast("double")
    epoch = F.when(v < 60, F.lit("1899-12-31")).otherwise(F.lit("1899-12-30")).cast("timestamp_ntz")
    return F.timestamp_add("MILLISECOND", F.rint(v * F.lit(86400000.0)).cast("bigint"), epoch)


def survey_date(df: DataFrame, c: str) -> Column:
    """Date cell of a survey sheet: serial number, text or null, decided by the column's type."""
    kind = df.schema[c].dataType.typeName()
    if kind == "string":
        return F.coalesce(excel_serial(F.col(c).try_cast("double")), F.col(c).try_cast("timestamp_ntz"))
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.col(c).cast("timestamp_ntz")
    return excel_serial(c)


def campaign_label_of(year: Column, month: Column) -> Column:
    """``Y-Y+1`` from October on, ``Y-1-Y`` until July, NULL in August and September."""
    year = year.cast("int")
    return (
        F.when(month >= 10, F.concat_ws("-", year.cast("string"), (year + 1).cast("string")))
        .when(month <= 7, F.concat_ws("-", (year - 1).cast("string"), year.cast("string")))
    )


def campaign_label(d) -> Column:
    d = _c(d)
    return campaign_label_of(F.year(d), F.month(d))


def decade_intra(d) -> Column:
    """Third of the month, 1..3."""
    return F.least(F.lit(3), _idiv(F.dayofmonth(_c(d)) - 1, 10) + 1)


def campaign_decade_of(month: Column, part: Column) -> Column:
    """Decade of the season, 1..30, NULL in August and September."""
    return F.when((month >= 10) | (month <= 7), F.pmod(month - 10, F.lit(12)) * 3 + part).cast("int")


def campaign_decade(d) -> Column:
    d = _c(d)
    return campaign_decade_of(F.month(d), decade_intra(d))


def calendar_decade(d) -> Column:
    """Decade of the civil year, 1..36."""
    d = _c(d)
    return (F.month(d) - 1) * 3 + decade_intra(d)


def decade_ordinal(d) -> Column:
    d = _c(d)
    return F.year(d) * 36 + calendar_decade(d) - 1


def decade_start_of(year: Column, month: Column, part: Column) -> Column:
    return F.make_date(year, month, (part - 1) * 10 + 1)


def decade_end_of(year: Column, month: Column, part: Column) -> Column:
    return F.when(part == 3, F.last_day(F.make_date(year, month, F.lit(21)))).otherwise(
        F.make_date(year, month, F.least(part * 10, F.lit(20))))


def campaign_start_year(c) -> Column:
    return F.split_part(_c(c), F.lit("-"), F.lit(1)).cast("int")


def campaign_ordinal(campaign, decade) -> Column:
    """Ordinal of (campaign, season decade): October D1 of the start year is calendar decade 28."""
    return campaign_start_year(campaign) * 36 + 27 + _c(decade) - 1


def campaign_date(campaign, decade) -> Column:
    """First day of (campaign, season decade)."""
    y, m0 = campaign_start_year(campaign), _idiv(_c(decade) - 1, 3) + 9
    return F.make_date(y + _idiv(m0, 12), F.pmod(m0, F.lit(12)) + 1, F.pmod(_c(decade) - 1, F.lit(3)) * 10 + 1)


def panel_date(campaign, decade) -> Column:
    """Gap-free synthetic date: ten days per season decade since the panel epoch."""
    k = (campaign_start_year(campaign) - PANEL_EPOCH_YEAR) * 30 + _c(decade) - 1
    return F.date_add(F.lit(PANEL_EPOCH).cast("date"), (k * 10).cast("int"))


def campaign_month(decade) -> Column:
    return _idiv(_c(decade) - 1, 3) + 1


def climatology_key(month, part) -> Column:
    """One of the 36 decades of a year as ``month * 10 + part``."""
    return _c(month) * 10 + _c(part)


def with_climatology_parts(df: DataFrame, key: str = "doy_id") -> DataFrame:
    k = F.col(key)
    return df.withColumns({"month": _idiv(k, 10), "decade_part": F.pmod(k, F.lit(10)).cast("int")}).drop(key)


# --- decade rows -------------------------------------------------------------------------------

def decade_fields(ordinal) -> dict[str, Column]:
    """All calendar attributes of a decade ordinal, as named columns."""
    o = _c(ordinal)
    year, cal = _idiv(o, 36), F.pmod(o, F.lit(36)).cast("int") + 1
    month, part = _idiv(cal - 1, 3) + 1, F.pmod(cal - 1, F.lit(3)) + 1
    start, end = decade_start_of(year, month, part), decade_end_of(year, month, part)
    return {
        "year": year, "month": month, "decade_part": part, "date_start": start, "date_end": end,
        "midpoint": F.date_add(start, _idiv(F.datediff(end, start), 2)),
        "campaign": campaign_label_of(year, month), "cal_decade": cal,
        "decade_num": campaign_decade_of(month, part), "decade_id": year * 100 + cal,
    }


def with_decade_fields(df: DataFrame, ordinal: str = "decade_ord") -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in decade_fields(ordinal).items()])


def ordinals(lo: Column, hi: Column) -> Column:
    """Explodable run of decade ordinals, both ends included."""
    return F.sequence(lo.cast("int"), hi.cast("int"))


def is_season(month: Column) -> Column:
    return month.isin(*SEASON_MONTHS)


def range_calendar(spark: SparkSession, year_start: int, decade_start: int, year_end: int, decade_end: int) -> DataFrame:
    """Every calendar decade (1..36) between two bounds, both included."""
    lo, hi = year_start * 36 + decade_start - 1, year_end * 36 + decade_end
    return with_decade_fields(spark.range(lo, hi).select(F.col("id").cast("int").alias("decade_ord")))


def season_calendar(spark: SparkSession, years) -> DataFrame:
    """The 30 season decades of each civil year; ``legacy_decade_id`` is ``year * 100 + season decade``."""
    ys = F.array(*[F.lit(int(y)) for y in years])
    rows = (spark.range(1).select(F.explode(ys).alias("y"))
            .select(F.explode(ordinals(F.col("y") * 36, F.col("y") * 36 + 35)).alias("decade_ord")))
    return (with_decade_fields(rows).filter(is_season(F.col("month")))
            .withColumn("legacy_decade_id", F.col("year") * 100 + F.col("decade_num")))


def with_window(calendar: DataFrame, lead: int, lag: int) -> DataFrame:
    """Acquisition window of each decade: ``[start - lead, end + lag)``."""
    return calendar.withColumns({
        "window_start": F.date_sub("date_start", lead), "window_end": F.date_add("date_end", lag)})


def window_ordinals(day, lead: int, lag: int) -> Column:
    """Decades whose window ``[start - lead, end + lag)`` contains ``day`` (at most a handful).

    A decade qualifies when it ends after ``day - lag`` and starts by ``day + lead``; both are decade
    ordinals of shifted days, so a range join becomes an explode plus an equi-join."""
    d = _c(day)
    return ordinals(decade_ordinal(F.date_sub(d, lag - 1)), decade_ordinal(F.date_add(d, lead)))


# --- slices ------------------------------------------------------------------------------------

def month_bounds(month: str, buffer: int = 2) -> tuple[int, int]:
    """Ordinals of ``YYYY-MM`` extended backwards by ``buffer`` decades."""
    try:
        y, m = (int(p) for p in month.split("-"))
    except ValueError:
        raise ValueError(f"month must look like YYYY-MM, got {month!r}") from None
    if not 1 <= m <= 12:
        raise ValueError(f"month out of range: {m}")
    hi = y * 36 + m * 3 - 1
    return hi - 2 - buffer, hi


def range_bounds(text: str) -> tuple[int, int]:
    """Ordinals of ``YYYY-DD:YYYY-DD`` with decades 1..36."""
    try:
        (y0, d0), (y1, d1) = (tuple(int(p) for p in side.split("-")) for side in text.split(":"))
    except ValueError:
        raise ValueError(f"range must look like YYYY-DD:YYYY-DD, got {text!r}") from None
    if not (1 <= d0 <= 36 and 1 <= d1 <= 36):
        raise ValueError(f"decade out of range in {text!r}")
    return y0 * 36 + d0 - 1, y1 * 36 + d1 - 1


def slice_month(df: DataFrame, month: str, buffer: int = 2, ordinal: str = "decade_ord") -> DataFrame:
    return df.filter(F.col(ordinal).between(*month_bounds(month, buffer)))


def slice_range(df: DataFrame, text: str, ordinal: str = "decade_ord") -> DataFrame:
    return df.filter(F.col(ordinal).between(*range_bounds(text)))


def with_year_batch(df: DataFrame, year: str, n: int) -> DataFrame:
    """Batch number of each row when the sorted distinct years are cut into runs of ``n``.

    The set of years is bounded by the calendar, so it travels as one small array."""
    years = df.agg(F.sort_array(F.collect_set(year)).alias("ys")).scalar()
    return df.withColumn("year_batch", _idiv(F.array_position(years, F.col(year)).cast("int") - 1, n))
