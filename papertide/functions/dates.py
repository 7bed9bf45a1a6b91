"""Bibliographic dates: free-text years, months, seasons and ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
#: The month that stands for a season; fixed values.
SEASONS = {"spring": "03", "summer": "06", "fall": "09", "autumn": "09", "winter": "12"}


def month_number(raw: Column) -> Column:
    """Two digits of a month's name or number; of a range, its first month; else null."""
    first = F.lower(F.regexp_extract(F.trim(F.coalesce(raw, F.lit(""))), r"^([A-Za-z]+|\d{1,2}(?!\d))", 1))
    named = F.array_position(F.array(*map(F.lit, MONTHS)), F.substring(first, 1, 3))
    number = F.when(first.rlike("^[a-z]{3,}$") & (named > 0), named).when(first.rlike(r"^\d+$"), F.try_to_number(first, F.lit("99")).cast("int"))
    return F.when(number.between(1, 12), F.lpad(number.cast("string"), 2, "0"))


def free_date(text: Column) -> Column:
    """(pub_date, year, date_precision) of a free-text date such as `2020 Spring` or `2019 Nov-Dec`."""
    clean = F.trim(F.coalesce(text, F.lit("")))
    year, rest = F.regexp_extract(clean, r"^(\d{4})", 1), F.trim(F.substring(clean, 5, 1 << 20))
    season = F.coalesce(*[F.when(F.contains(F.lower(rest), F.lit(k)), v) for k, v in SEASONS.items()])
    month = F.coalesce(season, month_number(rest))
    date = F.when(year != "", F.concat(year, F.lit("-"), F.coalesce(month, F.lit("01")), F.lit("-01"))).otherwise("")
    precision = F.when(year == "", "unknown").when(rest == "", "year").when(month.isNotNull(), "month").otherwise("unknown")
    return F.struct(date.alias("pub_date"), F.coalesce(F.try_to_number(year, F.lit("9999")).cast("int"), F.lit(0)).alias("year"), precision.alias("date_precision"))


def parts_date(year: Column, month: Column, day: Column, free: Column) -> Column:
    """(pub_date, year, date_precision) of a date in parts; without a year the free text decides."""
    y, m = F.trim(F.coalesce(year, F.lit(""))), month_number(month)
    d = F.trim(F.coalesce(day, F.lit("")))
    sharp = m.isNotNull() & d.rlike(r"^\d{1,2}$")
    whole = F.struct(
        F.concat_ws("-", y, F.coalesce(m, F.lit("01")), F.when(sharp, F.lpad(d, 2, "0")).otherwise("01")).alias("pub_date"),
        F.try_to_number(y, F.lit("9999")).cast("int").alias("year"),
        F.when(sharp, "day").when(m.isNotNull(), "month").otherwise("year").alias("date_precision"),
    )
    return F.when(y.rlike(r"^\d{4}$"), whole).otherwise(free_date(free))
