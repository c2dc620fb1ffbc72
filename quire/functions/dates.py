"""Dates of the form D:YYYYMMDDHHmmSS+HH'mm' as structs and timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_pdf_date(text: Column) -> Column:
    """The parts as they stand, without a check of their ranges; null without a year.

    Later parts may be missing: month and day count as 1, times as 0, the zone as Z.
    """
    body = F.regexp_replace(text, r"^D:", "")

    def part(start: int, size: int, default: int | None) -> Column:
        got = F.substring(body, start, size)
        return F.coalesce(F.when(got.rlike(rf"^\+?[0-9]{{1,{size}}}$"), got.try_cast("int")), F.lit(default).cast("int"))

    zone = F.regexp_replace(F.substring(body, 15, 1_000), "'", "")
    sign = F.substring(zone, 1, 1)
    offset = sign.isin("+", "-")
    hour, minute = (F.when(offset, F.coalesce(F.substring(zone, at, 2).try_cast("int"), F.lit(0))).otherwise(0) for at in (2, 4))
    parts = F.struct(
        part(1, 4, None).alias("year"), part(5, 2, 1).alias("month"), part(7, 2, 1).alias("day"), part(9, 2, 0).alias("hour"), part(11, 2, 0).alias("minute"), part(13, 2, 0).alias("second"),
        F.when(offset, sign).otherwise("Z").alias("ut"), hour.alias("ut_hour"), minute.alias("ut_minutes"),
    )
    return F.when((F.length(body) >= 4) & part(1, 4, None).isNotNull() & ((zone == "") | sign.isin("+", "-", "Z")), parts)


def to_timestamp(date: Column) -> Column:
    """UTC timestamp of a parsed date, null if a part is out of range."""
    local = F.try_make_timestamp(date["year"], date["month"], date["day"], date["hour"], date["minute"], date["second"].cast("decimal(8,6)"), F.lit("UTC"))
    minutes = date["ut_hour"] * 60 + date["ut_minutes"]
    return local - F.make_dt_interval(mins=F.when(date["ut"] == "+", minutes).when(date["ut"] == "-", -minutes).otherwise(0))


def to_pdf_string(date: Column) -> Column:
    head = F.format_string("D:%04d%02d%02d%02d%02d%02d", date["year"], date["month"], date["day"], date["hour"], date["minute"], date["second"])
    return F.when(date["ut"] == "Z", F.concat(head, F.lit("Z"))).otherwise(F.concat(head, date["ut"], F.format_string("%02d'%02d'", date["ut_hour"], date["ut_minutes"])))


def pdf_date_of(ts: Column) -> Column:
    """The date string of a timestamp in the session's zone, stated as UTC."""
    return F.concat(F.lit("D:"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit("Z"))
