"""Calendar Column factories.  A period is a string with one of three grains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_month(ts: Column) -> Column:
    """``YYYYMM`` by integer arithmetic, which stays in generated code (a formatter does not)."""
    return (F.year(ts) * 100 + F.month(ts)).cast("string")


def month_start(ym: Column) -> Column:
    """First day of a ``YYYYMM`` or ``YYYY-MM`` month."""
    return F.to_date(F.concat(F.replace(ym, F.lit("-"), F.lit("")), F.lit("01")), "yyyyMMdd")


def month_ordinal(ym: Column) -> Column:
    """Months since year 0; differences of it are month distances."""
    bare = F.replace(ym, F.lit("-"), F.lit(""))
    return F.substring(bare, 1, 4).cast("int") * 12 + F.substring(bare, 5, 2).cast("int") - 1


def is_month(ym: Column) -> Column:
    """A readable month in either form; null where there is none."""
    return ym.rlike(r"^[0-9]{4}-?(0[1-9]|1[0-2])$")


def month_list(start: str, end: str) -> Column:
    """Inclusive array of ``YYYYMM`` months."""
    if end < start:
        raise ValueError("empty month window")
    days = F.sequence(month_start(F.lit(start)), month_start(F.lit(end)), F.expr("interval 1 month"))
    return F.transform(days, year_month)


def add_to_month(ym: Column, n: int) -> Column:
    return year_month(F.add_months(month_start(ym), n))


def window_first(latest: Column, length: int) -> Column:
    """First month of a window of ``length`` months ending at ``latest``."""
    return add_to_month(latest, 1 - length)


def grain(period: Column) -> Column:
    return (
        F.when(period.rlike(r"^\d{4}$"), "year")
        .when(period.rlike(r"^\d{4}-?(0[1-9]|1[0-2])$"), "month")
        .when(period.rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"), "day")
    )


def period_start(period: Column) -> Column:
    g = grain(period)
    return (
        F.when(g == "year", F.to_date(F.concat(period, F.lit("-01-01"))))
        .when(g == "month", month_start(period))
        .when(g == "day", F.try_to_date(period, "yyyy-MM-dd"))
    )


def utc_instant(c: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """UTC timestamp of a source text; malformed becomes null."""
    return F.try_to_timestamp(c, F.lit(fmt))


def instant_error(c: Column, file_period: Column, now: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Why an observation time is unacceptable, or null."""
    ts = utc_instant(c, fmt)
    digits = F.date_format(ts, "yyyyMMdd")
    return (
        F.when(ts.isNull(), "malformed")
        .when(ts > now, "future")
        .when(~digits.startswith(F.replace(file_period, F.lit("-"), F.lit(""))), "outside file period")
    )


def millis_date(c: Column) -> Column:
    return F.to_date(F.timestamp_millis(c))


def month_label(ym: Column, names: Sequence[str]) -> Column:
    """``name of year`` for a month; other grains are returned as they are."""
    if len(names) != 12:
        raise ValueError("twelve month names are needed")
    bare = F.replace(ym, F.lit("-"), F.lit(""))
    table = F.array(*[F.lit(n) for n in names])
    name = F.element_at(table, F.substring(bare, 5, 2).cast("int"))
    return F.when(grain(ym) == "month", F.concat(name, F.lit(" de "), F.substring(bare, 1, 4))).otherwise(ym)
