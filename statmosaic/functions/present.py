"""Display texts in the publications' comma locale, and sentences made only of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: texts shown for a cell without a value
STATUS_TEXT = {
    "suppressed": "Suprimido (X)",
    "notApplicable": "Não se aplica (..)",
    "unavailable": "Não disponível (...)",
}
NO_VALUE = "Não disponível"


def comma_number(c: Column, decimals: int = 0) -> Column:
    """``1.234.567,89``: grouping dot, decimal comma."""
    exact = c.cast(f"decimal(38,{decimals})")
    return F.translate(F.format_number(exact, decimals), ",.", ".,")


def comma_trimmed(c: Column, decimals: int = 2) -> Column:
    """Like :func:`comma_number` with at most ``decimals`` places (no trailing zeros)."""
    if decimals == 0:
        return comma_number(c, 0)
    text = F.regexp_replace(comma_number(c, decimals), r"(,\d*?)0+$", "$1")
    return F.regexp_replace(text, r",$", "")


def integer_text(c: Column) -> Column:
    return F.coalesce(comma_number(c, 0), F.lit("—"))


def signed_text(c: Column) -> Column:
    return F.when(c > 0, F.concat(F.lit("+"), comma_number(c, 0))).otherwise(integer_text(c))


def currency_text(c: Column, decimals: int = 2) -> Column:
    return F.when(c < 0, F.concat(F.lit("-R$ "), comma_number(-c, decimals))).otherwise(
        F.concat(F.lit("R$ "), comma_number(c, decimals))
    )


def compact_currency(c: Column) -> Column:
    return (
        F.when(F.abs(c) >= 1e9, F.concat(currency_text(c / 1e9), F.lit(" bi")))
        .when(F.abs(c) >= 1e6, F.concat(currency_text(c / 1e6), F.lit(" mi")))
        .otherwise(currency_text(c))
    )


def percent_text(c: Column) -> Column:
    return F.concat(comma_trimmed(c, 2), F.lit("%"))


def value_text(value: Column, unit: Column) -> Column:
    return (
        F.when(value.isNull(), F.lit(NO_VALUE))
        .when(unit == "R$", currency_text(value, 0))
        .when(unit == "%", percent_text(value))
        .otherwise(F.concat_ws(" ", comma_number(value, 0), F.nullif(unit, F.lit(""))))
    )


def cell_text(value: Column, unit: Column, status: Column) -> Column:
    """What a reader sees: the reason of an absent value, else the value with its unit."""
    out = F.when(status.isNull(), F.lit(NO_VALUE))
    for name, text in STATUS_TEXT.items():
        out = out.when(status == name, F.lit(text))
    return out.otherwise(value_text(value, unit))


def change_sentence(subject: Column, change: Column, start: Column, end: Column) -> Column:
    """Rise, fall or no change between two periods; never a cause."""
    verb = F.when(change > 0, "aumentou").when(change < 0, "diminuiu").otherwise("não variou")
    tail = F.when(change == 0, ".").otherwise(F.concat(F.lit(" "), percent_text(F.abs(change)), F.lit(".")))
    return F.when(
        change.isNull(), F.lit("A variação não está disponível para esta observação.")
    ).otherwise(F.concat(F.lit("Entre "), start, F.lit(" e "), end, F.lit(", "), subject, F.lit(" "), verb, tail))
