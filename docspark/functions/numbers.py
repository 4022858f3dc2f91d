"""Numbers and dates as the engine prints them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole numbers below this are exact in a double.
EXACT = 9007199254740992


def float_text(x: Column) -> Column:
    """The shortest text that reads back as the same double, never with an exponent."""
    plain = F.call_function("format_number", x, F.lit("0." + "#" * 330))
    plain = F.replace(plain, F.lit(","), F.lit(""))
    return F.when(F.isnan(x), F.lit("NaN")).when(x == float("inf"), F.lit("inf")).when(x == float("-inf"), F.lit("-inf")).otherwise(plain)


def json_number(x: Column) -> Column:
    """A whole number as an integer while doubles hold every integer, another finite one as the shortest decimal, else null.

    A whole number beyond EXACT keeps a point; from 1e16 on and below 1e-5 numbers have an exponent.
    """
    size, whole = F.abs(x), x == F.floor(x)
    plain = float_text(x)
    power = F.lower(F.replace(x.cast("string"), F.lit(".0E"), F.lit("E")))
    return (
        F.when(F.isnan(x) | (size == float("inf")), F.lit("null"))
        .when(whole & (size < EXACT), x.cast("long").cast("string"))
        .when((size >= 1e16) | (size < 1e-5), power)
        .when(whole, F.concat(plain, F.lit(".0")))
        .otherwise(plain)
    )


def json_text(text: Column) -> Column:
    """A JSON string with the usual escapes."""
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)
