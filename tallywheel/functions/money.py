"""Exact money: nano-USD integers as column expressions. No value passes through a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

U64_MAX = 18446744073709551615
NANOS = 1_000_000_000
_JSON_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"


def parse_nanos(text: Column) -> Column:
    """struct(nanos decimal(20,0), error string) of a JSON decimal in USD; exactly one of the two is set.

    error: invalid, negative, too_precise (a fraction of a nano-USD) or out_of_range (beyond an unsigned 64-bit count).
    """
    number = F.when(text.rlike(_JSON_NUMBER), text)
    wide = number.try_cast("decimal(38,18)")
    scaled = wide * F.lit(NANOS).cast("decimal(10,0)")
    plain = F.regexp_extract(number, r"\.([0-9]+?)0*$", 1)
    small = number.try_cast("double")
    lost = ((wide == 0) & (small != 0)) | (scaled != F.floor(scaled)) | (~number.rlike("[eE]") & (F.length(plain) > 9))
    error = (
        F.when(number.isNull(), "invalid")
        .when(number.startswith("-") & (small != 0), "negative")
        .when(wide.isNull() | (scaled > F.lit(str(U64_MAX)).cast("decimal(20,0)")), "out_of_range")
        .when(lost, "too_precise")
    )
    return F.struct(F.when(error.isNull(), scaled.try_cast("decimal(20,0)")).alias("nanos"), error.alias("error"))


def usd_text(nanos: Column) -> Column:
    """The shortest exact decimal text: 120000000 is 0.12, 3000000000 is 3."""
    whole, part = nanos - nanos % NANOS, nanos % NANOS
    digits = F.rtrim(F.lpad(part.cast("string"), 9, "0"), F.lit("0"))
    head = (whole / NANOS).cast("decimal(38,0)").cast("string")
    return F.when(part == 0, head).otherwise(F.concat(head, F.lit("."), digits))


def format_usd(nanos: Column, sign: str = "$") -> Column:
    """For people: rounded half up to micro-USD, two decimals at least."""
    micros = F.expr("0").cast("long") + F.floor((nanos + 500) / 1000)
    digits = F.lpad((micros % 1_000_000).cast("string"), 6, "0")
    tail = F.concat(F.substring(digits, 1, 2), F.rtrim(F.substring(digits, 3, 4), F.lit("0")))
    return F.concat(F.lit(sign), F.floor(micros / 1_000_000).cast("string"), F.lit("."), tail)


def ratio_percent(numerator: Column, denominator: Column) -> Column:
    """A share in percent with two decimals, cut (not rounded); N/A where there is nothing to divide by."""
    part = F.floor(numerator.cast("decimal(30,0)") * 10_000 / denominator.cast("decimal(30,0)"))
    text = F.concat(F.floor(part / 100).cast("string"), F.lit("."), F.lpad((part % 100).cast("string"), 2, "0"), F.lit("%"))
    return F.when(denominator > 0, text).otherwise("N/A")


def thousands(count: Column) -> Column:
    return F.format_number(count, 0)


def add_exact(*parts: Column) -> Column:
    """The sum of counters as decimal(21,0); null beyond an unsigned 64-bit total."""
    total = sum((p.cast("decimal(20,0)") for p in parts[1:]), parts[0].cast("decimal(20,0)"))
    return F.when(total <= F.lit(str(U64_MAX)).cast("decimal(20,0)"), total.cast("decimal(21,0)"))


def add_saturating(a: Column, b: Column) -> Column:
    return F.least(a.cast("decimal(21,0)") + b.cast("decimal(21,0)"), F.lit(str(U64_MAX)).cast("decimal(21,0)"))
