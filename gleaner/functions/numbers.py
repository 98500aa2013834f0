"""Number formatting and small arithmetic on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(x: Column, digits: int) -> Column:
    """Fixed decimals of the exact binary value. Ties, which ECMAScript rounds up and the JVM to even, are the callers' to mend."""
    return F.replace(F.format_number(x.cast("double"), digits), F.lit(","), F.lit(""))


def rating_text(x: Column) -> Column:
    """One decimal. A tie needs a fraction of a quarter: x.25 goes up."""
    return fixed(F.when(F.pmod(x * 100, F.lit(100)) == 25, x + 0.05).when(F.pmod(x * 100, F.lit(100)) == 75, x + 0.05).otherwise(x), 1)


def _thousands(n: Column, digits: int) -> Column:
    n = n.cast("long")
    if digits:
        n = F.when(n % 1000 == 250, n + 50).otherwise(n)
    else:
        n = F.when(n % 2000 == 500, n + 500).otherwise(n)
    return F.concat(fixed(n / 1000.0, digits), F.lit("k"))


def count_header(n: Column) -> Column:
    """999, 1.3k, 11k."""
    return F.when(n >= 10000, _thousands(n, 0)).when(n >= 1000, _thousands(n, 1)).otherwise(n.cast("long").cast("string"))


def count_sheet(n: Column) -> Column:
    """999, 1.3k, 10.5k."""
    return F.when(n >= 1000, _thousands(n, 1)).otherwise(n.cast("long").cast("string"))


def price_marks(level: Column, of: int = 4) -> tuple[Column, Column]:
    """The marks of a price level and those missing to the highest."""
    return F.repeat(F.lit("$"), level.cast("int")), F.repeat(F.lit("$"), (F.lit(of) - level).cast("int"))


def radius(zoom: Column) -> Column:
    """Metres that a map at a zoom level (null: 14) is searched around its centre."""
    return F.greatest(F.lit(300), F.least(F.lit(50000), F.floor(40000 / F.pow(F.lit(2.0), F.coalesce(zoom, F.lit(14)) - 10) + 0.5))).cast("int")


def clamp(i: Column, n: Column) -> Column:
    """An index within 0 .. n - 1."""
    return F.greatest(F.lit(0), F.least(n - 1, i))


def parse_float(x: Column) -> Column:
    """The number that a text starts with; NaN if it starts with none, null if null."""
    head = F.regexp_extract(x, r"\A\s*([+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?))", 1)
    return F.when(x.isNotNull(), F.coalesce(F.when(head != "", head).try_cast("double"), F.lit(float("nan"))))


def gesture(dx: Column, dy: Column) -> Column:
    """close for a long downward swipe, prev and next for sideways ones, else none."""
    return F.when((F.abs(dy) > F.abs(dx)) & (dy > 100), "close").when(dx > 60, "prev").when(dx < -60, "next").otherwise("none")


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Metres on a sphere with the earth's mean radius."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * 6371008.8 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
