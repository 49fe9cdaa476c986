"""Offsets around a centre: quadrants, regions, distances and lines, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _wins(own: Column, other: Column, tie: Column) -> Column:
    """own is the larger part, or as large and the tie goes to it."""
    return (own > other) | ((own == other) & tie)


def quadrant(dt: Column, dh: Column, dw: Column) -> Column:
    """1 to 6 for the dominant axis and its sign, 0 at the centre.

    Time (1 before, 2 after) wins its ties. Of the space axes, ties of 3 (dh < 0) and 6 (dw > 0) need the other
    axis's offset to be positive, ties of 4 (dh > 0) and 5 (dw < 0) need it not to be.
    """
    a, b, c = F.abs(dt), F.abs(dh), F.abs(dw)
    t, h, w = dt > 0, dh > 0, dw > 0
    first = (a >= b) & (a >= c)
    return (
        F.when((dt < 0) & first, 1)
        .when((dt > 0) & first, 2)
        .when((dh < 0) & _wins(b, a, t) & _wins(b, c, w), 3)
        .when((dh > 0) & _wins(b, a, ~t) & _wins(b, c, ~w), 4)
        .when((dw < 0) & _wins(c, a, ~t) & _wins(c, b, ~h), 5)
        .when((dw > 0) & _wins(c, a, t) & _wins(c, b, h), 6)
        .otherwise(0)
    )


def region(dt: Column, dh: Column, dw: Column) -> Column:
    """0 to 5: the dominant axis (time before height before width on ties) doubled, plus 1 on its negative side."""
    a, b, c = F.abs(dt), F.abs(dh), F.abs(dw)
    side = lambda x: (x < 0).cast("int")
    return F.when((a >= b) & (a >= c), side(dt)).when((b >= a) & (b >= c), 2 + side(dh)).otherwise(4 + side(dw))


def squared(dt: Column, dh: Column, dw: Column) -> Column:
    return dt * dt + dh * dh + dw * dw


def chebyshev(dt: Column, dh: Column, dw: Column) -> Column:
    return F.greatest(F.abs(dt), F.abs(dh), F.abs(dw))


def offsets(spark: SparkSession, radius: int) -> DataFrame:
    """The cube of offsets: dt, dh, dw, d2, cheb, quadrant, region. (2 radius + 1) cubed rows, so bounded."""
    side = 2 * radius + 1
    cell = spark.range(side**3)
    axis = lambda width: (F.floor(F.col("id") / width) % side - radius).cast("int")
    at = cell.select(axis(side * side).alias("dt"), axis(side).alias("dh"), axis(1).alias("dw"))
    d = [F.col(c) for c in ("dt", "dh", "dw")]
    return at.select(*d, squared(*d).alias("d2"), chebyshev(*d).alias("cheb"), quadrant(*d).alias("quadrant"), region(*d).alias("region"))


def line_to_center(dt: Column, dh: Column, dw: Column) -> Column:
    """The cells strictly between an offset and the centre, as structs (step, dt, dh, dw), nearest the offset first.

    With n the largest part, step k of n moves each axis by round-half-up(|part| k / n) towards the centre.
    """
    n = chebyshev(dt, dh, dw)

    def at(part: Column, k: Column) -> Column:
        moved = F.floor((2 * F.abs(part) * k + n) / (2 * n))
        return (part - F.signum(part) * moved).cast("int")

    steps = F.when(n >= 2, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda k: F.named_struct(F.lit("step"), k, F.lit("dt"), at(dt, k), F.lit("dh"), at(dh, k), F.lit("dw"), at(dw, k)))


def sigmoid(x: Column, limit: float = 20.0) -> Column:
    """1 / (1 + exp(-x)), exactly 0 or 1 beyond the limit."""
    return F.when(x > limit, F.lit(1.0)).when(x < -limit, F.lit(0.0)).otherwise(1.0 / (1.0 + F.exp(-x)))


def brightness_class(value: Column, breaks: tuple[float, ...], bounds: str = "open") -> Column:
    """1, 2, ... by the breaks; 0 for a value on a break where bounds are open; null for null.

    Breaks are compared in single precision, as the values are stored.
    """
    edge = lambda b: F.lit(b).cast("float")
    found = F.when(value.isNull(), F.lit(None).cast("int"))
    for n, (low, high) in enumerate(zip(breaks, breaks[1:], strict=False), 1):
        above = (value > edge(low)) if bounds == "open" or low == float("-inf") else (value >= edge(low))
        found = found.when(above & (value < edge(high)), n)
    return found.otherwise(0)


def day_of(year: Column, doy: Column) -> Column:
    """The date of a day of the year."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), doy.cast("int") - 1)


def days_in(year: Column) -> Column:
    return F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))


def quantised_key(t: Column, h: Column, w: Column, quantum: int) -> Column:
    """t_h_w after whole division by the quantum."""
    return F.concat_ws("_", *[F.floor(c / quantum).cast("int") for c in (t, h, w)])
