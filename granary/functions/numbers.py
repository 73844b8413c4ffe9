"""Numeric functions that raise, round or count as the standard has it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _raise(message: str) -> Column:
    return F.raise_error(F.lit(message)).cast("double")


def div(a: Column, b: Column) -> Column:
    """Integer division, truncating; division by zero fails."""
    q = F.abs(a) - F.pmod(F.abs(a), F.abs(b))
    return ((q / F.abs(b)) * F.signum(a) * F.signum(b)).cast("long")


def trunc(x: Column, digits: int = 0) -> Column:
    scale = 10.0**digits
    return F.when(x < 0, F.ceil(x * scale)).otherwise(F.floor(x * scale)) / scale


def sqrt(x: Column) -> Column:
    return F.when(x < 0, _raise("cannot take square root of a negative number")).otherwise(F.sqrt(x))


def ln(x: Column) -> Column:
    return F.when(x <= 0, _raise("cannot take logarithm of zero or a negative number")).otherwise(F.ln(x))


def log10(x: Column) -> Column:
    return F.when(x <= 0, _raise("cannot take logarithm of zero or a negative number")).otherwise(F.log10(x))


def power(a: Column, b: Column) -> Column:
    result = F.pow(a, b)
    bad = ((a == 0) & (b < 0)) | ((a < 0) & (b != F.floor(b)))
    return F.when(bad, _raise("invalid argument for power function")).when(F.isnan(result) | (F.abs(result) == float("inf")), _raise("value out of range: overflow")).otherwise(result)


def factorial(n: Column) -> Column:
    """n! as decimal(38,0), up to 33."""
    return F.aggregate(F.when(n > 0, F.sequence(F.lit(1), n.cast("int"))).otherwise(F.array(F.lit(1))), F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))


def _exact(x: Column, cases: dict[float, float], otherwise: Column) -> Column:
    out = F.when(F.lit(False), F.lit(0.0))
    for degrees, value in cases.items():
        out = out.when(x == degrees, value)
    return out.otherwise(otherwise)


def sind(x: Column) -> Column:
    """Sine of degrees, exact at multiples of 30."""
    return _exact(F.pmod(x, F.lit(360.0)), {0: 0.0, 30: 0.5, 90: 1.0, 150: 0.5, 180: 0.0, 210: -0.5, 270: -1.0, 330: -0.5}, F.sin(F.radians(x)))


def cosd(x: Column) -> Column:
    return sind(x + 90.0)


def tand(x: Column) -> Column:
    return _exact(F.pmod(x, F.lit(180.0)), {0: 0.0, 45: 1.0, 90: float("inf"), 135: -1.0}, sind(x) / cosd(x))


def cotd(x: Column) -> Column:
    return tand(90.0 - x)


def asind(x: Column) -> Column:
    return _exact(x, {-1: -90.0, -0.5: -30.0, 0: 0.0, 0.5: 30.0, 1: 90.0}, F.degrees(F.asin(x)))


def acosd(x: Column) -> Column:
    return 90.0 - asind(x)


def atand(x: Column) -> Column:
    return _exact(x, {-1: -45.0, 0: 0.0, 1: 45.0}, F.degrees(F.atan(x)))


def generate_series(start: Column, stop: Column, step: Column | None = None) -> Column:
    """The series as an array (for explode); empty where the step leads away from stop."""
    step = F.lit(1) if step is None else step
    reachable = ((step > 0) & (start <= stop)) | ((step < 0) & (start >= stop))
    zero = F.raise_error(F.lit("step size cannot equal zero")).cast("array<bigint>")
    return F.when(step == 0, zero).when(reachable, F.sequence(start.cast("long"), stop.cast("long"), step.cast("long"))).otherwise(F.array().cast("array<bigint>"))


def atan2d(y: Column, x: Column) -> Column:
    """Angle of a point in degrees, exact on the axes and diagonals."""
    return F.when(F.abs(y) == F.abs(x), F.round(F.degrees(F.atan2(y, x)), 0)).when((x == 0) | (y == 0), F.round(F.degrees(F.atan2(y, x)), 0)).otherwise(F.degrees(F.atan2(y, x)))


def random(seed: int | None = None) -> Column:
    """random() after setseed(seed): numbers from 0 to 1; a seed repeats for the same partitions."""
    return F.rand(seed) if seed is not None else F.rand()


def normal_rand(spark, n: int, mean: float, deviation: float, seed: int | None = None):
    """normal_rand: n rows of normally distributed numbers."""
    return spark.range(n).select((F.randn(seed) * deviation + mean).alias("normal_rand"))
