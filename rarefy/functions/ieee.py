"""IEEE and NumPy semantics for Spark expressions, whatever the session's ANSI setting.

SQL raises or returns NULL where NumPy returns infinities or NaN, orders NaN above everything and
treats it as equal to itself. All functions take and return double columns unless they say otherwise.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


# columns need a session, so these are functions: the module must import without one


def inf() -> Column:
    return F.lit(math.inf)


def ninf() -> Column:
    return F.lit(-math.inf)


def nan() -> Column:
    return F.lit(math.nan)


def either_nan(a: Column, b: Column) -> Column:
    return F.isnan(a) | F.isnan(b)


def negative_zero(v: Column) -> Column:
    return (v == 0) & (v.cast("string") == "-0.0")


def signbit(v: Column) -> Column:
    return (v < 0) | negative_zero(v)


def divide(a: Column, b: Column) -> Column:
    sign = F.when((a < 0) != negative_zero(b), ninf()).otherwise(inf())
    by_zero = F.when((a == 0) | F.isnan(a), nan()).otherwise(sign)
    return F.when(b == 0, by_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def _whole(v: Column, f) -> Column:
    # ceil and floor give longs: large, infinite and NaN values are whole already
    fits = F.abs(v) < F.lit(9e15)
    return F.when(fits, f(F.when(fits, v).otherwise(F.lit(0.0))).cast("double")).otherwise(v)


def floor(v: Column) -> Column:
    return _whole(v, F.floor)


def ceil(v: Column) -> Column:
    return _whole(v, F.ceil)


def trunc(v: Column) -> Column:
    return F.when(v < 0, ceil(v)).otherwise(floor(v))


def rint(v: Column) -> Column:
    return F.rint(v)


def round_half_even(v: Column, decimals: int) -> Column:
    if decimals == 0:
        return rint(v)
    scale = F.lit(float(10 ** abs(decimals)))
    scaled = rint(v * scale) / scale if decimals > 0 else rint(v / scale) * scale
    return F.when(F.abs(v) < inf(), scaled).otherwise(v)


def remainder(a: Column, b: Column) -> Column:
    safe = F.when(b == 0, nan()).otherwise(b)
    m = a % safe
    shifted = F.when((m != 0) & ((m < 0) != (safe < 0)), m + safe).otherwise(m)
    infinite = F.when((a < 0) == (b < 0), a).otherwise(F.when(a == 0, a).otherwise(b))
    return F.when(either_nan(a, b) | (b == 0) | (F.abs(a) == inf()), nan()).when(F.abs(b) == inf(), infinite).otherwise(shifted)


def floor_divide(a: Column, b: Column) -> Column:
    # a finite number over an infinite one lies just on one side of zero
    beside = F.when((a == 0) | ((a < 0) == (b < 0)), F.lit(0.0)).otherwise(F.lit(-1.0))
    exact = floor(divide(a - remainder(a, b), b) + F.lit(0.0))
    return F.when(b == 0, divide(a, b)).when((F.abs(b) == inf()) & isfinite(a), beside).otherwise(exact)


def power(a: Column, b: Column) -> Column:
    one = (a == 1) | (b == 0) | ((a == -1) & (F.abs(b) == inf()))
    return F.when(one, F.lit(1.0)).otherwise(F.pow(a, b))


def logarithm(f, v: Column, zero_at: float = 0.0) -> Column:
    at = F.lit(zero_at)
    good = v > at
    return F.when(F.isnan(v), nan()).when(v == at, ninf()).when(v < at, nan()).otherwise(f(F.when(good, v).otherwise(F.lit(1.0))))


def logaddexp(a: Column, b: Column) -> Column:
    return (
        F.when(either_nan(a, b), nan())
        .when(a == b, a + F.lit(math.log(2)))
        .otherwise(F.greatest(a, b) + F.log1p(F.exp(-F.abs(a - b))))
    )


def minimum(a: Column, b: Column) -> Column:
    return F.when(either_nan(a, b), nan()).otherwise(F.least(a, b))


def copysign(a: Column, b: Column) -> Column:
    return F.abs(a) * F.when(signbit(b), F.lit(-1.0)).otherwise(F.lit(1.0))


def sign(v: Column) -> Column:
    return F.when(F.isnan(v), nan()).otherwise(F.signum(v))


def isfinite(v: Column) -> Column:
    return (F.abs(v) < inf()) & ~F.isnan(v)


def equal(a: Column, b: Column) -> Column:
    return (a == b) & ~F.isnan(a)


def greater(a: Column, b: Column) -> Column:
    return (a > b) & ~F.isnan(a)


def greater_equal(a: Column, b: Column) -> Column:
    return (a >= b) & ~either_nan(a, b)
