"""Reductions: a grouped aggregate over stored cells, corrected for the cells that aren't stored.

Per lane (the cells that reduce to one), c of n cells are stored and n - c have the fill value.
Lanes without a stored cell reduce to the result's fill value and have no row. Aggregates combine
on the map side, so a lane that holds most of a tensor is a row per task in the exchange.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ieee
from ..functions.types import cast, literal, spark_type
from ..tensor import Tensor, names, normalize_axis
from .elementwise import as_tensor, astype, elemwise


def _axes(x: Tensor, axis) -> tuple[int, ...]:
    if axis is None:
        return tuple(range(x.ndim))
    axis = normalize_axis(axis, x.ndim)
    return axis if isinstance(axis, tuple) else (axis,)


def _reduce(x: Tensor, axis, keepdims: bool, aggregates: list[Column], finish, dtype, fill, count: Column | None = None) -> Tensor:
    """finish: from the aggregates' names (s0, s1, …), c and m = n - c to the value of a lane."""
    axes = _axes(x, axis)
    kept = [i for i in range(x.ndim) if i not in axes]
    n = math.prod(x.shape[i] for i in axes)
    named = [a.alias(f"s{k}") for k, a in enumerate(aggregates)]
    grouped = x.df.groupBy(*(f"d{i}" for i in kept)) if kept else x.df.groupBy(F.lit(0).alias("_all"))
    df = grouped.agg((F.count(F.lit(1)) if count is None else count).alias("c"), *named).withColumn("m", F.lit(n) - F.col("c"))
    if keepdims:
        shape = tuple(1 if i in axes else s for i, s in enumerate(x.shape))
        coords = [F.lit(0).cast("long").alias(f"d{i}") if i in axes else F.col(f"d{i}") for i in range(x.ndim)]
    else:
        shape = tuple(x.shape[i] for i in kept)
        coords = [F.col(f"d{i}").alias(f"d{j}") for j, i in enumerate(kept)]
    value = finish(*(F.col(f"s{k}") for k in range(len(aggregates))))
    return Tensor(df.select(*coords, value.alias("v")), shape, fill, dtype, cells=x.cells).pruned()


def _lane_fill(x: Tensor, axis, f) -> np.generic:
    """f over a lane of fill values; lanes are long, so f takes (fill, n)."""
    n = math.prod(x.shape[i] for i in _axes(x, axis))
    with np.errstate(all="ignore"):
        return f(x.fill_value, n)


def _sum_type(dtype: np.dtype, given) -> np.dtype:
    return np.dtype(given) if given is not None else np.sum(np.zeros(1, dtype)).dtype


def _v(x: Tensor, dtype=None) -> Column:
    return cast(F.col("v"), x.dtype, dtype or x.dtype)


def _multiples(m: Column, fill, dtype: np.dtype) -> Column:
    """fill times m, where 0 cells add nothing, not even for NaN."""
    many = m.cast(spark_type(dtype)) * literal(fill, dtype)
    return F.when(m == 0, literal(0, dtype)).otherwise(many)


def sum(x, *, axis=None, dtype=None, keepdims=False) -> Tensor:  # noqa: A001
    x = as_tensor(x)
    out = _sum_type(x.dtype, dtype)
    fill = _lane_fill(x, axis, lambda f, n: out.type(f) * out.type(n) if n else out.type(0))
    if out.kind == "c":
        re, im = float(x.fill_value.real), float(x.fill_value.imag)
        finish = lambda a, b: F.struct((a + F.col("m") * F.lit(re)).alias("re"), (b + F.col("m") * F.lit(im)).alias("im"))
        return _reduce(x, axis, keepdims, [F.sum("v.re"), F.sum("v.im")], finish, out, fill)
    work = np.dtype("float64") if out.kind == "f" else out
    finish = lambda s: (s + _multiples(F.col("m"), x.fill_value, work)).cast(spark_type(out))
    return _reduce(x, axis, keepdims, [F.sum(_v(x, work))], finish, out, fill)


def _powers(m: Column, fill) -> Column:
    fill = F.lit(float(fill))
    return F.when(m == 0, F.lit(1.0)).otherwise(ieee.power(fill, m.cast("double")))


def prod(x, *, axis=None, dtype=None, keepdims=False) -> Tensor:
    """Products of floats are aggregated by Spark; those of integers are exact and wrap as NumPy's do, batch by batch."""
    x = as_tensor(x)
    out = _sum_type(x.dtype, dtype)
    n = math.prod(x.shape[i] for i in _axes(x, axis))
    if out.kind in "iu":
        bits = 8 * out.itemsize
        power = lambda f, m: np.array([pow(int(f), int(k), 1 << bits) for k in m], np.uint64).astype(out)
        return _folded(x, np.multiply, axis, keepdims, out, power(x.fill_value, [n])[0], power)
    fill = _lane_fill(x, axis, lambda f, n: np.power(out.type(f), n) if n else out.type(1))
    finish = lambda s: cast(s * _powers(F.col("m"), x.fill_value), "float64", out)
    return _reduce(x, axis, keepdims, [F.product(_v(x, "float64"))], finish, out, fill)


def _extreme(x, axis, keepdims, largest: bool) -> Tensor:
    x = as_tensor(x)
    if 0 in (x.shape[i] for i in _axes(x, axis)):
        raise ValueError("an empty lane has no extreme")
    f = x.lit()
    missing = F.col("m") > 0
    if largest or x.dtype.kind != "f":
        pick, combine = (F.max, F.greatest) if largest else (F.min, F.least)
        finish = lambda s: F.when(missing, combine(s, f)).otherwise(s)
        return _reduce(x, axis, keepdims, [pick("v")], finish, x.dtype, x.fill_value)
    # Spark's min ignores NaN, NumPy's doesn't
    low = lambda s, nan: F.when(nan, F.lit(float("nan")).cast(spark_type(x.dtype))).otherwise(s)
    finish = lambda s, nan: F.when(missing, low(F.least(s, f), nan | F.isnan(f))).otherwise(low(s, nan))
    return _reduce(x, axis, keepdims, [F.min("v"), F.bool_or(F.isnan("v"))], finish, x.dtype, x.fill_value)


def max(x, *, axis=None, keepdims=False) -> Tensor:  # noqa: A001
    return _extreme(x, axis, keepdims, True)


def min(x, *, axis=None, keepdims=False) -> Tensor:  # noqa: A001
    return _extreme(x, axis, keepdims, False)


def any(x, *, axis=None, keepdims=False) -> Tensor:  # noqa: A001
    x = astype(as_tensor(x), "bool")
    finish = lambda s: s | ((F.col("m") > 0) & F.lit(bool(x.fill_value)))
    return _reduce(x, axis, keepdims, [F.bool_or("v")], finish, "bool", _lane_fill(x, axis, lambda f, n: bool(f) and n > 0))


def all(x, *, axis=None, keepdims=False) -> Tensor:  # noqa: A001
    x = astype(as_tensor(x), "bool")
    finish = lambda s: s & ((F.col("m") == 0) | F.lit(bool(x.fill_value)))
    return _reduce(x, axis, keepdims, [F.bool_and("v")], finish, "bool", _lane_fill(x, axis, lambda f, n: bool(f) or n == 0))


def _mean_type(dtype: np.dtype, given) -> np.dtype:
    return np.dtype(given) if given is not None else np.mean(np.zeros(1, dtype)).dtype


def mean(x, *, axis=None, keepdims=False, dtype=None) -> Tensor:
    x = as_tensor(x)
    out = _mean_type(x.dtype, dtype)
    n = math.prod(x.shape[i] for i in _axes(x, axis))
    if out.kind == "c":
        total = sum(x, axis=axis, keepdims=keepdims)
        return elemwise("divide", total, np.complex128(n))
    finish = lambda s: ieee.divide(s + _multiples(F.col("m"), x.fill_value, np.dtype("float64")), F.lit(float(n))).cast(spark_type(out))
    return _reduce(x, axis, keepdims, [F.sum(_v(x, "float64"))], finish, out, _lane_fill(x, axis, lambda f, n: out.type(f) if n else out.type("nan")))


def var(x, *, axis=None, correction=0.0, keepdims=False) -> Tensor:
    """One pass: the variance of the stored cells (merged pairwise by Spark, numerically stable) plus the fill's part."""
    x = as_tensor(x)
    out = _mean_type(x.dtype, None)
    n = math.prod(x.shape[i] for i in _axes(x, axis))
    v = F.col("v") if x.dtype.kind != "c" else None
    if v is None:
        raise TypeError("not defined for complex numbers")
    v = _v(x, "float64")
    c, m, f = F.col("c").cast("double"), F.col("m").cast("double"), F.lit(float(x.fill_value))

    def finish(spread, centre):
        # two groups: c cells around centre, m cells at the fill
        between = F.when(F.col("m") == 0, F.lit(0.0)).otherwise((centre - f) * (centre - f) * c * m / F.lit(float(n or 1)))
        return ieee.divide(spread * c + between, F.lit(float(builtin_max(n - correction, 0)))).cast(spark_type(out))

    with np.errstate(all="ignore"):
        base = np.float64(x.fill_value) - np.float64(x.fill_value)
        fill = np.divide(base * n, np.float64(builtin_max(n - correction, 0)))
    return _reduce(x, axis, keepdims, [F.var_pop(v), F.avg(v)], finish, out, fill)


def std(x, *, axis=None, correction=0.0, keepdims=False) -> Tensor:
    return elemwise("sqrt", var(x, axis=axis, correction=correction, keepdims=keepdims))


def _not_nan(x: Tensor, value) -> Column:
    v = F.col("v")
    return F.when(F.isnan(v), literal(value, x.dtype)).otherwise(v) if x.dtype.kind == "f" else v


def nanreduce(x, method, identity=None, axis=None, keepdims=False, **kwargs) -> Tensor:
    """Replaces NaN by the method's identity, then reduces."""
    x = as_tensor(x)
    if identity is None:
        identity = getattr(method, "identity", None)
    if x.dtype.kind == "f" and identity is not None:
        fill = identity if np.isnan(x.fill_value) else x.fill_value
        x = x.new(x.df.withColumn("v", _not_nan(x, identity)), fill_value=fill)
    return by_ufunc(x, method, axis, keepdims, **kwargs)


def nansum(x, axis=None, keepdims=False, dtype=None, out=None) -> Tensor:
    return nanreduce(x, np.add, 0, axis, keepdims, dtype=dtype)


def nanprod(x, axis=None, keepdims=False, dtype=None, out=None) -> Tensor:
    return nanreduce(x, np.multiply, 1, axis, keepdims, dtype=dtype)


def _nan_extreme(x, axis, keepdims, largest: bool) -> Tensor:
    x = as_tensor(x)
    if x.dtype.kind != "f":
        return _extreme(x, axis, keepdims, largest)
    pick, combine = (F.max, F.greatest) if largest else (F.min, F.least)
    f = F.lit(None).cast(spark_type(x.dtype)) if np.isnan(x.fill_value) else x.lit()
    nan = F.lit(float("nan")).cast(spark_type(x.dtype))
    # greatest and least skip nulls
    finish = lambda s: F.coalesce(F.when(F.col("m") > 0, combine(s, f)).otherwise(s), nan)
    return _reduce(x, axis, keepdims, [pick(F.when(~F.isnan("v"), F.col("v")))], finish, x.dtype, x.fill_value)


def nanmax(x, axis=None, keepdims=False, dtype=None, out=None) -> Tensor:
    return _nan_extreme(x, axis, keepdims, True)


def nanmin(x, axis=None, keepdims=False, dtype=None, out=None) -> Tensor:
    return _nan_extreme(x, axis, keepdims, False)


def nanmean(x, axis=None, keepdims=False, dtype=None, out=None) -> Tensor:
    x = as_tensor(x)
    if x.dtype.kind != "f":
        return mean(x, axis=axis, keepdims=keepdims, dtype=dtype)
    result = np.dtype(dtype) if dtype is not None else x.dtype
    n = math.prod(x.shape[i] for i in _axes(x, axis))
    nan_fill = bool(np.isnan(x.fill_value))
    add = _multiples(F.col("m"), 0 if nan_fill else x.fill_value, np.dtype("float64"))
    used = lambda k: F.lit(n) - k - (F.col("m") if nan_fill else F.lit(0))
    finish = lambda s, k: ieee.divide(s + add, used(k).cast("double")).cast(spark_type(result))
    return _reduce(x, axis, keepdims, [F.sum(_not_nan(x, 0).cast("double")), F.count_if(F.isnan("v"))], finish, result, x.fill_value)


def by_ufunc(x, method, axis=(0,), keepdims=False, dtype=None, **kwargs) -> Tensor:
    """A ufunc's reduction; a binary ufunc without a form of its own is folded in Arrow batches.

    Such a ufunc must be associative, commutative and idempotent for the fill value, which is taken
    once in a lane that isn't full; otherwise the result would be dense, which is a ValueError.
    """
    x = as_tensor(x)
    more = {} if dtype is None else {"dtype": dtype}
    known = {
        np.add: lambda: sum(x, axis=axis, keepdims=keepdims, **more),
        np.multiply: lambda: prod(x, axis=axis, keepdims=keepdims, **more),
        np.maximum: lambda: max(x, axis=axis, keepdims=keepdims),
        np.minimum: lambda: min(x, axis=axis, keepdims=keepdims),
        np.fmax: lambda: _nan_extreme(x, axis, keepdims, True),
        np.fmin: lambda: _nan_extreme(x, axis, keepdims, False),
        np.logical_or: lambda: any(x, axis=axis, keepdims=keepdims),
        np.logical_and: lambda: all(x, axis=axis, keepdims=keepdims),
    }
    if method in known:
        return known[method]()
    bits = {np.bitwise_or: F.bit_or, np.bitwise_and: F.bit_and, np.bitwise_xor: F.bit_xor}
    if method in bits and x.dtype.kind in "iu":
        f = int(x.fill_value)
        op = {np.bitwise_or: "bitwiseOR", np.bitwise_and: "bitwiseAND", np.bitwise_xor: "bitwiseXOR"}[method]
        odd = F.col("m") > 0 if method is not np.bitwise_xor else F.col("m") % 2 == 1
        finish = lambda s: F.when(odd, getattr(s, op)(F.lit(f))).otherwise(s).cast(spark_type(x.dtype))
        fill = _lane_fill(x, axis, lambda f, n: f if n and (method is not np.bitwise_xor or n % 2) else x.dtype.type(0))
        return _reduce(x, axis, keepdims, [bits[method](F.col("v").cast("long"))], finish, x.dtype, fill)
    f = x.fill_value
    with np.errstate(all="ignore"):
        again = method(f, f)
    if not (again == f or (again != again and f != f)):
        raise ValueError(f"{method} over a fill value of {f} would give a dense result")
    out = method.reduce(np.zeros(1, x.dtype)).dtype
    return _folded(x, method, axis, keepdims, out, f, lambda f, m: np.full(len(m), f, out))


def _folded(x: Tensor, method, axis, keepdims: bool, out: np.dtype, fill, missing) -> Tensor:
    """Reduces by any associative and commutative ufunc, in Arrow batches.

    A batch is folded lane by lane before the exchange, so of a lane there is one row per batch in
    it, and what arrives is folded as a stream in order of lanes: no task holds a lane. missing:
    what the m > 0 cells without a row add, from (fill value, array of m).
    """
    if x.dtype.kind == "c" or out.kind == "c":
        raise TypeError("not defined for complex numbers")
    axes = _axes(x, axis)
    kept = [i for i in range(x.ndim) if i not in axes]
    n, value, own = math.prod(x.shape[i] for i in axes), spark_type(out), x.fill_value
    lane = [f"d{i}" for i in kept] or ["_all"]
    arrow = {"uint64": pa.decimal128(20, 0)}.get(out.name)
    stored = {"uint8": "int16", "uint16": "int32", "uint32": "int64", "float16": "float32"}.get(out.name, out.name)

    def fold(batches, first: bool):
        """Rows (lane…, v, c); those of the last lane of a batch wait for the next one."""
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([c.to_numpy() for c in b.columns[: len(lane)]])
            v = np.array(b.column(len(lane)).to_pylist(), out) if arrow else b.column(len(lane)).to_numpy(zero_copy_only=False).astype(out)
            c = np.ones(len(v), np.int64) if first else b.column(len(lane) + 1).to_numpy()
            if held is not None:
                keys, v, c = np.hstack([held[0], keys]), np.r_[held[1], v], np.r_[held[2], c]
            order = np.lexsort(keys[::-1])
            keys, v, c = keys[:, order], v[order], c[order]
            start = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            with np.errstate(all="ignore"):
                keys, v, c = keys[:, start], method.reduceat(v, start).astype(out), np.add.reduceat(c, start)
            if first:
                yield keys, v, c
            else:
                yield keys[:, :-1], v[:-1], c[:-1]
                held = keys[:, -1:], v[-1:], c[-1:]
        if held is not None:
            yield held

    def batch(keys, v, more, names):
        v = pa.array([int(a) for a in v], arrow) if arrow else pa.array(v.astype(stored))
        return pa.RecordBatch.from_arrays([*map(pa.array, keys), v, *map(pa.array, more)], [*lane, "v", *names])

    def partial(batches):
        for keys, v, c in fold(batches, True):
            yield batch(keys, v, [c], ["c"])

    def final(batches):
        for keys, v, c in fold(batches, False):
            with np.errstate(all="ignore"):
                open_ = c < n
                v[open_] = method(v[open_], missing(own, n - c[open_])).astype(out)
            yield batch(keys, v, [], [])

    kind = T.StructType([*(T.StructField(c, T.LongType()) for c in lane), T.StructField("v", value)])
    rows = x.df.select(*([F.col(c) for c in lane] if kept else [F.lit(0).cast("long").alias("_all")]), _v(x, out).alias("v"))
    folded = rows.mapInArrow(partial, T.StructType([*kind, T.StructField("c", T.LongType())]))
    folded = folded.repartition(*lane).sortWithinPartitions(*lane).mapInArrow(final, kind)
    if keepdims:
        shape = tuple(1 if i in axes else s for i, s in enumerate(x.shape))
        coords = [F.lit(0).cast("long").alias(f"d{i}") if i in axes else F.col(f"d{i}") for i in range(x.ndim)]
    else:
        shape = tuple(x.shape[i] for i in kept)
        coords = [F.col(f"d{i}").alias(f"d{j}") for j, i in enumerate(kept)]
    return Tensor(folded.select(*coords, "v"), shape, fill, out).pruned()


builtin_max = __builtins__["max"] if isinstance(__builtins__, dict) else __builtins__.max
__all__ = ["all", "any", "by_ufunc", "max", "mean", "min", "names", "nanmax", "nanmean", "nanmin", "nanprod", "nanreduce", "nansum", "prod", "std", "sum", "var"]
