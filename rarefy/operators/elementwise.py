"""Element-wise functions: projections and joins on coordinates.

* one tensor and scalars, or tensors that are projections of the same rows: a projection and a
  filter, no exchange;
* a function that zero annihilates (multiply, and) over zero fills: an inner equi-join on the
  coordinates that both sides really have; stretched dimensions are never expanded;
* everything else: a union of tagged rows grouped by coordinate. The grouping is partially
  aggregated before its exchange, and filters on coordinates are pushed through it into the scans.

Stored results that equal the result's fill value are pruned.
"""

from __future__ import annotations

import builtins
import functools
import math
import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ieee, registry
from ..functions.types import cast, literal, same, spark_type
from ..tensor import MOST_STEPS, Origin, Tensor, names


def as_tensor(x) -> Tensor:
    if isinstance(x, Tensor):
        return x
    from ..sources.create import asarray

    return asarray(x)


def expand(x: Tensor, shape: tuple[int, ...]) -> DataFrame:
    """Rows of x at every coordinate of shape that they stretch to."""
    lead = len(shape) - x.ndim
    df = x.df.select(*(F.col(c).alias(f"d{i + lead}") for i, c in enumerate(x.columns)), "v")
    stretched = [i for i, n in enumerate(shape) if i < lead or (x.shape[i - lead] == 1 and n != 1)]
    spark = df.sparkSession
    for i in stretched:
        df = df.drop(f"d{i}").crossJoin(spark.range(shape[i]).select(F.col("id").alias(f"d{i}")))
    return df.select(*names(len(shape)), "v")


def _numpy(func, values, **kwargs):
    with np.errstate(all="ignore"):
        return func(*values, **kwargs)


def _result_dtype(func, args, **kwargs) -> np.dtype:
    """NumPy's own answer, from empty arrays for tensors and the scalars as they are."""
    probes = [np.ones(1, a.dtype) if isinstance(a, (Tensor, np.ndarray)) else a for a in args]
    return np.asarray(_numpy(func, probes, **kwargs)).dtype


def _column(func, entry, columns: list[Column], dtypes: list[np.dtype], out: np.dtype, kwargs) -> Column:
    if entry is not None and not kwargs and not any(d.name == "float16" for d in dtypes):
        if entry.name in ("real", "imag", "conj", "isposinf", "isneginf"):
            common = dtypes[0]
        else:
            common = np.result_type(*dtypes)
            if entry.name in ("equal", "not_equal") and common.kind == "c":
                a, b = (cast(c, d, common) for c, d in zip(columns, dtypes))
                hit = ieee.equal(a["re"], b["re"]) & ieee.equal(a["im"], b["im"])
                return hit if entry.name == "equal" else ~hit
        built = entry.build([cast(c, d, common) for c, d in zip(columns, dtypes)], common, out)
        return built.cast(spark_type(out)) if out.kind != "c" else built
    if any(d.kind == "c" for d in (*dtypes, out)):
        raise TypeError("functions without a column form take no complex numbers")

    # one struct of all operands: a batch is then a DataFrame, whatever their number
    @F.pandas_udf(spark_type(out))
    def run(rows: pd.DataFrame) -> pd.Series:
        arrays = [rows[c].to_numpy().astype(d) for c, d in zip(rows.columns, dtypes)]
        with np.errstate(all="ignore"):
            return pd.Series(np.asarray(func(*arrays, **kwargs), dtype=out))

    return run(F.struct(*(c.alias(f"x{i}") for i, c in enumerate(columns))))


def elemwise(func, *args, dtype=None, **kwargs):
    """Any NumPy function, entry name or vectorised callable over tensors, arrays and scalars."""
    entry = registry.find(func)
    if isinstance(func, str):
        if entry is None:
            raise ValueError(f"unknown function {func!r}")
    numpy_func = entry.numpy if entry is not None else func
    args = [a if isinstance(a, Tensor) else _operand(a) for a in args]
    tensors = [a for a in args if isinstance(a, Tensor)]
    if not tensors:
        raise ValueError("no tensor among the operands")
    dense = [a for a in args if isinstance(a, np.ndarray)]
    out = np.dtype(dtype) if dtype is not None else _result_dtype(numpy_func, args, **kwargs)
    try:
        shape = np.broadcast_shapes(*(a.shape for a in args if isinstance(a, (Tensor, np.ndarray))))
    except ValueError:
        raise ValueError("operands could not be broadcast together with shapes " + " ".join(str(a.shape) for a in args if hasattr(a, "shape"))) from None
    fills = [a.fill_value if isinstance(a, Tensor) else a for a in args]
    fill = np.asarray(_numpy(numpy_func, fills, **kwargs))
    if dense:
        first = fill.reshape(-1)[:1]
        constant = fill.size == 0 or bool(np.all((fill == first) | ((fill != fill) & (first != first))))
        if not constant:
            if all(a.shape == shape for a in dense) and all(t.shape == shape for t in tensors):
                return _numpy(numpy_func, [a.todense() if isinstance(a, Tensor) else a for a in args], **kwargs)
            raise ValueError("the result would be dense: the fill value isn't the same everywhere")
        fill = first[0] if fill.size else np.zeros((), out)[()]
        args = [as_tensor(a) if isinstance(a, np.ndarray) else a for a in args]
        tensors = [a for a in args if isinstance(a, Tensor)]
    fill = np.asarray(fill).astype(out)[()]
    dtypes = [a.dtype if isinstance(a, Tensor) else _scalar_type(a, tensors) for a in args]

    def compute(columns: dict[int, Column]) -> Column:
        values = [columns[i] if i in columns else literal(a, d) for i, (a, d) in enumerate(zip(args, dtypes))]
        return _column(numpy_func, entry, values, dtypes, out, kwargs)

    at = [i for i, a in enumerate(args) if isinstance(a, Tensor)]
    coords = names(len(shape))
    layouts = {t.layout for t in tensors}
    layout = layouts.pop() if len(layouts) == 1 and layouts <= {"dok", "gcxs"} else "coo"
    # a call to Python is made once, not wherever its result is used
    written = entry is not None and not kwargs and out.kind in "biuf" and not any(d.name == "float16" for d in dtypes)
    if origin := _one_origin(tensors, shape):
        return _projected(origin, tensors, compute({i: a.origin.value for i, a in zip(at, tensors)}), fill, out, layout, written)
    if len(at) == 1:
        df = expand(tensors[0], shape).withColumn("v", compute({at[0]: F.col("v")}))
    elif len(at) == 2 and entry is not None and entry.annihilates and not any(t.fill_value for t in tensors) and _may_join(tensors, shape):
        df = _inner(tensors, shape, lambda a, b: compute({at[0]: a, at[1]: b}))
    else:
        df = _grouped(tensors, shape, lambda cs: compute(dict(zip(at, cs))))
    result = Tensor(df.select(*coords, "v"), shape, fill, out, layout)
    return result.pruned()


def _one_origin(tensors: list[Tensor], shape=None, most=MOST_STEPS) -> Origin | None:
    """The rows that all tensors are projections of; None where there are none, a tensor stretches or values get long."""
    first = tensors[0].origin
    if any(t.origin.df is not first.df or t.shape != (shape or tensors[0].shape) for t in tensors):
        return None
    steps = builtins.sum(t.origin.steps for t in tensors)
    return Origin(first.df, first.value, None, steps) if steps <= most or len(tensors) == 1 else None


def _projected(origin: Origin, tensors: list[Tensor], value: Column, fill, dtype: np.dtype, layout: str = "coo", written=True) -> Tensor:
    """The tensor with that value in its origin's rows; written: whether later functions may repeat it."""
    df = origin.df.select(*tensors[0].columns, value.alias("v"))
    made = Origin(origin.df, value, None, origin.steps + 1) if written and origin.steps < MOST_STEPS else None
    result = Tensor(df, tensors[0].shape, fill, dtype, layout, cells=builtins.max(t.cells for t in tensors), origin=made).pruned()
    return result if made else result.ended()


def stored_side_by_side(tensors: list[Tensor], dtype: np.dtype) -> DataFrame | None:
    """Cells of several tensors with the number of their tensor, ``_part``, in one pass over the rows they share."""
    if len(tensors) < 2 or not _one_origin(tensors, most=math.inf) or any(t.dtype.kind not in "biuf" for t in tensors):
        return None
    columns, parts = [], []
    for k, t in enumerate(tensors):
        keep, v = t.origin.keep, F.col(f"_v{k}")
        columns.append(t.origin.value.alias(f"_v{k}"))
        if isinstance(keep, Column):
            columns.append(keep.alias(f"_k{k}"))
        kept = F.lit(True) if keep is None else ~same(v, t.fill_value, t.dtype) if keep is True else F.col(f"_k{k}")
        parts.append(F.when(kept, F.struct(F.lit(k).alias("_part"), cast(v, t.dtype, dtype).alias("v"))))
    rows = tensors[0].origin.df.select(*tensors[0].columns, *columns)
    return rows.select(*tensors[0].columns, F.inline(F.array_compact(F.array(*parts))))


def side_by_side(x, **functions) -> DataFrame:
    """Several functions of one tensor's stored cells: the coordinates, then a column for each, in one projection.

    A function is a name or NumPy function of one operand, or (function, operands…) with scalars and
    ``...`` for the cell. Results that equal a fill value aren't pruned.
    """
    x, columns = as_tensor(x), []
    for name, func in functions.items():
        func, *operands = func if isinstance(func, tuple) else (func, ...)
        entry = registry.find(func)
        if entry is None and isinstance(func, str):
            raise ValueError(f"unknown function {func!r}")
        args = [x if a is ... else a for a in operands]
        numpy_func = entry.numpy if entry is not None else func
        out = _result_dtype(numpy_func, args)
        dtypes = [x.dtype if a is x else _scalar_type(a, [x]) for a in args]
        cells = [F.col("v") if a is x else literal(a, d) for a, d in zip(args, dtypes)]
        columns.append(_column(numpy_func, entry, cells, dtypes, out, {}).alias(name))
    return x.df.select(*x.columns, *columns)


def _operand(a):
    if hasattr(a, "toarray") and hasattr(a, "tocoo"):
        from ..sources.io import from_scipy

        return from_scipy(a)
    if isinstance(a, (list, tuple)):
        a = np.asarray(a)
    return a if not isinstance(a, np.ndarray) or a.ndim else a[()]


def _scalar_type(a, tensors) -> np.dtype:
    """The type a scalar is computed in: Python scalars follow the tensors, as in NumPy."""
    if isinstance(a, np.generic):
        return a.dtype
    return np.result_type(*(t.dtype for t in tensors), a)


def _may_join(tensors, shape) -> bool:
    # over the same shape a one-sided inf or NaN must be seen too, which the grouped form does
    return all(t.dtype.kind in "biu" for t in tensors) or any(t.shape != shape for t in tensors)


def _odd(t: Tensor, v: Column) -> Column:
    """What zero doesn't annihilate: values that aren't finite."""
    if t.dtype.kind not in "fc":
        return F.lit(False)
    return ~ieee.isfinite(v.cast("double")) if t.dtype.kind == "f" else ~(ieee.isfinite(v["re"]) & ieee.isfinite(v["im"]))


def _inner(tensors: list[Tensor], shape, compute) -> DataFrame:
    """Join on the dimensions that neither side stretches.

    Stored values that aren't finite count against implicit zeros, too: those of a side with all
    dimensions come by an outer join, in the same pass; those of a stretched one are expanded apart.
    """
    a, b = tensors
    n = len(shape)
    lead = [n - t.ndim for t in (a, b)]
    has = [{i for i in range(n) if i >= k and t.shape[i - k] == shape[i]} for t, k in zip((a, b), lead)]
    both = sorted(has[0] & has[1])
    whole = [len(h) == n and t.dtype.kind in "fc" for h, t in zip(has, (a, b))]
    left = a.df.select(*(F.col(f"d{i - lead[0]}").alias(f"a{i}") for i in sorted(has[0])), F.col("v").alias("va"))
    right = b.df.select(*(F.col(f"d{i - lead[1]}").alias(f"b{i}") for i in sorted(has[1])), F.col("v").alias("vb"))
    on = functools.reduce(operator.and_, (F.col(f"a{i}") == F.col(f"b{i}") for i in both)) if both else F.lit(True)
    va, vb = F.col("va"), F.col("vb")
    if any(whole):
        how = "full" if all(whole) else "left" if whole[0] else "right"
        joined = left.join(right, on, how).where((va.isNotNull() & vb.isNotNull()) | (vb.isNull() & _odd(a, va)) | (va.isNull() & _odd(b, vb)))
        va, vb = F.coalesce(va, literal(0, a.dtype)), F.coalesce(vb, literal(0, b.dtype))
    else:
        joined = left.join(right, on) if both else left.crossJoin(right)
    coords = [F.coalesce(*(F.col(f"{x}{i}") for x, h in zip("ab", has) if i in h)).alias(f"d{i}") for i in range(n) if i in has[0] | has[1]]
    df = joined.select(*coords, compute(va, vb).alias("v"))
    for i in range(n):
        if i not in has[0] | has[1]:  # every operand is stretched here
            df = df.crossJoin(df.sparkSession.range(shape[i]).select(F.col("id").alias(f"d{i}")))
    for own, other, k in ((a, b, 0), (b, a, 1)):
        if whole[k] or own.dtype.kind not in "fc":
            continue
        lone = expand(own.new(own.df.where(_odd(own, F.col("v")))), shape)
        keys = sorted(has[1 - k])
        seen = other.df.select(*(F.col(f"d{i - lead[1 - k]}").alias(f"o{i}") for i in keys))
        lone = lone.join(seen, functools.reduce(operator.and_, (F.col(f"d{i}") == F.col(f"o{i}") for i in keys)), "left_anti") if keys else lone
        zero = literal(0, other.dtype)
        value = compute(F.col("v"), zero) if k == 0 else compute(zero, F.col("v"))
        df = df.unionByName(lone.withColumn("v", value))
    return df


def _grouped(tensors: list[Tensor], shape, compute) -> DataFrame:
    """A union of tagged rows, grouped by coordinate; what a tensor doesn't store is its fill."""
    coords = names(len(shape))
    parts = []
    for i, t in enumerate(tensors):
        # columns of the other operands are null
        values = [(F.col("v") if j == i else F.lit(None).cast(spark_type(o.dtype))).alias(f"v{j}") for j, o in enumerate(tensors)]
        parts.append(expand(t, shape).select(*coords, *values))
    union = functools.reduce(DataFrame.union, parts)
    first = [F.max(f"v{j}").alias(f"v{j}") for j in range(len(tensors))]
    grouped = union.groupBy(*coords) if coords else union.groupBy(F.lit(0).alias("_one"))
    df = grouped.agg(*first)
    values = [F.coalesce(F.col(f"v{j}"), t.lit()) for j, t in enumerate(tensors)]
    if not coords:
        df = df.drop("_one")
    return df.select(*coords, compute(values).alias("v"))


# ---------------------------------------------------------------- functions of their own


def astype(x, dtype, *, copy=True, device=None) -> Tensor:
    x, dtype = as_tensor(x), np.dtype(dtype)
    with np.errstate(all="ignore"):
        fill = np.asarray(x.fill_value).astype(dtype)[()]
    origin = None
    if x.dtype.kind in "biuf" and dtype.kind in "biuf" and x.origin.steps < MOST_STEPS:
        df, value, keep, steps = x.origin
        keep = ~same(value, x.fill_value, x.dtype) if keep is True else keep
        origin = Origin(df, cast(value, x.dtype, dtype), keep, steps + 1)
    result = Tensor(x.df.withColumn("v", cast(F.col("v"), x.dtype, dtype)), x.shape, fill, dtype, x.layout, cells=x.cells, origin=origin)
    return result if origin else result.ended()


def round(x, decimals=0, out=None) -> Tensor:  # noqa: A001
    """Half to even, like NumPy."""
    x = as_tensor(x)
    if x.dtype.kind in "iu" and decimals >= 0:
        return x
    if x.dtype.kind == "b":
        return astype(x, "float16")
    value = ieee.round_half_even(F.col("v").cast("double"), decimals)
    fill = np.round(x.fill_value, decimals)
    return x.new(x.df.withColumn("v", cast(value, "float64", x.dtype)), fill_value=fill).pruned()


def clip(a, min=None, max=None, out=None) -> Tensor:  # noqa: A002
    """Limits may be scalars, tensors or arrays."""
    a = as_tensor(a)
    if min is None and max is None:
        raise ValueError("one of min and max must be given")
    for func, limit in (("maximum", min), ("minimum", max)):
        if limit is not None:
            a = elemwise(func, a, limit)
    return a


def where(condition, x=None, y=None):
    """With one argument the coordinates of non-zero cells; with three a choice for each cell."""
    if x is None and y is None:
        from .index import nonzero

        return nonzero(condition)
    if x is None or y is None:
        raise ValueError("give both x and y, or neither")
    args = [as_tensor(a) if isinstance(a, (list, tuple)) else a for a in (condition, x, y)]
    return _choose(*args)


def _choose(condition, x, y):
    args = [condition, x, y]
    tensors = [a for a in args if isinstance(a, Tensor)]
    if not tensors:
        raise ValueError("no tensor among the operands")
    args = [as_tensor(a) if isinstance(a, np.ndarray) and a.ndim else a for a in args]
    tensors = [a for a in args if isinstance(a, Tensor)]
    out = _result_dtype(np.where, args)
    shape = np.broadcast_shapes(*(t.shape for t in tensors))
    fill = np.where(*(a.fill_value if isinstance(a, Tensor) else a for a in args))[()]
    dtypes = [np.dtype("bool"), out, out]
    own = [a.dtype if isinstance(a, Tensor) else np.asarray(a).dtype for a in args]

    def compute(cs):
        cs = iter(cs)
        c, p, q = (cast(next(cs), o, d) if isinstance(a, Tensor) else literal(a, d) for a, o, d in zip(args, own, dtypes))
        return F.when(c, p).otherwise(q)

    if origin := _one_origin(tensors, shape):
        return _projected(origin, tensors, compute([t.origin.value for t in tensors]), fill, out, written=out.kind in "biuf")
    return Tensor(_grouped(tensors, shape, compute), shape, fill, out).pruned()


def interp(x, xp, fp, left=None, right=None, period=None) -> Tensor:
    """np.interp of every cell; the knots are driver arrays and travel with the plan."""
    return elemwise(functools.partial(np.interp, xp=np.asarray(xp), fp=np.asarray(fp), left=left, right=right, period=period), as_tensor(x), dtype="float64")


__all__ = ["as_tensor", "astype", "clip", "elemwise", "expand", "interp", "round", "side_by_side", "where"]
