"""Contractions: an equi-join on shared labels, then a sum over what isn't kept.

dot, matmul, tensordot, vecdot and einsum all become one plan over labelled relations. The sum is
partially aggregated before its exchange. Implicit zeros annihilate everything, NaN included.
``salt`` spreads contracted indices that hold very many cells: the left side is dealt into so many
parts by its other coordinates, and the right side's rows are repeated for each part. Where many
more pairs than cells are expected, pairs are summed by tiles instead (``plans/tiles``).
"""

from __future__ import annotations

import functools
import math
import operator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import cast, spark_type
from ..plans import tiles
from ..plans.contract import Relation, order_of_joins, pairs, parse
from ..tensor import Tensor, normalize_axis
from .elementwise import as_tensor, elemwise


def _zero(*tensors: Tensor) -> None:
    for t in tensors:
        if t.fill_value != 0 and t.size:
            raise ValueError("contractions need fill values of zero")


def _product(a: Column, b: Column, dtype: np.dtype) -> Column:
    if dtype.kind == "c":
        re = a["re"] * b["re"] - a["im"] * b["im"]
        return F.struct(re.alias("re"), (a["re"] * b["im"] + a["im"] * b["re"]).alias("im"))
    return a & b if dtype.kind == "b" else a * b


def _work_type(dtype: np.dtype) -> np.dtype:
    """Sums are taken in 64 bits and cast back."""
    return {"b": np.dtype("bool"), "c": np.dtype("complex128"), "f": np.dtype("float64")}.get(dtype.kind, np.dtype("int64"))


def _total(dtype: np.dtype, v: str = "v") -> Column:
    if dtype.kind == "c":
        return F.struct(F.sum(F.col(v)["re"]).alias("re"), F.sum(F.col(v)["im"]).alias("im"))
    return F.bool_or(v) if dtype.kind == "b" else F.sum(v)


def _summed(df: DataFrame, labels: list[str], dtype: np.dtype) -> DataFrame:
    if labels:
        return df.groupBy(*labels).agg(_total(dtype).alias("v"))
    # without labels a grouped sum has no row where there is nothing to sum
    return df.groupBy(F.lit(0).alias("_all")).agg(_total(dtype).alias("v")).drop("_all")


#: A relation that can't have more rows than this is dealt over all tasks before a product that may
#: be larger: its few bytes would be one partition otherwise, and one task would make the whole product.
SMALL_ROWS = 1 << 24


def _spread(small: Relation, other: Relation, shared: list[str]) -> DataFrame:
    product = small.rows * other.rows / max(1.0, min((small.sizes[c] for c in shared), default=1))
    if not small.labels or small.rows > SMALL_ROWS or product <= SMALL_ROWS:
        return small.df
    n = int(small.df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # by what the product keeps of it: each task then sums cells of its own
    return small.df.repartition(n, *([c for c in small.labels if c not in shared] or small.labels))


#: Pairs and places of a product from which it is worth being summed by tiles, and pairs for each cell.
TILED_PAIRS, TILED_PLACES, TILED_RATIO = 1 << 22, 1 << 19, 4


def _by_tiles(a: Relation, b: Relation, keep: list[str], dtype: np.dtype) -> tuple[list[str], list[str], list[str]] | None:
    """The labels of rows, sum and columns, if tiles suit the product; where sums keep few places, a join's partial sums are as few."""
    rows, shared, columns = ([c for c in x if (c in a.labels, c in b.labels) == k] for x, k in ((a.labels, (True, False)), (a.labels, (True, True)), (b.labels, (False, True))))
    if not rows or not shared or not columns or dtype.kind not in "if" or {*keep} != {*rows, *columns}:
        return None
    sizes = {**a.sizes, **b.sizes}
    size = lambda labels: math.prod(sizes[c] for c in labels)
    if max(size(rows), size(shared), size(columns)) >= 1 << 62 or size(rows) * size(columns) < TILED_PLACES:
        return None
    return (rows, shared, columns) if pairs(a, b) > max(TILED_PAIRS, TILED_RATIO * (a.cells + b.cells)) else None


def _join(a: Relation, b: Relation, keep: list[str], last: bool, dtype: np.dtype, salt: int = 1) -> Relation:
    shared = [c for c in a.labels if c in b.labels]
    # tiles leave out zero sums, which only the result may do
    if last and (parts := _by_tiles(a, b, keep, dtype)):
        sizes = {**a.sizes, **b.sizes}
        return Relation(tiles.product(a.df, b.df, *parts, sizes, dtype), keep, sizes)
    small, other = (a, b) if a.rows <= b.rows else (b, a)
    small.df = _spread(small, other, shared)
    left = a.df.select(*(F.col(c).alias(f"l_{c}") for c in a.labels), F.col("v").alias("lv"))
    right = b.df.select(*(F.col(c).alias(f"r_{c}") for c in b.labels), F.col("v").alias("rv"))
    on = [F.col(f"l_{c}") == F.col(f"r_{c}") for c in shared]
    if salt > 1 and shared:
        free = [F.col(f"l_{c}") for c in a.labels if c not in shared] or [F.col("lv")]
        left = left.withColumn("l_salt", F.pmod(F.xxhash64(*free), F.lit(salt)))
        right = right.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        on.append(F.col("l_salt") == F.col("r_salt"))
    joined = left.join(right, functools.reduce(operator.and_, on)) if on else left.crossJoin(right)
    labels = [*a.labels, *(c for c in b.labels if c not in shared)]
    out = joined.select(*(F.col(f"l_{c}" if c in a.labels else f"r_{c}").alias(c) for c in labels), _product(F.col("lv"), F.col("rv"), dtype).alias("v"))
    kept = [c for c in labels if c in keep]
    if len(kept) < len(labels):
        out = _summed(out, kept, dtype)
    size = a.rows * b.rows / max(1, min((a.sizes[c] for c in shared), default=1))
    sizes = {**a.sizes, **b.sizes}
    return Relation(out, kept, sizes, size, min(pairs(a, b), math.prod(float(sizes[c]) for c in kept)))


def contract(operands: list[Tensor], inputs: list[list[str]], output: list[str], dtype=None, salt: int = 1) -> Tensor:
    """Sums the operands' product over all labels that the output doesn't have."""
    out = np.dtype(dtype) if dtype is not None else np.result_type(*(t.dtype for t in operands))
    work = _work_type(out)
    relations, sizes = [], {}
    for k, (t, labels) in enumerate(zip(operands, inputs)):
        df = t.df.select(*t.columns, cast(F.col("v"), t.dtype, work).alias("v"))
        own: dict[str, int] = {}
        for i, c in enumerate(labels):
            if c in own:
                df = df.where(F.col(f"d{own[c]}") == F.col(f"d{i}"))
                if t.shape[own[c]] != t.shape[i]:
                    raise ValueError(f"label {c!r} has two sizes")
            else:
                own[c] = i
            if sizes.setdefault(c, t.shape[i]) != t.shape[i]:
                raise ValueError(f"label {c!r} has two sizes")
        needed = {c for j, other in enumerate(inputs) if j != k for c in other} | set(output)
        df = df.select(*(F.col(f"d{i}").alias(c) for c, i in own.items()), "v")
        kept = [c for c in own if c in needed]
        if len(kept) < len(own):
            df = _summed(df, kept, work)
        rows = float(np.prod([float(t.shape[own[c]]) for c in kept])) if kept else 1.0
        relations.append(Relation(df, kept, {c: t.shape[i] for c, i in own.items()}, rows, min(rows, t.cells)))
    if missing := [c for c in output if c not in sizes]:
        raise ValueError(f"output labels {missing} don't occur in an input")
    relation = order_of_joins(relations, output, lambda a, b, keep, last: _join(a, b, keep, last, work, salt))
    value = cast(F.col("v"), work, out) if out != work else F.col("v")
    coords = [F.col(c).alias(f"d{i}") for i, c in enumerate(output)]
    result = Tensor(relation.df.select(*coords, value.cast(spark_type(out)).alias("v") if out.kind != "c" else value.alias("v")), [sizes[c] for c in output], 0, out)
    return result.pruned()


def einsum(*operands, dtype=None) -> Tensor:
    """NumPy's einsum, in its string and its interleaved form; joins start with the smallest relation."""
    inputs, output, arrays = parse(operands)
    tensors = [as_tensor(a) for a in arrays]
    _zero(*tensors)
    labels, out = inputs.resolve([t.ndim for t in tensors], output)
    squeezed, named = [], []
    sizes: dict[str, int] = {}
    for t, own in zip(tensors, labels):
        for c, n in zip(own, t.shape):
            sizes[c] = max(sizes.get(c, 1), n)
    for t, own in zip(tensors, labels):
        # a dimension of size 1 stretches: it leaves the join
        ones = tuple(i for i, (c, n) in enumerate(zip(own, t.shape)) if n == 1 and sizes[c] != 1)
        squeezed.append(t.squeeze(ones) if ones else t)
        named.append([c for i, c in enumerate(own) if i not in ones])
    return contract(squeezed, named, out, dtype)


def tensordot(a, b, axes=2, *, return_type=None, salt: int = 1):
    a, b = as_tensor(a), as_tensor(b)
    _zero(a, b)
    if np.isscalar(axes):
        left, right = list(range(a.ndim - axes, a.ndim)), list(range(axes))
    else:
        left, right = ([x] if np.isscalar(x) else list(x) for x in axes)
    left, right = list(normalize_axis(tuple(left), a.ndim)), list(normalize_axis(tuple(right), b.ndim))
    if len(left) != len(right) or any(a.shape[i] != b.shape[j] for i, j in zip(left, right)):
        raise ValueError("shape-mismatch for sum")
    names_a = [f"a{i}" for i in range(a.ndim)]
    names_b = [f"b{j}" for j in range(b.ndim)]
    for i, j in zip(left, right):
        names_b[j] = names_a[i]
    out = [c for i, c in enumerate(names_a) if i not in left] + [c for j, c in enumerate(names_b) if j not in right]
    result = contract([a, b], [names_a, names_b], out, salt=salt)
    return result.todense() if return_type is np.ndarray else result


def dot(a, b, *, salt: int = 1):
    a, b = as_tensor(a), as_tensor(b)
    if not a.ndim or not b.ndim:
        return elemwise("multiply", a, b)
    return tensordot(a, b, (a.ndim - 1, max(0, b.ndim - 2)), salt=salt)


def matmul(a, b, *, salt: int = 1):
    """Batched matrix product; a batch dimension of size 1 leaves the join instead of being repeated."""
    a, b = as_tensor(a), as_tensor(b)
    if not a.ndim or not b.ndim:
        raise ValueError("matmul takes no scalars")
    _zero(a, b)
    inner = a.shape[-1], b.shape[-2] if b.ndim > 1 else b.shape[0]
    if inner[0] != inner[1]:
        raise ValueError(f"contracted sizes {inner[0]} and {inner[1]} differ")
    batch = np.broadcast_shapes(a.shape[:-2], b.shape[:-2])
    names = [f"n{i}" for i in range(len(batch))]

    def labelled(t: Tensor, last: list[str]):
        lead = t.ndim - len(last)
        own = names[len(batch) - lead :] + last
        ones = tuple(i for i in range(lead) if t.shape[i] == 1 and batch[len(batch) - lead + i] != 1)
        return (t.squeeze(ones) if ones else t), [c for i, c in enumerate(own) if i not in ones]

    left = labelled(a, ["i", "k"] if a.ndim > 1 else ["k"])
    right = labelled(b, ["k", "j"] if b.ndim > 1 else ["k"])
    out = names + ["i"] * (a.ndim > 1) + ["j"] * (b.ndim > 1)
    return contract([left[0], right[0]], [left[1], right[1]], out, salt=salt)


def vecdot(x1, x2, *, axis=-1):
    x1, x2 = as_tensor(x1), as_tensor(x2)
    _zero(x1, x2)
    if axis >= 0 or axis < -min(x1.ndim, x2.ndim):
        axis = normalize_axis(axis, min(x1.ndim, x2.ndim)) - min(x1.ndim, x2.ndim)
    if x1.shape[axis] != x2.shape[axis]:
        raise ValueError("shapes must match along the axis")
    from . import reduce

    if x1.dtype.kind == "c":
        x1 = elemwise("conj", x1)
    return reduce.sum(elemwise("multiply", x1, x2), axis=axis)


def kron(a, b) -> Tensor:
    """Every pair of cells; the result is as large as the product of both, so the smaller side is what Spark ships."""
    a, b = as_tensor(a), as_tensor(b)
    if not a.ndim or not b.ndim:
        return elemwise("multiply", a, b)
    _zero(a, b)
    n = max(a.ndim, b.ndim)
    a, b = (t.reshape((1,) * (n - t.ndim) + t.shape) for t in (a, b))
    out = np.result_type(a.dtype, b.dtype)
    left = a.df.select(*(F.col(c).alias(f"l_{c}") for c in a.columns), cast(F.col("v"), a.dtype, out).alias("lv"))
    right = b.df.select(*(F.col(c).alias(f"r_{c}") for c in b.columns), cast(F.col("v"), b.dtype, out).alias("rv"))
    coords = [(F.col(f"l_d{i}") * F.lit(b.shape[i]) + F.col(f"r_d{i}")).alias(f"d{i}") for i in range(n)]
    df = left.crossJoin(right).select(*coords, _product(F.col("lv"), F.col("rv"), out).cast(spark_type(out)).alias("v"))
    return Tensor(df, [p * q for p, q in zip(a.shape, b.shape)], 0, out).pruned()


def outer(a, b, out=None) -> Tensor:
    a, b = as_tensor(a).flatten(), as_tensor(b).flatten()
    return elemwise("multiply", a.reshape((-1, 1)), b.reshape((1, -1)))


__all__ = ["contract", "dot", "einsum", "kron", "matmul", "outer", "tensordot", "vecdot"]
