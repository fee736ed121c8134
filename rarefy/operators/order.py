"""Order: sorting, first extremes and distinct values, with cells that aren't stored.

Places are counted, not sorted out by sampled ranges: a value or coordinate has an order-preserving
64-bit key, keys are counted by their leading bits, and each level's prefix sums move the next one on.
What a row's place is depends on its lane and key alone, however the plan deals rows to tasks, and a
window never sees more than 2 ** BLOCK_BITS keys.
"""

from __future__ import annotations

from collections import namedtuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.types import same
from ..tensor import Tensor, normalize_axis
from .elementwise import as_tensor

#: Coordinates that one block of the first-gap search covers.
GAP_BLOCK = 1 << 20
#: Bits of a key that one level of the counting resolves.
BLOCK_BITS = 22
#: Copies of one value that are numbered in one row.
COPIES = 1 << 16


def preceding(counts: DataFrame, lane: list[str], bits: int = 64) -> DataFrame:
    """Adds ``_before``: the sum of ``_n`` over the smaller ``_key`` of the same lane.

    Rows are unique by lane and ``_key``, a long of which ``bits`` low bits (and the sign) differ.
    """
    if bits <= BLOCK_BITS:
        order = Window.partitionBy(*(lane or [F.lit(0)])).orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("_before", F.coalesce(F.sum("_n").over(order), F.lit(0)).cast("long"))
    counts = counts.withColumn("_high", F.shiftright("_key", BLOCK_BITS))
    order = Window.partitionBy(*lane, "_high").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    within = counts.withColumn("_within", F.coalesce(F.sum("_n").over(order), F.lit(0)))
    blocks = counts.groupBy(*lane, F.col("_high").alias("_key")).agg(F.sum("_n").alias("_n"))
    starts = preceding(blocks, lane, bits - BLOCK_BITS).select(*lane, F.col("_key").alias("_high"), F.col("_before").alias("_start"))
    placed = within.join(starts, [*lane, "_high"])
    return placed.withColumn("_before", (F.col("_start") + F.col("_within")).cast("long")).drop("_high", "_within", "_start")


def _bits(v: Column) -> Column:
    """The 63 low bits of a non-negative double, as a long: larger numbers have larger ones."""
    small = v < F.lit(2.0**-1022)
    normal = F.when(small | (v == ieee.inf()), F.lit(1.0)).otherwise(v)
    # the logarithm may miss by one beside a power of two; powers of two and their quotients are exact
    guess = F.floor(F.log2(normal)).cast("long")
    guess = F.greatest(F.lit(-1022), F.least(F.lit(1023), guess))
    ratio = normal / F.pow(F.lit(2.0), guess.cast("double"))
    exponent = guess + F.when(ratio >= 2, 1).when(ratio < 1, -1).otherwise(0)
    part = F.when(ratio >= 2, ratio / 2).when(ratio < 1, ratio * 2).otherwise(ratio)
    found = F.shiftleft(exponent + 1023, 52) + ((part - 1) * F.lit(2.0**52)).cast("long")
    tiny = (F.when(small, v).otherwise(F.lit(0.0)) * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")
    return F.when(v == ieee.inf(), F.lit(0x7FF << 52)).when(small, tiny).otherwise(found)


def ordinal(v: Column, dtype: np.dtype) -> Column:
    """A long that is ordered as the values are; NaN is above all, and -0.0 is 0.0."""
    if dtype.kind == "c" or dtype.fields:
        raise TypeError("these cells have no order")
    if dtype.kind == "f":
        v = v.cast("double")
        size = _bits(F.abs(F.when(F.isnan(v), F.lit(0.0)).otherwise(v)))
        return F.when(F.isnan(v), F.lit((1 << 63) - 1)).when(v < 0, -size).otherwise(size)
    if dtype.name == "uint64":
        return (v.cast("decimal(38,0)") - F.lit(str(1 << 63)).cast("decimal(38,0)")).cast("long")
    return v.cast("int").cast("long") if dtype.kind == "b" else v.cast("long")


def rank(df: DataFrame, shape) -> tuple[DataFrame, int]:
    """Adds ``_rank``, the place of a cell in C order among the rows; and the number of rows, which takes a job."""
    from .shape import _linear

    size = int(np.prod(shape, dtype=object))
    if size >= 1 << 63:
        raise ValueError("cells can't be numbered by 63 bits")
    counts = df.withColumn("_key", _linear(shape)).withColumn("_n", F.lit(1))
    placed = preceding(counts, [], max(1, size.bit_length()))
    return placed.withColumnRenamed("_before", "_rank").drop("_key", "_n"), df.count()


def sort(x, *, axis=-1, descending=False, stable=False) -> Tensor:
    """Values along an axis in order, NaN last; cells that aren't stored lie between smaller and larger ones.

    Equal values are counted before they are placed, so a value that a lane is full of is one row
    per task until its copies are numbered, by blocks that are dealt out.
    """
    if stable:
        raise ValueError("a stable sort isn't supported")
    x = as_tensor(x)
    if not x.ndim:
        raise ValueError("a 0-D tensor has no axis")
    axis = normalize_axis(axis, x.ndim)
    lane = [f"d{i}" for i in range(x.ndim) if i != axis]
    v, f = F.col("v"), x.lit()
    nan = F.isnan(v) if x.dtype.kind == "f" else F.lit(False)
    fill_nan = x.dtype.kind == "f" and bool(np.isnan(x.fill_value))
    key = ordinal(v, x.dtype)
    if descending:
        key = F.when(nan, F.lit((1 << 63) - 1)).otherwise(F.bitwise_not(key))
    counts = x.df.groupBy(*lane, "v").agg(F.count(F.lit(1)).alias("_n"))
    placed = preceding(counts.withColumn("_key", key), lane)
    # values behind the fill are placed from the end of the lane
    ahead = ~nan if fill_nan else (v > f if descending else v <= f) & ~nan
    stored = (counts.groupBy(*lane) if lane else counts).agg(F.sum("_n").alias("_c"))
    placed = placed.join(stored, lane) if lane else placed.crossJoin(stored)
    start = F.col("_before") + F.when(ahead, F.lit(0).cast("long")).otherwise(F.lit(x.shape[axis]) - F.col("_c"))
    rows = placed.select(*(F.col(c) if c in lane else start.alias(c) for c in x.columns), "v", "_n").where(~same(v, x.fill_value, x.dtype))
    full = F.call_function("div", F.col("_n") - 1, F.lit(COPIES).cast("long"))
    blocks = rows.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), full)))
    blocks = blocks.repartition(*x.columns, "_block")
    last = F.least(F.lit(COPIES).cast("long"), F.col("_n") - F.col("_block") * COPIES) - 1
    copies = blocks.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    at = F.col(f"d{axis}") + F.col("_block") * COPIES + F.col("_copy")
    return x.new(copies.select(*(at.alias(c) if c == f"d{axis}" else F.col(c) for c in x.columns), "v"))


def _arg(x, axis, keepdims: bool, largest: bool) -> Tensor:
    """One pass over the cells and two exchanges: blocks of coordinates, then lanes.

    Where the best stored value doesn't beat the fill, the first coordinate without a cell counts.
    A block knows how long its run of stored cells from its start is; a lane needs its first block
    that isn't full, and the numbers of its full ones, a GAP_BLOCK-th of its stored cells.
    """
    from .shape import _linear

    x = as_tensor(x)
    if axis is None:
        at, lane, n, kept = _linear(x.shape) if x.ndim else F.lit(0).cast("long"), [], x.size, []
    else:
        axis = normalize_axis(axis, x.ndim)
        if isinstance(axis, tuple):
            raise ValueError("one axis, or all of them")
        at, n = F.col(f"d{axis}"), x.shape[axis]
        kept = [i for i in range(x.ndim) if i != axis]
        lane = [f"d{i}" for i in kept]
    if n == 0:
        raise ValueError("an empty lane has no extreme")
    f = x.lit()
    nan = F.isnan("v") if x.dtype.kind == "f" else F.lit(False)
    fill_nan = x.dtype.kind == "f" and bool(np.isnan(x.fill_value))
    size = F.lit(GAP_BLOCK).cast("long")
    rows = x.df.select(*lane, at.alias("_at"), "v", nan.cast("int").alias("_nan")).withColumn("_block", F.call_function("div", F.col("_at"), size))
    turn = F.row_number().over(Window.partitionBy(*lane, "_block").orderBy("_at")) - 1
    rows = rows.withColumn("_run", F.col("_at") == F.col("_block") * size + turn)
    # a NaN wins either way; among equals the first
    best = F.struct("_nan", "v", (-F.col("_at")).alias("i")) if largest else F.struct((-F.col("_nan")).alias("_nan"), "v", F.col("_at").alias("i"))
    pick = F.max if largest else F.min
    blocks = rows.groupBy(*lane, "_block").agg(pick(best).alias("_b"), F.count(F.lit(1)).alias("_n"), F.count_if("_run").alias("_run"))
    open_ = F.min(F.when(F.col("_n") < size, F.struct("_block", "_run"))).alias("_open")
    full = F.sort_array(F.collect_list(F.when(F.col("_n") == size, F.col("_block")))).alias("_full")
    lanes = blocks.groupBy(*lane) if lane else blocks.groupBy(F.lit(0).alias("_one"))
    lanes = lanes.agg(pick("_b").alias("_b"), F.sum("_n").alias("_c"), open_, full)
    first = F.aggregate("_full", F.lit(0).cast("long"), lambda k, b: F.when(b == k, k + 1).otherwise(k))
    gap = first * size + F.when(F.col("_open._block") == first, F.col("_open._run")).otherwise(F.lit(0))
    i = -F.col("_b.i") if largest else F.col("_b.i")
    is_nan = F.col("_b._nan") != 0
    beats = F.lit(False) if fill_nan else (is_nan | (F.col("_b.v") > f if largest else F.col("_b.v") < f))
    ties = is_nan if fill_nan else (F.col("_b.v") == f) & ~is_nan
    value = F.when((F.col("_c") == n) | beats, i).when(ties, F.least(i, gap)).otherwise(gap)
    if axis is None:
        shape = (1,) * x.ndim if keepdims else ()
        coords = [F.lit(0).cast("long").alias(f"d{k}") for k in range(len(shape))]
    elif keepdims:
        shape = tuple(1 if k == axis else s for k, s in enumerate(x.shape))
        coords = [(F.lit(0).cast("long") if k == axis else F.col(f"d{k}")).alias(f"d{k}") for k in range(x.ndim)]
    else:
        shape = tuple(x.shape[k] for k in kept)
        coords = [F.col(f"d{k}").alias(f"d{j}") for j, k in enumerate(kept)]
    return Tensor(lanes.select(*coords, value.cast("long").alias("v")), shape, 0, "int64").pruned()


def argmax(x, *, axis=None, keepdims=False) -> Tensor:
    """The first place of the greatest value; cells that aren't stored count."""
    return _arg(x, axis, keepdims, True)


def argmin(x, *, axis=None, keepdims=False) -> Tensor:
    return _arg(x, axis, keepdims, False)


UniqueCounts = namedtuple("UniqueCounts", ["values", "counts"])


def unique_counts_df(x) -> DataFrame:
    """``value, count`` over all cells, stored or not; NaN is one value here."""
    x = as_tensor(x)
    if x.dtype.kind == "c":
        raise TypeError("complex numbers have no order")
    fill = x.df.agg((F.lit(x.size) - F.count(F.lit(1))).alias("count")).select(x.lit().alias("value"), "count").where("count > 0")
    stored = x.df.groupBy(F.col("v").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    return stored.union(fill).groupBy("value").agg(F.sum("count").alias("count"))


def unique_counts(x) -> UniqueCounts:
    """Sorted driver arrays; each NaN is a value of its own, as in the array API."""
    x = as_tensor(x)
    rows = unique_counts_df(x).toPandas().sort_values("value")
    values, counts = rows["value"].to_numpy().astype(x.dtype), rows["count"].to_numpy().astype(np.int64)
    if x.dtype.kind == "f":
        nan = np.isnan(values)
        n = int(counts[nan].sum())
        values, counts = np.r_[values[~nan], np.full(n, np.nan, x.dtype)], np.r_[counts[~nan], np.ones(n, np.int64)]
    return UniqueCounts(values, counts)


def unique_values(x) -> np.ndarray:
    return unique_counts(x).values


__all__ = ["UniqueCounts", "argmax", "argmin", "ordinal", "preceding", "rank", "sort", "unique_counts", "unique_counts_df", "unique_values"]
