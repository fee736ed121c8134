"""What has to be exact at sizes and magnitudes that small random tensors don't reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import rarefy as R
from rarefy.functions.types import spark_type
from rarefy.operators.order import ordinal

from .conftest import agree


def scattered(spark, n, step):
    """n cells of a tensor of n * step cells, with values of either sign."""
    df = spark.range(n).select((F.col("id") * step).alias("d0"), ((F.col("id") * 7919 % 1000) - 400).cast("long").alias("v"))
    return R.from_df(df, ["d0"], "v", (n * step,), has_duplicates=False)


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_mask_over_millions(spark, reuse):
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        n = 1_500_000
        x = scattered(spark, n, 5)
        v = np.arange(n) * 7919 % 1000 - 400
        kept = x[x > 0]
        got = kept.df.toPandas().sort_values("d0")
        assert kept.shape == ((v > 0).sum(),)
        assert np.array_equal(got.d0, np.arange(len(got))) and np.array_equal(got.v, v[v > 0])
        y = R.from_df(x.df.withColumn("p", F.col("d0") % 3), ["p", "d0"], "v", (3, n * 5), has_duplicates=False)
        for descending in (False, True):
            got = R.sort(y, axis=1, descending=descending).df.toPandas()
            for lane in range(3):
                part = got[got.d0 == lane].sort_values("d1")
                own = v[np.arange(n) * 5 % 3 == lane]
                whole = np.sort(np.r_[own, 0])  # one implicit zero marks where they lie
                whole = whole[::-1] if descending else whole
                first = int(np.flatnonzero(whole == 0)[0])
                stored = np.sort(own)[::-1] if descending else np.sort(own)
                at = np.arange(len(own)) + np.where(np.arange(len(own)) < first, 0, n * 5 - len(own))
                assert np.array_equal(part.d1, at[stored != 0]) and np.array_equal(part.v, stored[stored != 0])
    finally:
        spark.conf.set("spark.sql.exchange.reuse", "true")


def test_order_of_all_doubles(spark):
    r = np.random.default_rng(1)
    raw = r.integers(0, 1 << 64, 3000, dtype=np.uint64).view(np.float64)
    near = np.ldexp(1.0, r.integers(-1074, 1023, 500))
    special = np.array([0.0, -0.0, np.inf, -np.inf, 5e-324, -5e-324, 2.0**-1022, np.nextafter(2.0**-1022, 0), np.finfo("f8").max, 1.0])
    v = np.concatenate([raw[~np.isnan(raw)], near, np.nextafter(near, 0), -near, special, r.random(500)])
    df = spark.createDataFrame([(float(a),) for a in v], "v double").withColumn("k", ordinal(F.col("v"), np.dtype("f8")))
    got = df.toPandas()
    bits = np.abs(got.v.to_numpy()).view(np.int64)
    assert np.array_equal(got.k, np.where(got.v < 0, -bits, bits))


def test_many_copies_in_a_lane(spark):
    df = spark.range(200_000).select(F.lit(0).alias("d0"), "id", F.when(F.col("id") % 4 == 0, -1.5).otherwise(2.5).alias("v"))
    x = R.from_df(df, ["d0", "id"], "v", (1, 300_000), has_duplicates=False)
    got = R.sort(x).todense()[0]
    assert np.array_equal(got, np.sort(np.r_[np.full(50_000, -1.5), np.full(150_000, 2.5), np.zeros(100_000)]))


def test_extremes_over_blocks(spark, monkeypatch):
    from rarefy.operators import order

    monkeypatch.setattr(order, "GAP_BLOCK", 8)
    r = np.random.default_rng(3)
    for stored in ([*range(8)], [*range(16)], [*range(8), *range(16, 24)], [*range(20)], [*range(3, 30)], [*range(40)]):
        a = np.zeros((2, 40), "int64")
        a[0, stored] = -r.integers(1, 9, len(stored))
        a[1] = a[0] - 1
        x = R.asarray(a)
        agree(R.argmax(x, axis=1), a.argmax(axis=1))
        agree(R.argmin(-x, axis=1), (-a).argmin(axis=1))
        agree(R.argmax(x), a.argmax())


def test_random_is_uniform(spark):
    a = R.random((100, 100), nnz=2000, random_state=7)
    at = np.sort(a.df.select((F.col("d0") * 100 + F.col("d1")).alias("at")).toPandas()["at"])
    assert len(np.unique(at)) == 2000 and at[0] >= 0 and at[-1] < 10_000
    gaps = np.diff(at)
    # a uniform choice has geometric gaps: mean 5, and about a fifth of them are 1
    assert len(np.unique(gaps)) > 15 and 0.15 < (gaps == 1).mean() < 0.25
    rows = np.bincount(at // 100, minlength=100)
    assert 3 < rows.std() < 5.2
    for n in (1, 2, 3, 7, 50, 4097):
        whole = R.random((n,), density=1.0, random_state=n)
        assert sorted(x.d0 for x in whole.df.collect()) == list(range(n))
    assert R.random((50,), nnz=20, random_state=1).df.exceptAll(R.random((50,), nnz=20, random_state=1).df).count() == 0


def test_integer_powers(spark):
    a = np.array([0, 1, -1, 2, 3, -3, 7, 10], "int64")
    x = R.asarray(a)
    for n in (0, 1, 2, 3, 5, 13, 18):
        agree(x**n, a**n)
    agree(R.asarray(np.array([3, -3]))**39, np.array([3, -3])**39)
    agree(R.asarray(np.array([0, 1, -1]))**1001, np.array([0, 1, -1])**1001)
    b = np.array([39, 2, 5, 0, 39, 3, 20, 18])
    agree(R.pow(x, R.asarray(b)), a**b)
    for kind in ("int8", "int32", "uint8", "uint32", "uint64"):
        small = np.array([0, 1, 2, 3, 200 % 128, 77], kind)
        agree(R.asarray(small) ** np.array(9, kind)[()], small ** np.array(9, kind)[()])
    with pytest.raises(Exception):
        R.pow(R.asarray(np.array([2, 3])), R.asarray(np.array([1, -1]))).todense()


def test_integer_products(spark):
    a = np.array([[94906267, 94906267, 1, 1], [3, -7, 2**40, 5], [2**62, 2, 1, 1], [0, 0, 0, 0]], "int64")
    x = R.from_numpy(a, 1)
    agree(x.prod(axis=1), a.prod(axis=1))
    agree(x.prod(axis=0, keepdims=True), a.prod(axis=0, keepdims=True))
    agree(R.from_numpy(a, 3).prod(), a.prod())
    for kind in ("int32", "uint8", "uint64"):
        b = np.array([[3, 1, 7], [2, 2, 2]], kind)
        agree(R.from_numpy(b, 2).prod(axis=1), b.prod(axis=1))
    assert R.full((40,), 3, "int64").prod().todense() == np.int64(3) ** 40
    lanes = spark.range(50_000).select((F.col("id") % 2).alias("i"), "id", F.when(F.col("id") < 60, 2).otherwise(1).alias("v"))
    y = R.from_df(lanes, ["i", "id"], F.col("v").cast("long"), (2, 50_001), fill_value=1, has_duplicates=False)
    agree(y.prod(axis=1), np.full(2, 2**30))


def test_ufuncs_that_would_be_dense(spark, rng):
    a = np.array([[1.0, 2.0, 0.0, 0.0], [0.0, 0.0, 0.0, 0.0]])
    with pytest.raises(ValueError, match="dense"):
        R.asarray(a).reduce(np.logaddexp, axis=1)
    b = rng.integers(0, 50, (6, 40)) * (rng.random((6, 40)) < 0.5)
    agree(R.asarray(b).reduce(np.gcd, axis=1), np.gcd.reduce(b, axis=1))
    agree(R.asarray(b).reduce(np.gcd, axis=(0, 1)), np.gcd.reduce(b, axis=(0, 1)))


WIDE = np.concatenate([s * 10.0 ** np.arange(-300, 301, 7) for s in (1, -1)])
BELOW_ONE = np.r_[WIDE[np.abs(WIDE) <= 1], 0.999999999, -0.999999999]


@pytest.mark.parametrize(
    "name, numpy, at",
    [
        ("asinh", np.arcsinh, WIDE), ("acosh", np.arccosh, np.r_[1 + np.abs(BELOW_ONE), np.abs(WIDE[np.abs(WIDE) >= 1])]), ("atanh", np.arctanh, BELOW_ONE),
        ("asin", np.arcsin, BELOW_ONE), ("acos", np.arccos, BELOW_ONE), ("atan", np.arctan, WIDE), ("log1p", np.log1p, np.abs(WIDE)), ("expm1", np.expm1, WIDE[np.abs(WIDE) < 700]),
        ("log", np.log, np.abs(WIDE)), ("log2", np.log2, np.abs(WIDE)), ("log10", np.log10, np.abs(WIDE)), ("sqrt", np.sqrt, np.abs(WIDE)), ("exp", np.exp, WIDE[np.abs(WIDE) < 700]),
        ("sinh", np.sinh, WIDE[np.abs(WIDE) < 700]), ("cosh", np.cosh, WIDE[np.abs(WIDE) < 700]), ("tanh", np.tanh, WIDE), ("reciprocal", np.reciprocal, WIDE), ("square", np.square, WIDE[np.abs(WIDE) < 1e150]),
        ("sin", np.sin, WIDE[np.abs(WIDE) < 1e5]), ("cos", np.cos, WIDE[np.abs(WIDE) < 1e5]), ("tan", np.tan, WIDE[np.abs(WIDE) < 1e5]), ("sign", np.sign, WIDE), ("floor", np.floor, WIDE), ("ceil", np.ceil, WIDE), ("trunc", np.trunc, WIDE), ("rint", np.rint, WIDE),
    ],
)
def test_functions_over_all_magnitudes(spark, name, numpy, at):
    from rarefy.functions.registry import REGISTRY

    df = spark.createDataFrame([(float(a),) for a in at], "v double")
    got = df.select("v", REGISTRY[name].build([F.col("v")], np.dtype("f8"), np.dtype("f8")).cast(spark_type("f8")).alias("w")).toPandas()
    with np.errstate(all="ignore"):
        np.testing.assert_allclose(got.w, numpy(got.v.to_numpy()), rtol=1e-12, atol=0)
