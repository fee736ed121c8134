import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    root = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]")
        .appName("rarefy-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(root / "checkpoints"))
        .config("spark.sql.warehouse.dir", str(root / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rng():
    return np.random.default_rng(42)


def holey(rng, shape, density=0.5, dtype="float64", fill=0):
    """A random array in which most cells have the fill value."""
    dtype = np.dtype(dtype)
    values = rng.random(shape) * 20 - 10 if dtype.kind in "fc" else rng.integers(-10, 10, shape) if dtype.kind == "i" else rng.integers(0, 2, shape)
    if dtype.kind == "c":
        values = values + 1j * rng.random(shape)
    return np.where(rng.random(shape) < density, values, fill).astype(dtype)


def agree(tensor, expected, exact_type=True):
    """Same shape, type and values; NaN equals NaN."""
    got = tensor.todense() if hasattr(tensor, "todense") else np.asarray(tensor)
    expected = np.asarray(expected)
    assert got.shape == expected.shape, (got.shape, expected.shape)
    if exact_type:
        assert got.dtype == expected.dtype, (got.dtype, expected.dtype)
    np.testing.assert_allclose(got, expected, rtol=1e-9, atol=1e-12, equal_nan=True)
