"""Element types: NumPy dtypes on the driver, Spark types in the rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: NumPy kind and size to the Spark type that holds every value of it. Unsigned ones are widened.
_SPARK = {
    "bool": T.BooleanType(),
    "int8": T.ByteType(),
    "int16": T.ShortType(),
    "int32": T.IntegerType(),
    "int64": T.LongType(),
    "uint8": T.ShortType(),
    "uint16": T.IntegerType(),
    "uint32": T.LongType(),
    "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(),
    "float32": T.FloatType(),
    "float64": T.DoubleType(),
}
COMPLEX = T.StructType([T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])


def spark_type(dtype) -> T.DataType:
    dtype = np.dtype(dtype)
    if dtype.kind == "c":
        return COMPLEX
    if dtype.fields:
        return T.StructType([T.StructField(n, _field_type(f[0])) for n, f in dtype.fields.items()])
    return _SPARK[dtype.name]


def _field_type(dtype: np.dtype) -> T.DataType:
    if dtype.subdtype:
        base, shape = dtype.subdtype
        out = spark_type(base)
        for _ in shape:
            out = T.ArrayType(out)
        return out
    return spark_type(dtype)


def numpy_type(kind: T.DataType) -> np.dtype:
    if kind == COMPLEX:
        return np.dtype("complex128")
    if isinstance(kind, T.DecimalType):
        return np.dtype("uint64") if kind.scale == 0 and kind.precision == 20 else np.dtype("float64")
    if isinstance(kind, T.StructType):
        return np.dtype([(f.name, numpy_type(f.dataType)) for f in kind.fields])
    names = {
        T.BooleanType: "bool", T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32",
        T.LongType: "int64", T.FloatType: "float32", T.DoubleType: "float64",
    }
    return np.dtype(names[type(kind)])


def python_value(x):
    """A scalar as Spark's Python side takes it."""
    x = np.asarray(x)[()]
    if isinstance(x, np.complexfloating):
        return (float(x.real), float(x.imag))
    return x.item() if isinstance(x, np.generic) else x


def literal(x, dtype) -> Column:
    dtype = np.dtype(dtype)
    if dtype.kind == "c":
        x = complex(x)
        return F.struct(F.lit(x.real).alias("re"), F.lit(x.imag).alias("im"))
    if dtype.name == "uint64":
        return F.lit(str(int(x))).cast(spark_type(dtype))
    return F.lit(python_value(np.asarray(x).astype(dtype))).cast(spark_type(dtype))


def cast(v: Column, source, target) -> Column:
    """NumPy's unsafe cast: floats truncate, integers wrap, anything but zero is true."""
    source, target = np.dtype(source), np.dtype(target)
    if source == target:
        return v
    if target.kind == "c":
        if source.kind == "c":
            return v
        return F.struct(cast(v, source, "float64").alias("re"), F.lit(0.0).alias("im"))
    if source.kind == "c":
        v, source = v["re"], np.dtype("float64")
    if target.kind == "b":
        return v != F.lit(0).cast(spark_type(source))
    if source.kind == "b":
        return v.cast("int").cast(spark_type(target))
    if target.kind in "iu":
        if source.kind == "f":
            big = F.lit(float(2**63))
            whole = F.when(F.isnan(v) | (v >= big) | (v < -big), F.lit(-(2**63))).otherwise(F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("long"))
            return wrap(whole, target)
        return wrap(v if source.name == "uint64" else v.cast("long"), target)
    return v.cast(spark_type(target))


def wrap(v: Column, dtype) -> Column:
    """A long (or a decimal) to an integer type, modulo its size."""
    dtype = np.dtype(dtype)
    bits = 8 * dtype.itemsize
    if bits == 64:
        if dtype.kind == "u":
            v = v.cast("decimal(38,0)")
            return F.when(v < 0, v + F.lit(str(2**64)).cast("decimal(38,0)")).otherwise(v).cast("decimal(20,0)")
        wide = v.cast("decimal(38,0)")
        return F.when(wide >= F.lit(str(2**63)).cast("decimal(38,0)"), wide - F.lit(str(2**64)).cast("decimal(38,0)")).otherwise(wide).cast("long")
    low = v.cast("long").bitwiseAND(F.lit((1 << bits) - 1))
    if dtype.kind == "i":
        low = F.when(low >= 1 << (bits - 1), low - (1 << bits)).otherwise(low)
    return low.cast(spark_type(dtype))


def same(v: Column, value, dtype) -> Column:
    """Is v the value? NaN equals NaN, and -0.0 equals 0.0."""
    if np.dtype(dtype).fields:
        return F.lit(False)
    return v.eqNullSafe(literal(value, dtype))
