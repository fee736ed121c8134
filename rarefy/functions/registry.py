"""The table of element-wise functions.

An entry builds the result column from operand columns and says which NumPy function gives the
result type and the fill value on the driver. Functions without an entry run as Arrow-batched
Pandas UDFs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import ieee
from .types import cast, literal, spark_type, wrap


@dataclass(frozen=True)
class Function:
    """build(columns, types, out): columns already have the types they are computed in."""

    name: str
    numpy: Callable
    build: Callable
    #: 0 with anything gives 0, but for non-finite operands.
    annihilates: bool = False

    @property
    def arity(self) -> int:
        return getattr(self.numpy, "nin", 1)


REGISTRY: dict[str, Function] = {}


def _put(name: str, build: Callable, numpy: Callable | None = None, **more) -> None:
    REGISTRY[name] = Function(name, numpy or getattr(np, name), build, **more)


# arithmetic: by kind of the common type


def _arithmetic(exact: Callable, floating: Callable, complex_: Callable | None = None):
    def build(c: list[Column], dtype: np.dtype, out: np.dtype) -> Column:
        if dtype.kind == "c":
            if complex_ is None:
                raise TypeError("not defined for complex numbers")
            return complex_(*c)
        if dtype.kind == "f":
            return floating(*(x.cast("double") for x in c)).cast(spark_type(out))
        if dtype.name == "uint64":
            return wrap(exact(*(x.cast("decimal(38,0)") for x in c)) % F.lit(str(2**64)).cast("decimal(38,0)"), out)
        return wrap(exact(*(x.cast("long") for x in c)), out)

    return build


def _complex(re: Column, im: Column) -> Column:
    return F.struct(re.alias("re"), im.alias("im"))


def _times(a, b):
    return _complex(a["re"] * b["re"] - a["im"] * b["im"], a["re"] * b["im"] + a["im"] * b["re"])


def _over(a, b):
    size = b["re"] * b["re"] + b["im"] * b["im"]
    top = _times(a, _complex(b["re"], -b["im"]))
    return _complex(ieee.divide(top["re"], size), ieee.divide(top["im"], size))


def _plus(a, b):
    return _complex(a["re"] + b["re"], a["im"] + b["im"])


def _minus(a, b):
    return _complex(a["re"] - b["re"], a["im"] - b["im"])


def _bool_or_exact(name: str, on_bool: Callable, build: Callable):
    def built(c, dtype, out):
        return on_bool(*c) if dtype.kind == "b" else build(c, dtype, out)

    return built


_put("add", _bool_or_exact("add", lambda a, b: a | b, _arithmetic(lambda a, b: a + b, lambda a, b: a + b, _plus)))
_put("subtract", _arithmetic(lambda a, b: a - b, lambda a, b: a - b, _minus))
_put(
    "multiply",
    _bool_or_exact("multiply", lambda a, b: a & b, _arithmetic(lambda a, b: a * b, lambda a, b: a * b, _times)),
    annihilates=True,
)


def _div(a: Column, b: Column) -> Column:
    """The integer quotient of longs, truncated; "/" would go through doubles."""
    return F.call_function("div", a, b)


def _int_floor(a: Column, b: Column) -> Column:
    safe = F.when(b == 0, F.lit(1)).otherwise(b).cast("long")
    m = a % safe
    q = _div(a - m, safe)
    return F.when(b == 0, F.lit(0)).otherwise(q - F.when((m != 0) & ((m < 0) != (safe < 0)), 1).otherwise(0))


def _int_remainder(a: Column, b: Column) -> Column:
    safe = F.when(b == 0, F.lit(1)).otherwise(b)
    m = a % safe
    return F.when(b == 0, F.lit(0)).otherwise(F.when((m != 0) & ((m < 0) != (safe < 0)), m + safe).otherwise(m))


def _times_u64(a: Column, b: Column) -> Column:
    """Product of decimals below 2 ** 64, modulo 2 ** 64; halves keep it within a decimal."""
    half, whole = (F.lit(str(1 << n)).cast("decimal(38,0)") for n in (32, 64))
    low = (a % half).cast("decimal(20,0)")
    high = F.floor((a - low).cast("decimal(38,0)") / half).cast("decimal(20,0)")
    b = b.cast("decimal(20,0)")
    top = ((high * b).cast("decimal(38,0)") % half * half).cast("decimal(38,0)")
    return ((top + (low * b).cast("decimal(38,0)")).cast("decimal(38,0)") % whole).cast("decimal(38,0)")


def _power(c: list[Column], dtype: np.dtype, out: np.dtype) -> Column:
    """Integers by repeated squaring; products overflow, or wrap in narrower types, as in multiplication."""
    if dtype.kind == "c":
        raise TypeError("not defined for complex numbers")
    if dtype.kind == "f":
        return ieee.power(*(x.cast("double") for x in c)).cast(spark_type(out))
    kind = "decimal(38,0)" if dtype.name == "uint64" else "long"
    times = _times_u64 if dtype.name == "uint64" else (lambda p, q: p * q) if dtype.itemsize == 8 else (lambda p, q: wrap(p * q, dtype).cast("long"))
    a, n = c[0].cast(kind), c[1].cast("long")
    start = F.struct(F.lit(1).cast(kind).alias("p"), a.alias("s"), n.alias("n"))

    def step(t, _):
        # the last square isn't needed, and might overflow
        p = F.when(t["n"] % 2 == 1, times(t["p"], t["s"])).otherwise(t["p"])
        s = F.when(t["n"] > 1, times(t["s"], t["s"])).otherwise(t["s"])
        return F.struct(p.alias("p"), s.alias("s"), F.shiftright(t["n"], 1).alias("n"))

    value = F.aggregate(F.sequence(F.lit(1), F.length(F.bin(n))), start, step, lambda t: t["p"])
    return wrap(F.when(n < 0, F.raise_error(F.lit("integers have no negative integer powers")).cast(kind)).otherwise(value), out)


def _asinh(v: Column) -> Column:
    # SQL's formula loses small and negative values
    a = F.abs(v)
    small = F.log1p(a + a * a / (F.lit(1.0) + F.sqrt(a * a + 1)))
    large = F.log(F.when(a > 1e8, a).otherwise(F.lit(1.0))) + F.lit(float(np.log(2)))
    return F.when(F.isnan(v) | (v == 0), v).otherwise(ieee.copysign(F.when(a > 1e8, large).otherwise(small), v))


def _acosh(v: Column) -> Column:
    t = F.when(v >= 1, v - 1).otherwise(F.lit(0.0))
    near = F.log1p(t + F.sqrt(t + t + t * t))
    large = F.log(F.when(v > 1e8, v).otherwise(F.lit(1.0))) + F.lit(float(np.log(2)))
    return F.when(F.isnan(v) | (v < 1), ieee.nan()).when(v > 1e8, large).otherwise(near)


_put("floor_divide", _arithmetic(_int_floor, ieee.floor_divide))
_put("remainder", _arithmetic(_int_remainder, ieee.remainder))
_put("pow", _power, np.power)
_put("negative", _arithmetic(lambda a: -a, lambda a: -a, lambda a: _complex(-a["re"], -a["im"])))
_put("positive", lambda c, dtype, out: c[0])
_put("square", _arithmetic(lambda a: a * a, lambda a: a * a, lambda a: _times(a, a)))
_put("abs", _arithmetic(F.abs, F.abs, lambda a: F.hypot(a["re"], a["im"])), np.absolute)
_put("sign", _arithmetic(lambda a: F.signum(a), ieee.sign))
_put("conj", lambda c, dtype, out: _complex(c[0]["re"], -c[0]["im"]) if dtype.kind == "c" else c[0], np.conjugate)
_put("real", lambda c, dtype, out: c[0]["re"] if dtype.kind == "c" else c[0], np.real)
_put("imag", lambda c, dtype, out: c[0]["im"] if dtype.kind == "c" else F.lit(0).cast(spark_type(out)), np.imag)


def _float(f: Callable):
    return lambda c, dtype, out: f(*(x.cast("double") for x in c)).cast(spark_type(out))


def _divide(c, dtype, out):
    return _over(*c) if dtype.kind == "c" else _float(ieee.divide)(c, dtype, out)


_put("divide", _divide)
_put("reciprocal", _float(lambda a: ieee.divide(F.lit(1.0), a)))
for _name, _f in {
    "sqrt": F.sqrt, "exp": F.exp, "expm1": F.expm1, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh,
}.items():
    _put(_name, _float(_f))
for _name, _numpy, _f in (
    ("asin", np.arcsin, F.asin), ("acos", np.arccos, F.acos), ("atan", np.arctan, F.atan), ("asinh", np.arcsinh, _asinh),
    ("acosh", np.arccosh, _acosh), ("atanh", np.arctanh, F.atanh), ("atan2", np.arctan2, F.atan2), ("hypot", np.hypot, F.hypot),
    ("copysign", np.copysign, ieee.copysign), ("logaddexp", np.logaddexp, ieee.logaddexp),
    ("log", np.log, lambda v: ieee.logarithm(F.log, v)), ("log2", np.log2, lambda v: ieee.logarithm(F.log2, v)),
    ("log10", np.log10, lambda v: ieee.logarithm(F.log10, v)), ("log1p", np.log1p, lambda v: ieee.logarithm(F.log1p, v, -1.0)),
):
    _put(_name, _float(_f), _numpy)


def _step(f: Callable):
    """ceil, floor, trunc, rint: integers are whole already."""
    return lambda c, dtype, out: c[0].cast(spark_type(out)) if dtype.kind in "biu" else f(c[0].cast("double")).cast(spark_type(out))


for _name in ("ceil", "floor", "trunc"):
    _put(_name, _step(getattr(ieee, _name)))
_put("rint", _step(ieee.rint))


def _test(on_float: Callable, otherwise: bool | Callable):
    def build(c, dtype, out):
        if dtype.kind == "f":
            return on_float(*(x.cast("double") for x in c))
        if dtype.kind == "c":
            return on_float(c[0]["re"]) | on_float(c[0]["im"])
        return otherwise(*c) if callable(otherwise) else F.lit(otherwise)

    return build


_put("isnan", _test(F.isnan, False))
_put("isinf", _test(lambda v: F.abs(v) == ieee.inf(), False))
_put("isposinf", _test(lambda v: v == ieee.inf(), False))
_put("isneginf", _test(lambda v: v == ieee.ninf(), False))
_put("signbit", _test(ieee.signbit, lambda v: v < 0))


def _isfinite(c, dtype, out):
    if dtype.kind == "c":
        return ieee.isfinite(c[0]["re"]) & ieee.isfinite(c[0]["im"])
    return ieee.isfinite(c[0].cast("double")) if dtype.kind == "f" else F.lit(True)


_put("isfinite", _isfinite)


def _compare(on_float: Callable, exact: Callable):
    def build(c, dtype, out):
        if dtype.kind == "f":
            return on_float(*(x.cast("double") for x in c))
        return exact(*c)

    return build


_put("equal", _compare(ieee.equal, lambda a, b: a == b))
_put("not_equal", _compare(lambda a, b: ~ieee.equal(a, b), lambda a, b: a != b))
_put("greater", _compare(ieee.greater, lambda a, b: a > b))
_put("greater_equal", _compare(ieee.greater_equal, lambda a, b: a >= b))
_put("less", _compare(lambda a, b: ieee.greater(b, a), lambda a, b: a < b))
_put("less_equal", _compare(lambda a, b: ieee.greater_equal(b, a), lambda a, b: a <= b))
_put("maximum", _compare(F.greatest, F.greatest))
_put("minimum", _compare(ieee.minimum, F.least))
_put("fmax", _compare(lambda a, b: F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.greatest(a, b)), F.greatest))
_put("fmin", _compare(lambda a, b: F.when(F.isnan(a), b).when(F.isnan(b), a).otherwise(F.least(a, b)), F.least))


def _logical(f: Callable):
    return lambda c, dtype, out: f(*(cast(x, dtype, "bool") for x in c))


_put("logical_and", _logical(lambda a, b: a & b), annihilates=True)
_put("logical_or", _logical(lambda a, b: a | b))
_put("logical_xor", _logical(lambda a, b: a != b))
_put("logical_not", _logical(lambda a: ~a))


def _bits(on_bool: Callable, exact: Callable):
    def build(c, dtype, out):
        if dtype.kind == "b":
            return on_bool(*c)
        if dtype.kind not in "iu":
            raise TypeError("bitwise functions take integers and booleans")
        return wrap(exact(*(x.cast("long") for x in c)), out)

    return build


_put("bitwise_and", _bits(lambda a, b: a & b, lambda a, b: a.bitwiseAND(b)), annihilates=True)
_put("bitwise_or", _bits(lambda a, b: a | b, lambda a, b: a.bitwiseOR(b)))
_put("bitwise_xor", _bits(lambda a, b: a != b, lambda a, b: a.bitwiseXOR(b)))
_put("bitwise_invert", _bits(lambda a: ~a, lambda a: F.bitwise_not(a)), np.invert)


def _shift(left: bool):
    def shifted(a: Column, n: Column) -> Column:
        # Spark takes the count modulo 64; a count of the width or more empties the value
        a, k = a.cast("long"), n.cast("int").bitwiseAND(F.lit(63))
        moved = F.call_function("shiftleft", a, k) if left else F.call_function("shiftright", a, k)
        over = F.lit(0).cast("long") if left else F.when(a < 0, F.lit(-1)).otherwise(F.lit(0)).cast("long")
        return F.when((n >= 0) & (n < 64), moved).otherwise(over)

    return shifted


_put("bitwise_left_shift", _bits(lambda a, n: F.lit(None), _shift(True)), np.left_shift)
_put("bitwise_right_shift", _bits(lambda a, n: F.lit(None), _shift(False)), np.right_shift)

#: NumPy functions by which a caller may name an entry.
BY_NUMPY = {f.numpy: f for f in REGISTRY.values()}
ALIASES = {
    "bitwise_not": "bitwise_invert", "invert": "bitwise_invert", "power": "pow", "mod": "remainder", "absolute": "abs",
    "true_divide": "divide", "conjugate": "conj", "left_shift": "bitwise_left_shift", "right_shift": "bitwise_right_shift",
    "arcsin": "asin", "arccos": "acos", "arctan": "atan", "arcsinh": "asinh", "arccosh": "acosh", "arctanh": "atanh", "arctan2": "atan2",
}


def find(func) -> Function | None:
    """The entry for a name, an entry or a NumPy function."""
    if isinstance(func, Function):
        return func
    if isinstance(func, str):
        return REGISTRY.get(ALIASES.get(func, func))
    return BY_NUMPY.get(func)


def common_type(func: Function, dtypes: list[np.dtype], out: np.dtype) -> np.dtype:
    """The type in which operands are compared and computed."""
    return np.result_type(*dtypes) if dtypes else out


__all__ = ["ALIASES", "REGISTRY", "Function", "common_type", "find", "literal"]
