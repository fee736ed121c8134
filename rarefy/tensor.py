"""The tensor: a DataFrame of stored cells and driver-side metadata.

Rows are ``d0, …, dn-1`` (longs) and ``v``; coordinates are unique and within the shape; a cell
without a row has the fill value. Nothing here starts a job: operators map plans to plans.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions.types import literal, same, spark_type

FORMATS = ("coo", "gcxs", "csr", "csc", "dok")


def names(n: int) -> list[str]:
    return [f"d{i}" for i in range(n)]


def normalize_axis(axis, ndim: int):
    """Non-negative axes; None, an int or a tuple, as given."""
    if axis is None:
        return None
    if isinstance(axis, Iterable):
        out = tuple(normalize_axis(a, ndim) for a in axis)
        if len(set(out)) != len(out):
            raise ValueError("repeated axis")
        return out
    if int(axis) != axis:
        raise ValueError(f"axis must be an integer, not {axis!r}")
    axis = int(axis)
    if not -ndim <= axis < ndim:
        raise ValueError(f"axis {axis} is out of bounds for {ndim} dimensions")
    return axis % ndim


class Origin(NamedTuple):
    """Rows with unique coordinates, and what a tensor makes of each: a value, and whether it is stored.

    A row that isn't stored has the tensor's fill value, as cells without a row have. keep: None
    where all are stored, True where those are that differ from the fill value. steps: the functions
    in the value, of which each is written out where it is used.
    """

    df: DataFrame
    value: Column
    keep: Column | bool | None = None
    steps: int = 1


#: Values of more functions aren't written out: an exchange keeps the next ones apart.
MOST_STEPS = 16


class Tensor(np.lib.mixins.NDArrayOperatorsMixin):
    """A mostly-empty n-dimensional array over Spark.

    layout is a hint of how rows are laid out ("coo", "gcxs" with compressed_axes, "csr", "csc",
    "dok"); it never changes results. unique=False says that coordinates may repeat. cells is about
    how many cells are stored, where that is known without a job; only plans depend on it. origin
    tells that the rows are a projection of another tensor's: functions of tensors with one origin
    are again a projection of it, without an exchange.
    """

    __array_priority__ = 12

    def __init__(self, df: DataFrame, shape, fill_value=0, dtype="float64", layout: str = "coo", compressed_axes=None, cells: float | None = None, origin: Origin | None = None):
        self.shape = tuple(int(s) for s in shape)
        if any(s < 0 for s in self.shape):
            raise ValueError("dimensions can't be negative")
        self.dtype = np.dtype(dtype)
        self.fill_value = np.zeros((), self.dtype)[()] if self.dtype.fields else np.asarray(fill_value).astype(self.dtype)[()]
        wanted = [*names(self.ndim), "v"]
        self.df = df if df.columns == wanted else df.select(*wanted)
        if layout not in FORMATS:
            raise ValueError(f"unknown format {layout!r}")
        self.layout, self.compressed_axes = layout, compressed_axes
        self.cells = float(min(self.size, self.size if cells is None else cells))
        self._origin = origin
        self._nnz: int | None = None

    # ------------------------------------------------------------ metadata

    @property
    def ndim(self) -> int:
        return len(self.shape)

    @property
    def size(self) -> int:
        return math.prod(self.shape)

    @property
    def columns(self) -> list[str]:
        """The coordinates' columns in df."""
        return names(self.ndim)

    @property
    def format(self) -> str:
        return self.layout

    @property
    def nnz(self) -> int:
        """Stored cells; counts them once."""
        if self._nnz is None:
            self._nnz = self.df.count()
        return self._nnz

    @property
    def density(self) -> float:
        return self.nnz / self.size if self.size else float("nan")

    @property
    def nbytes(self) -> int:
        return self.nnz * (8 * self.ndim + self.dtype.itemsize)

    @property
    def device(self) -> str:
        return "cpu"

    def to_device(self, device, *, stream=None) -> Tensor:
        if device != "cpu" or stream is not None:
            raise ValueError("there is only the device 'cpu'")
        return self

    def __len__(self) -> int:
        if not self.shape:
            raise TypeError("a 0-D tensor has no length")
        return self.shape[0]

    def __repr__(self) -> str:
        return f"<Tensor: shape={self.shape}, dtype={self.dtype}, fill_value={self.fill_value}, format={self.layout}>"

    def _repr_html_(self) -> str:
        rows = {"Format": self.layout, "Data type": self.dtype, "Shape": self.shape, "Fill value": self.fill_value, "Size": self.size}
        return "<table>" + "".join(f"<tr><th>{k}</th><td>{v}</td></tr>" for k, v in rows.items()) + "</table>"

    @property
    def origin(self) -> Origin:
        return self._origin or Origin(self.df, F.col("v"))

    def ended(self) -> Tensor:
        """The same, with its own rows as the origin of what is made of it alone."""
        self._origin = Origin(self.df, F.col("v"), None, MOST_STEPS)
        return self

    # ------------------------------------------------------------ making new ones

    def new(self, df: DataFrame, shape=None, fill_value=None, dtype=None, layout: str = "coo") -> Tensor:
        shape = self.shape if shape is None else shape
        return Tensor(
            df,
            shape,
            self.fill_value if fill_value is None else fill_value,
            self.dtype if dtype is None else dtype,
            layout,
            cells=self.cells if math.prod(map(int, shape)) == self.size else None,
        )

    def pruned(self) -> Tensor:
        """Without stored cells that equal the fill value."""
        out = self.new(self.df.where(~same(F.col("v"), self.fill_value, self.dtype)), layout=self.layout)
        # complex values and structs aren't written out
        if self.dtype.kind in "biuf" and self.origin.steps < MOST_STEPS:
            df, value, _, steps = self.origin
            if self.dtype.kind == "f" and self.fill_value == 0:
                # a zero that isn't stored has the fill's sign
                value = -(-value + self.lit(0)) if np.signbit(self.fill_value) else value + self.lit(0)
            out._origin = Origin(df, value, True, steps)
        return out

    def summed(self) -> Tensor:
        """Repeated coordinates become one cell with their sum (for booleans: any)."""
        v = F.col("v")
        if self.dtype.kind == "b":
            total = F.bool_or(v)
        elif self.dtype.kind == "c":
            total = F.struct(F.sum("v.re").alias("re"), F.sum("v.im").alias("im"))
        else:
            total = F.sum(v).cast(spark_type(self.dtype))
        grouped = self.df.groupBy(*self.columns) if self.ndim else self.df.groupBy(F.lit(0).alias("_one"))
        return self.new(grouped.agg(total.alias("v")), layout=self.layout)

    def lit(self, value=None):
        return literal(self.fill_value if value is None else value, self.dtype)

    # ------------------------------------------------------------ leaving Spark

    def collected(self) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates (ndim, nnz) and values on the driver, in C order."""
        t = self.df.toArrow() if self.dtype.kind != "c" and not self.dtype.fields else None
        if t is None:
            rows = self.df.collect()
            coords = np.array([[r[c] for r in rows] for c in self.columns], np.int64).reshape(self.ndim, len(rows))
            data = np.array([complex(*r["v"]) if self.dtype.kind == "c" else tuple(r["v"]) for r in rows], self.dtype)
        else:
            coords = np.array([t.column(c).to_numpy() for c in self.columns], np.int64).reshape(self.ndim, t.num_rows)
            data = np.array(t.column("v").to_pylist() if self.dtype.name == "uint64" else t.column("v").to_numpy(zero_copy_only=False)).astype(self.dtype)
        order = np.lexsort(coords[::-1]) if self.ndim else slice(None)
        return coords[:, order] if self.ndim else coords, data[order]

    @property
    def coords(self) -> np.ndarray:
        """Coordinates (ndim, nnz) on the driver, in C order; df stays distributed."""
        return self.collected()[0]

    @property
    def data(self) -> np.ndarray:
        """Stored values on the driver, in C order of their coordinates."""
        return self.collected()[1]

    def linear_loc(self) -> np.ndarray:
        """Places of the stored cells in C order, on the driver."""
        coords = self.coords
        out = np.zeros(coords.shape[1], np.int64)
        for c, n in zip(coords, self.shape):
            out = out * n + c
        return out

    def __dask_tokenize__(self):
        coords, data = self.collected()
        return "tensor", self.shape, self.dtype.str, repr(self.fill_value), coords.tobytes(), data.tobytes()

    def todense(self) -> np.ndarray:
        """The whole array on the driver: for results known to be small."""
        out = np.full(self.shape, self.fill_value, self.dtype)
        coords, data = self.collected()
        if len(data):
            out[tuple(coords)] = data if self.ndim else data[0]
        return out

    def item(self):
        if self.size != 1:
            raise ValueError("only a tensor of one cell is a scalar")
        return self.todense().reshape(-1)[0].item()

    def maybe_densify(self, max_size: int = 1000, min_density: float = 0.25) -> np.ndarray:
        if self.size > max_size and self.density < min_density:
            raise ValueError("the dense array would be too large")
        return self.todense()

    def __array__(self, dtype=None, copy=None):
        raise RuntimeError("a tensor isn't made dense implicitly; use todense()")

    def _scalar(self, kind):
        if self.ndim:
            raise TypeError("only 0-D tensors are scalars")
        return kind(self.todense()[()])

    def __bool__(self):
        return self._scalar(bool)

    def __float__(self):
        return self._scalar(float)

    def __int__(self):
        return self._scalar(int)

    def __complex__(self):
        return self._scalar(complex)

    def __index__(self):
        if self.dtype.kind not in "iu":
            raise TypeError("only integers are indices")
        return self._scalar(int)

    # ------------------------------------------------------------ NumPy's protocols

    def __array_namespace__(self, *, api_version=None):
        from . import api

        if api_version not in (None, "2021.12", "2022.12", "2023.12", "2024.12"):
            raise ValueError(f"API version {api_version} isn't supported")
        return api

    def __array_ufunc__(self, ufunc, method, *inputs, out=None, **kwargs):
        from .operators import elementwise, linalg, reduce

        if method == "__call__":
            if ufunc is np.matmul:
                result = linalg.matmul(*inputs)
            else:
                result = elementwise.elemwise(ufunc, *inputs, **kwargs)
        elif method == "reduce":
            result = reduce.by_ufunc(inputs[0], ufunc, kwargs.get("axis", 0), kwargs.get("keepdims", False))
        elif method == "outer":
            a, b = inputs
            wide = elementwise.as_tensor(a)
            other = elementwise.as_tensor(b)
            result = elementwise.elemwise(ufunc, wide.reshape(wide.shape + (1,) * other.ndim), other)
        else:
            return NotImplemented
        if out is not None:
            (target,) = out
            if not isinstance(target, Tensor) or target.shape != result.shape:
                raise ValueError("out must be a tensor of the result's shape")
            target.__dict__.update(result.astype(target.dtype).__dict__)
            return target
        return result

    def __array_function__(self, func, types, args, kwargs):
        from . import api

        own = getattr(api, {"amax": "max", "amin": "min", "around": "round"}.get(func.__name__, func.__name__), None)
        if own is None:
            return NotImplemented
        return own(*args, **kwargs)

    def __matmul__(self, other):
        from .operators import linalg

        return linalg.matmul(self, other)

    def __rmatmul__(self, other):
        from .operators import linalg

        return linalg.matmul(other, self)

    def __getitem__(self, key):
        from .operators import index

        return index.getitem(self, key)

    # ------------------------------------------------------------ methods that name functions

    @property
    def T(self) -> Tensor:
        return self.transpose()

    @property
    def mT(self) -> Tensor:
        if self.ndim < 2:
            raise ValueError("a matrix has two dimensions at least")
        return self.swapaxes(-1, -2)

    @property
    def real(self) -> Tensor:
        return self._call("real")

    @property
    def imag(self) -> Tensor:
        return self._call("imag")

    def _call(self, name, *args, **kwargs):
        from . import api

        return getattr(api, name)(self, *args, **kwargs)

    def transpose(self, axes=None) -> Tensor:
        return self._call("permute_dims", axes)

    def swapaxes(self, axis1: int, axis2: int) -> Tensor:
        order = list(range(self.ndim))
        a, b = normalize_axis((axis1, axis2), self.ndim) if axis1 % self.ndim != axis2 % self.ndim else (0, 0)
        order[a], order[b] = order[b], order[a]
        return self.transpose(order)

    def reshape(self, *shape, order="C") -> Tensor:
        return self._call("reshape", shape[0] if len(shape) == 1 and not np.isscalar(shape[0]) else shape, order=order)

    def flatten(self, order="C") -> Tensor:
        return self.reshape((-1,), order=order)

    def squeeze(self, axis=None) -> Tensor:
        return self._call("squeeze", axis)

    def resize(self, *shape, order="C") -> Tensor:
        return self._call("resize", shape[0] if len(shape) == 1 and not np.isscalar(shape[0]) else shape, order=order)

    def broadcast_to(self, shape) -> Tensor:
        return self._call("broadcast_to", shape)

    def astype(self, dtype, casting="unsafe", copy=True) -> Tensor:
        if not np.can_cast(self.dtype, dtype, casting):
            raise TypeError(f"{self.dtype} can't be cast to {np.dtype(dtype)} under the rule {casting!r}")
        return self._call("astype", dtype)

    def round(self, decimals=0, out=None) -> Tensor:
        return self._call("round", decimals)

    def clip(self, min=None, max=None, out=None) -> Tensor:  # noqa: A002
        return self._call("clip", min, max)

    def conj(self) -> Tensor:
        return self._call("conj")

    def dot(self, other):
        return self._call("dot", other)

    def nonzero(self):
        return self._call("nonzero")

    def isinf(self) -> Tensor:
        return self._call("isinf")

    def isnan(self) -> Tensor:
        return self._call("isnan")

    def reduce(self, method, axis=(0,), keepdims=False, **kwargs) -> Tensor:
        from .operators import reduce

        return reduce.by_ufunc(self, method, axis, keepdims)

    def copy(self, deep=True) -> Tensor:
        out = self.new(self.df, layout=self.layout)
        out._origin = self._origin
        return out

    def asformat(self, format, **kwargs):  # noqa: A002
        from .plans import layout

        return layout.asformat(self, format, **kwargs)

    def tocoo(self) -> Tensor:
        return self.asformat("coo")

    def tocsr(self) -> Tensor:
        return self.asformat("csr")

    def tocsc(self) -> Tensor:
        return self.asformat("csc")

    def todok(self):
        return self.asformat("dok")

    def change_compressed_axes(self, axes) -> Tensor:
        return self.asformat("gcxs", compressed_axes=axes)

    def enable_caching(self) -> Tensor:
        """Keeps the rows after the first action that makes them."""
        self.df, self._origin = self.df.persist(), None
        return self


def _reduction(name):
    def method(self, axis=None, keepdims=False, **kwargs):
        kwargs = {k: v for k, v in kwargs.items() if k != "out"}
        if "ddof" in kwargs:
            kwargs["correction"] = kwargs.pop("ddof")
        return self._call(name, axis=axis, keepdims=keepdims, **kwargs)

    method.__name__ = name
    return method


for _name in ("sum", "prod", "max", "min", "any", "all", "mean", "var", "std", "argmax", "argmin"):
    setattr(Tensor, _name, _reduction(_name))
Tensor.amax, Tensor.amin = Tensor.max, Tensor.min
