"""Reading and writing tensors."""

from __future__ import annotations

import json

import numpy as np

from ..functions.types import python_value
from ..plans import layout
from ..tensor import Tensor
from .create import _frame, as_coo, coo, session


def save_npz(filename, matrix, compressed=True) -> None:
    """One driver file for small tensors: coordinates, values, shape and fill value."""
    if isinstance(matrix, layout.DOK):
        matrix = matrix.to_coo()
    coords, data = matrix.collected()
    parts = {"data": data, "shape": np.array(matrix.shape, np.int64), "fill_value": np.asarray(matrix.fill_value)}
    if matrix.layout in ("gcxs", "csr", "csc") and matrix.ndim:
        axes = tuple(matrix.compressed_axes)
        rest = [i for i in range(matrix.ndim) if i not in axes]
        rows = np.ravel_multi_index([coords[i] for i in axes], [matrix.shape[i] for i in axes])
        cols = np.ravel_multi_index([coords[i] for i in rest], [matrix.shape[i] for i in rest]) if rest else np.zeros_like(rows)
        order = np.lexsort((cols, rows))
        n = int(np.prod([matrix.shape[i] for i in axes]))
        parts |= {"data": data[order], "indices": cols[order], "indptr": np.r_[0, np.cumsum(np.bincount(rows, minlength=n))], "compressed_axes": np.array(axes)}
    else:
        parts["coords"] = coords
    (np.savez_compressed if compressed else np.savez)(filename, **parts)


def load_npz(filename) -> Tensor:
    with np.load(filename) as f:
        if "coords" in f:
            return coo(f["coords"], f["data"], tuple(f["shape"]), fill_value=f["fill_value"][()])
        if not {"indices", "indptr", "compressed_axes"} <= set(f):
            raise RuntimeError(f"{filename} holds no tensor")
        shape, axes = tuple(map(int, f["shape"])), tuple(map(int, f["compressed_axes"]))
        rest = [i for i in range(len(shape)) if i not in axes]
        rows = np.repeat(np.arange(len(f["indptr"]) - 1), np.diff(f["indptr"]))
        coords = np.zeros((len(shape), len(rows)), np.int64)
        coords[list(axes)] = np.unravel_index(rows, [shape[i] for i in axes])
        if rest:
            coords[rest] = np.unravel_index(f["indices"], [shape[i] for i in rest])
        out = coo(coords, f["data"], shape, fill_value=f["fill_value"][()])
        return layout.asformat(out, "gcxs", compressed_axes=axes)


def save_parquet(path: str, x: Tensor, partitions: int | None = None) -> None:
    """Rows as Parquet, clustered by the layout so that slices skip row groups, and a sidecar with the metadata."""
    df = layout.clustered(x, partitions) if x.layout in ("gcxs", "csr", "csc") and x.ndim else x.df
    df.write.parquet(f"{path}/cells")
    fill = python_value(x.fill_value)
    meta = {"shape": x.shape, "dtype": x.dtype.str, "fill": repr(complex(*fill)) if isinstance(fill, tuple) else repr(fill), "layout": x.layout, "axes": x.compressed_axes}
    session().createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")


def load_parquet(path: str) -> Tensor:
    meta = json.loads(session().read.text(f"{path}/meta").first()[0])
    dtype = np.dtype(meta["dtype"])
    special = {"nan": np.nan, "inf": np.inf, "-inf": -np.inf, "True": True, "False": False}
    fill = special[meta["fill"]] if meta["fill"] in special else complex(meta["fill"]) if dtype.kind == "c" else dtype.type(meta["fill"])
    return Tensor(session().read.parquet(f"{path}/cells"), meta["shape"], fill, dtype, meta["layout"], tuple(meta["axes"]) if meta["axes"] else None)


def from_scipy(x, fill_value=None) -> Tensor:
    """From any object that gives its coordinates, as SciPy's matrices do."""
    c = x.tocoo()
    coords = np.stack([np.asarray(i) for i in getattr(c, "coords", (c.row, c.col))]).astype(np.int64)
    out = Tensor(_frame(coords, np.asarray(c.data)), c.shape, 0 if fill_value is None else fill_value, c.data.dtype).summed().pruned()
    return layout.asformat(out, x.format) if getattr(x, "format", "coo") in ("csr", "csc") else out


def to_scipy(x: Tensor, accept_fv=None):
    accepted = [0] if accept_fv is None else np.atleast_1d(accept_fv).tolist()
    if not any(x.fill_value == a or (a != a and x.fill_value != x.fill_value) for a in accepted):
        raise ValueError(f"the fill value must be one of {accepted}")
    if x.ndim != 2:
        raise ValueError("SciPy's matrices have two dimensions")
    from ..compat import scipy_matrix

    coords, data = x.collected()
    out = scipy_matrix(coords, data, x.shape)
    return out.asformat(x.layout) if x.layout in ("csr", "csc") else out


def asnumpy(a, dtype=None, order=None) -> np.ndarray:
    a = a.todense() if isinstance(a, (Tensor, layout.DOK)) else a
    return np.asarray(a, dtype=dtype, order=order)


def from_constituent_arrays(*, format, arrays, shape) -> Tensor:  # noqa: A002
    """From a format's own buffers: (indptr, indices, data) of csr and csc, (coords…, data) of coo."""
    name = layout.format_to_string(format)
    if name == "coo":
        *coords, data = arrays
        return coo(np.stack([np.asarray(c) for c in coords]), data, shape)
    indptr, indices, data = map(np.asarray, arrays)
    major = np.repeat(np.arange(len(indptr) - 1), np.diff(indptr))
    coords = np.stack([major, indices] if name == "csr" else [indices, major])
    return layout.asformat(coo(coords, data, shape), name)


__all__ = ["as_coo", "asnumpy", "from_constituent_arrays", "from_scipy", "load_npz", "load_parquet", "save_npz", "save_parquet", "to_scipy"]
