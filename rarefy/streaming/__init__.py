"""Tensors that are still arriving."""

from .accumulate import accumulate, read_cells

__all__ = ["accumulate", "read_cells"]
