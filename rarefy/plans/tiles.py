"""Products whose pairs of cells are many more than the cells: summed tile by tile, where the pairs are made.

A join makes a row of each pair, and a sum after it exchanges most of them. Here the result is dealt
into square tiles; a cell of either side goes to those tiles only in which it meets one of the other
side, and a task sums a tile's pairs in an array. So what is exchanged grows with the cells and with
the blocks that an index of the sum has cells in. A task holds one tile and one piece of its cells.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tiles have at least and at most 2 ** these rows and columns.
LOW_BITS, HIGH_BITS = 10, 12
#: Rows that are multiplied together, pairs that are made at once, indices of a sum in one dense product.
PIECE, PAIRS, INNER = 1 << 18, 1 << 21, 512
#: A dense product costs about as much for each place as this part of a pair.
DENSE = 100
#: Places (tile, row, column) of a tile's pairs that are kept as a list before they become an array.
LISTED = 1 << 20


def linear(columns: list[str], sizes: list[int]) -> Column:
    """The columns' place in C order."""
    out = F.lit(0).cast("long")
    for c, n in zip(columns, sizes):
        out = out * F.lit(n) + F.col(c)
    return out


def split(column: str, columns: list[str], sizes: list[int]) -> list[Column]:
    """The columns back from their place."""
    out, step = [], math.prod(sizes)
    for c, n in zip(columns, sizes):
        step //= max(1, n)
        out.append((F.call_function("div", F.col(column), F.lit(step).cast("long")) % F.lit(n)).alias(c))
    return out


def product(a: DataFrame, b: DataFrame, rows: list[str], inner: list[str], columns: list[str], sizes: dict[str, int], dtype: np.dtype) -> DataFrame:
    """(rows…, columns…, v): the sum over inner of a's (rows…, inner…, v) times b's (inner…, columns…, v).

    Sums that are zero have no row. Integers are exact; those beyond 64 bits raise under ANSI mode and wrap otherwise.
    """
    of = lambda labels: [sizes[c] for c in labels]
    spark = a.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    places = math.prod(of(rows)) * math.prod(of(columns))
    # enough tiles for every task to have several
    bits = min(HIGH_BITS, max(LOW_BITS, int(math.log2(max(1, places / (4 * n))) / 2)))
    block, low = lambda c: F.shiftright(c, bits), lambda c: (F.col(c).bitwiseAND(F.lit((1 << bits) - 1))).cast("int")
    left = a.select(linear(inner, of(inner)).alias("k"), linear(rows, of(rows)).alias("at"), "v")
    right = b.select(linear(inner, of(inner)).alias("k"), linear(columns, of(columns)).alias("at"), "v")
    # the blocks in which an index of the sum has cells
    in_left = left.select("k", block("at").alias("i")).distinct()
    in_right = right.select("k", block("at").alias("j")).distinct()
    left = left.join(in_right, "k").select(block("at").alias("i"), "j", "k", F.lit(False).alias("right"), low("at").alias("at"), "v")
    right = right.join(in_left, "k").select("i", block("at").alias("j"), "k", F.lit(True).alias("right"), low("at").alias("at"), "v")
    cells = left.union(right).repartition(n, "i", "j").sortWithinPartitions("i", "j", "k", "right")
    wraps = spark.conf.get("spark.sql.ansi.enabled", "true").lower() != "true"
    kind = "double" if dtype.kind == "f" else "long"
    found = cells.mapInArrow(lambda batches: _tiles(batches, bits, dtype, wraps), f"i long, j long, v {kind}")
    return found.select(*split("i", rows, of(rows)), *split("j", columns, of(columns)), "v")


def _tiles(batches: Iterator[pa.RecordBatch], bits: int, dtype: np.dtype, wraps: bool) -> Iterator[pa.RecordBatch]:
    """Cells in order of tile and index of the sum, to the tiles' cells."""
    tile, waiting, rows = None, [], 0

    def pieces(final: bool):
        # all but the last index's cells, which may go on in the next batch
        nonlocal waiting, rows
        table = [np.concatenate(c) for c in zip(*waiting)]
        i, j, k = table[:3]
        changes = np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1]) | (k[1:] != k[:-1])) + 1
        end = len(i) if final else int(changes[-1]) if len(changes) else 0
        waiting = [[c[end:] for c in table]]
        rows = len(i) - end
        starts = np.r_[0, changes[changes < end]] if end else changes[:0]
        fresh = np.flatnonzero((i[starts][1:] != i[starts][:-1]) | (j[starts][1:] != j[starts][:-1])) + 1
        for runs, stop in zip(np.split(starts, fresh), [*starts[fresh], end]) if end else []:
            yield (int(i[runs[0]]), int(j[runs[0]])), runs - runs[0], *(c[runs[0] : stop] for c in table[3:])

    def add(final: bool):
        nonlocal tile
        for place, runs, right, at, v in pieces(final):
            if tile is not None and tile.place != place:
                yield from tile.cells()
                tile = None
            tile = tile or _Tile(place, bits, dtype, wraps)
            tile.add(runs, right, at, v)

    for b in batches:
        if not b.num_rows:
            continue
        waiting.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        rows += b.num_rows
        if rows >= PIECE:
            yield from add(False)
    if rows:
        yield from add(True)
    if tile is not None:
        yield from tile.cells()


class _Tile:
    """The sums of one tile: a list of places and values while they are few, an array then."""

    def __init__(self, place: tuple[int, int], bits: int, dtype: np.dtype, wraps: bool):
        self.place, self.bits, self.wraps = place, bits, wraps
        self.dtype = np.dtype("float64" if dtype.kind == "f" else "int64")
        self.listed: list[tuple[np.ndarray, np.ndarray]] = []
        self.length = 0
        self.sums: np.ndarray | None = None
        #: No sum is beyond this; from 2 ** 62 on, sums are taken in doubles beside those that may wrap.
        self.bound, self.near = 0, None

    def add(self, runs: np.ndarray, right: np.ndarray, at: np.ndarray, v: np.ndarray) -> None:
        """Cells with an index of the sum each: runs of one index begin at runs, the left side's cells first."""
        run = np.repeat(np.arange(len(runs)), np.diff(np.r_[runs, len(at)]))
        a, b = np.flatnonzero(~right), np.flatnonzero(right)
        if not len(a) or not len(b):
            return
        n_left, n_right = np.bincount(run[a], minlength=len(runs)), np.bincount(run[b], minlength=len(runs))
        pairs = int(n_left @ n_right)
        if self.dtype.kind == "i":
            self.bound += max(abs(int(v[a].min())), abs(int(v[a].max()))) * max(abs(int(v[b].min())), abs(int(v[b].max()))) * pairs
            if self.bound >= 1 << 62 and self.near is None:
                self._spread()
                self.near = self.sums.astype("float64")
        height, width = (int(at[x].max()) - int(at[x].min()) + 1 for x in (a, b))
        if pairs > LISTED // 8 and height * width * len(runs) < pairs * DENSE and self.near is None and (self.dtype.kind == "i" or np.isfinite(v).all()):
            self._dense(len(runs), run, a, b, at, v)
            return
        each = n_right[run[a]]
        ends = np.cumsum(each)
        first = np.r_[0, np.cumsum(n_right)[:-1]]
        done = 0
        while done < len(a):
            made = int(ends[done - 1]) if done else 0
            stop = max(done + 1, int(np.searchsorted(ends, made + PAIRS, "right")))
            part = slice(done, stop)
            count = each[part]
            l = np.repeat(a[part], count)  # noqa: E741
            turn = np.arange(len(l)) - np.repeat(np.cumsum(count) - count, count)
            r = b[np.repeat(first[run[a[part]]], count) + turn]
            self._put((at[l].astype(np.int64) << self.bits) | at[r], v[l], v[r])
            done = stop

    def _put(self, places: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        with np.errstate(all="ignore"):
            values = x * y
        if self.sums is None and self.length + len(places) > LISTED:
            self._spread()
        if self.sums is None:
            self.listed.append((places, values))
            self.length += len(places)
            return
        np.add.at(self.sums, places, values)
        if self.near is not None:
            np.add.at(self.near, places, x.astype("float64") * y)

    def _spread(self) -> None:
        if self.sums is None:
            self.sums = np.zeros(1 << (2 * self.bits), self.dtype)
            for places, values in self.listed:
                np.add.at(self.sums, places, values)
            self.listed = []

    def _dense(self, n: int, run, a, b, at, v) -> None:
        """Where an index has cells in much of the tile, a matrix product makes the pairs."""
        self._spread()
        low = [int(at[x].min()) for x in (a, b)]
        size = [int(at[x].max()) - k + 1 for x, k in zip((a, b), low)]
        sums = self.sums.reshape(1 << self.bits, 1 << self.bits)[low[0] : low[0] + size[0], low[1] : low[1] + size[1]]
        top = math.prod(int(np.abs(v[x]).max()) for x in (a, b)) if self.dtype.kind == "i" else 0
        # doubles hold these integers exactly
        kind = np.dtype("float64") if top * INNER < 1 << 53 else self.dtype
        for k in range(0, n, INNER):
            sides = []
            for x, lo, m in zip((a, b), low, size):
                x = x[np.searchsorted(run[x], k) : np.searchsorted(run[x], k + INNER)]
                side = np.zeros((min(INNER, n - k), m), kind)
                side[run[x] - k, at[x] - lo] = v[x]
                sides.append(side)
            sums += (sides[0].T @ sides[1]).astype(self.dtype, copy=False)

    def cells(self) -> Iterator[pa.RecordBatch]:
        if self.sums is None:
            if not self.listed:
                return
            places, values = (np.concatenate(c) for c in zip(*self.listed))
            order = np.argsort(places, kind="stable")
            places, values = places[order], values[order]
            start = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
            places, values = places[start], np.add.reduceat(values, start)
            yield from self._rows(places, values)
            return
        if self.near is not None and not self.wraps and (np.abs(self.near - self.sums) > 2.0**62).any():
            raise ArithmeticError("a sum of products is beyond 64 bits")
        for k in range(0, len(self.sums), LISTED):
            piece = self.sums[k : k + LISTED]
            places = np.flatnonzero(piece)
            yield from self._rows(places + k, piece[places])

    def _rows(self, places: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        kept = values != 0
        places, values = places[kept], values[kept]
        i, j = ((p << self.bits) + at for p, at in zip(self.place, (places >> self.bits, places & ((1 << self.bits) - 1))))
        for k in range(0, len(places), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + (1 << 16)]) for c in (i, j, values)], ["i", "j", "v"])


# executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
__all__ = ["product"]
