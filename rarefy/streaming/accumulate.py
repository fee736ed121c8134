"""Streams of cells, summed by coordinate: a tensor per time window, or one that keeps growing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_cells(spark: SparkSession, path: str, schema: T.StructType | str, **options) -> DataFrame:
    """A stream over Parquet files that keep arriving in a folder."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def accumulate(cells: DataFrame, coords: list[str], value: str, *, time: str | None = None, window: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Sums repeated coordinates of a stream (or a batch) of cells.

    With a time column and a window, each window is a tensor of its own: state is dropped once the
    watermark has passed its end, and later cells of it are late. Without a window, the state is
    the tensor itself and grows with its stored cells.
    """
    places = [F.col(c).cast("long").alias(f"d{i}") for i, c in enumerate(coords)]
    if window is None:
        return cells.select(*places, F.col(value).alias("v")).groupBy(*(f"d{i}" for i in range(len(coords)))).agg(F.sum("v").alias("v"))
    if time is None:
        raise ValueError("a window needs a time column")
    dated = cells.select(F.col(time).alias("_t"), *places, F.col(value).alias("v")).withWatermark("_t", watermark)
    grouped = dated.groupBy(F.window("_t", window).alias("w"), *(f"d{i}" for i in range(len(coords)))).agg(F.sum("v").alias("v"))
    return grouped.select(F.col("w.start").alias("start"), *(f"d{i}" for i in range(len(coords))), "v")
