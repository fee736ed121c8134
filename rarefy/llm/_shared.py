"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to words.
WORD = r"[^\x20\x09-\x0D]+"


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session, whose executors are threads of this process, may leave it unset: a
    temporary folder stands in there. On a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = os.path.join(tempfile.gettempdir(), "rarefy-checkpoints")
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


#: Paths of tables that ``materialize`` wrote, by the innermost ``scratch_tables`` around it.
_WRITTEN: list[list] = []
_TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of the queries run inside go as soon as each has ended, not when the driver collects garbage."""
    before = spark.conf.get(_TIDY, None)
    spark.conf.set(_TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(_TIDY) if before is None else spark.conf.set(_TIDY, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes ``df`` as Parquet into the shared folder and reads it back."""
    path = f"{scratch(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    with tidy(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._rarefy_path = path
    if _WRITTEN:
        _WRITTEN[-1].append(lambda: discard(out))
    return out


@contextlib.contextmanager
def scratch_tables():
    """What operators write on the way inside, and nothing else, is emptied at the end."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for undo in _WRITTEN.pop():
            undo()


def at_end(undo) -> None:
    """Runs ``undo`` at the end of the innermost ``scratch_tables``; without one, never."""
    if _WRITTEN:
        _WRITTEN[-1].append(undo)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """Each row of ``docs`` as one value ``doc`` beside ``row``, a number that is stored with it.

    The number names a row whatever its doc_id: null, repeated, or shared by several texts.
    """
    whole = F.struct(*(docs[c] for c in docs.columns)).alias("doc")
    return materialize(docs.select(whole, F.monotonically_increasing_id().alias("row")), name)


def discard(*frames: DataFrame) -> None:
    """Empties tables of ``materialize`` that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_rarefy_path", None)
        if path:
            df._rarefy_path = None
            df.sparkSession.range(0).write.mode("overwrite").parquet(path)


def raw(column: str):
    """The UTF-8 bytes of a text column, null as empty; bytes survive texts that aren't valid UTF-8."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
