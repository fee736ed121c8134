"""Exact deduplication against a persistent digest index, in DataFrame operations only.

The index is a table of digests, bucketed and sorted by digest. A batch is first reduced to one
row per digest (pre-aggregated before its shuffle, so a text that fills a third of all rows is
one row per task), then compared with the index by a sort-merge anti-join whose index side needs
neither exchange nor sort, and what is new is appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import at_end, documents, materialize, partitions, raw, scratch


class DigestIndex:
    """A persistent table ``digest, keep_id, group_size``.

    name: of the table in the session's catalog; path: where its files lie, in a folder that all
    executors share. Opening an existing path again continues that index. buckets: fixed for the
    life of an index; about one per 100 MB of digests (two million texts).
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int):
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Adds the groups (one row per digest) whose digest the index doesn't have."""
        new = groups.hint("merge").join(self.rows().select("digest"), "digest", "left_anti")
        (
            new.repartition(self.buckets, "digest")
            .select("digest", "keep_id", "group_size")
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .option("path", self.path)
            .saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def lookup(self, groups: DataFrame) -> DataFrame:
        """``digest, keep_id, group_size`` of the groups (one row per digest): ids from the index, sizes from the groups.

        The index's files are read bucket by bucket, without an exchange or a sort of them.
        """
        return groups.select("digest", "group_size").hint("merge").join(self.rows().select("digest", "keep_id"), "digest")

    def drop(self) -> None:
        """Takes the table out of the catalog and empties its folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.spark.range(0).write.mode("overwrite").parquet(self.path)


def digest(column: str = "text"):
    """SHA-256 of the text's bytes as they are; null counts as empty."""
    return F.unhex(F.sha2(raw(column), 256))


def groups_of(docs: DataFrame) -> DataFrame:
    return docs.groupBy(digest().alias("digest")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))


def open_index(spark: SparkSession, name: str | None = None, path: str | None = None, buckets: int | None = None) -> DigestIndex:
    """An index by name and path; without them a new one, which goes with the ``scratch_tables`` around it."""
    new = name is None and path is None
    name = name or f"digest_index_{uuid.uuid4().hex[:12]}"
    index = DigestIndex(spark, name, path or f"{scratch(spark)}/{name}", buckets or partitions(spark))
    if new:
        at_end(index.drop)
    return index


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    * of equal texts in one batch the row with the largest ``doc_id`` stays; a text that the index
      had before keeps its earlier row, and all rows of the batch with it are dropped;
    * group_size counts the rows of this batch with the text, whatever the index had before;
    * null texts equal empty ones; a null ``doc_id`` stays only if its whole group has none;
    * rows repeated with their ``doc_id`` are one document and share its verdict;
    * an empty table adds nothing and gives an empty result; other columns are ignored.
    """
    groups = materialize(groups_of(docs), "groups")
    index.append(groups)
    # both sides of the last join are exchanged, so that adaptive execution can split a digest that very many rows have
    verdict = materialize(index.lookup(groups), "verdicts")
    return docs.select("doc_id", digest().alias("digest")).join(verdict.hint("merge"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without exact copies: of equal texts the largest ``doc_id`` stays.

    * the verdict is on a doc_id with its text: rows that repeat both are one document and all stay,
      and so do the rows of a text that has no doc_id at all (near dedup keeps one of them);
    * null texts equal empty ones; ties between ids can't arise;
    * an empty table stays empty; columns keep their names and order, whatever they are.
    """
    verdict = deduplicate(docs, open_index(docs.sparkSession))
    stays = verdict.where("kept and doc_id is not null").select(F.col("doc_id").alias("id"), F.unhex("text_sha256").alias("sha")).distinct()
    kept = docs.join(stays, (docs["doc_id"] == stays["id"]) & (digest() == stays["sha"]), "left_semi")
    lone = verdict.where("doc_id is null and keep_id is null").select(F.unhex("text_sha256").alias("digest")).distinct()
    nameless = docs.where("doc_id is null").join(lone, digest() == lone["digest"], "left_semi")
    return kept.union(nameless)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(documents(spark, sf_dir), open_index(spark))


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
"""
