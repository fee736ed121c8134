"""Mixing sources to target weights by words, in DataFrame operations only.

Every document gets a hash-random key. Within its source, documents are ordered by key; keys are
cut into ranges, so that a source of any size is many small sorted ranges rather than one task.
Sums per range, then running sums over ranges and within each range, give every document the
number of words before it, and the source is cut where its budget ends, after as many whole
epochs as the budget holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import WORD, documents, materialize, numbered, partitions, raw

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
#: Documents that a key range holds on average.
RANGE_ROWS = 8192
SEED = "mix-1"


def _sized(docs: DataFrame, seed: str, *ties) -> DataFrame:
    """doc_id, source (as the pair no_source, name: joins and windows see nulls as a value), size, key; then ``ties``."""
    # rows without an id have a key by their text: they don't crowd in one place
    name = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.md5(raw("text"))))
    return docs.select(
        "doc_id",
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("name"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"),
        F.md5(name.cast("binary")).alias("key"),
        *ties,
    )


def _running(rows: DataFrame, keys: list, sums: dict[str, Column], name: str) -> DataFrame:
    """Adds, for each (name, column) of sums, the column's sum over the rows before this one in order of the (unique) keys.

    Rows are range-partitioned and sorted, and stored with their place, so that the ranges are the
    same for all that comes; a window goes over one range, and one over a row per range.
    """
    spark = rows.sparkSession
    placed = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    placed = materialize(placed, name).withColumn("_range", F.shiftright("_at", 33))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = placed.groupBy("_range").agg(*(F.sum(c).alias(f"_{x}") for x, c in sums.items()))
    starts = ranges.select("_range", *(F.coalesce(F.sum(f"_{x}").over(earlier), F.lit(0)).alias(f"_{x}") for x in sums))
    within = Window.partitionBy("_range").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(x) for x, c in sums.items()))
    # a row per partition
    return summed.join(F.broadcast(starts), "_range").select(*rows.columns, *((F.col(x) + F.col(f"_{x}")).alias(x) for x in sums))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Adds ``target`` to one row per source (no_source, name, source_size).

    Sources in code-point order, null last, have the weights in turn. The level at which
    sum(min(epochs * size, level * weight)) is the shared total comes from running sums over the
    sources in the order in which a rising level fills them. Sources may be as many as hosts are:
    both orders are ranges, and what is global is three sums and a minimum.
    """
    code_point = F.col("name").cast("binary")
    ranked = _running(sizes, ["no_source", code_point], {"turn": F.lit(1)}, "sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int"))
    cap = (F.col("source_size") * epochs).cast("double")
    out = ranked.withColumn("weight", weight.cast("long")).drop("turn").withColumn("full_at", cap / F.col("weight"))
    out = _running(out, ["full_at", "no_source", code_point], {"below": F.col("source_size"), "filled": F.col("weight")}, "levels")
    totals = out.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    out = out.crossJoin(F.broadcast(totals))  # one row
    level = (F.col("words") * F.lit(share) - F.col("below") * epochs) / (F.col("weights") - F.col("filled"))
    out = out.withColumn("level", level)
    # the first source that its level doesn't fill sets the level for all; levels rise until there
    first = out.agg(F.min(F.when(F.col("full_at") > F.col("level"), F.struct("full_at", "level"))).alias("first")).select(F.col("first.level").alias("first_level"))
    out = out.crossJoin(F.broadcast(first))
    return out.withColumn(
        "target", F.when(F.col("first_level").isNull(), cap).otherwise(F.least(cap, F.col("first_level") * F.col("weight")))
    ).select("no_source", "name", "source_size", "target")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken``.

    * size counts words; null and empty texts have none and nothing is taken of them;
    * a null source is a source of its own, last in order; target is a fraction of a word at times,
      and the cut is made at the nearest whole word, so the document at the cut is taken in part;
    * a null id has a key by its text; equal keys (repeated ids) are ordered by id, then size: rows
      that still tie are equal;
    * the same rows always give the same mix; an empty table gives an empty result.
    """
    return _taken(_sized(docs, seed), weights, share, epochs).select("doc_id", "size", "source_size", "target", "taken")


def _taken(sized: DataFrame, weights, share: float, epochs: int, ties=()) -> DataFrame:
    """The rows of ``_sized`` with source_size, target and taken; ``ties`` go on ordering where key, id and size are equal."""
    rows = materialize(sized, "sized")
    bits = max(0, (rows.count() // RANGE_ROWS)).bit_length()
    head = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("part", F.shiftright(head, 32 - bits) if bits else F.lit(0).cast("long"))
    source = ["no_source", "name"]
    ranges = rows.groupBy(*source, "part").agg(F.sum("size").alias("n"))
    plan = targets(ranges.groupBy(*source).agg(F.sum("n").alias("source_size")), weights, share, epochs)
    before = F.sum("n").over(Window.partitionBy(*source).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select(*source, "part", F.coalesce(before, F.lit(0)).alias("range_start")).join(plan, source)
    within = Window.partitionBy(*source, "part").orderBy("key", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0))).join(ranges, [*source, "part"])
    budget = F.floor(F.col("target") + 0.5).cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(budget / F.greatest("source_size", F.lit(1))).cast("long")).otherwise(F.lit(0))
    rest = F.col("budget") - F.col("rounds") * F.col("source_size") - F.col("range_start") - F.col("start")
    taken = F.col("rounds") * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest))
    return placed.withColumn("budget", budget).withColumn("rounds", rounds).withColumn("taken", taken.cast("long"))


def apply_mix(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: a document once for each epoch that takes words of it.

    Documents that the budget doesn't reach go; the one at a source's cut stays whole. Each row has
    its own verdict, so rows without a doc_id or with a repeated one come out as often as their
    ``taken`` says; those that ``mix`` leaves tied are ordered by a hash of their text. Null and
    empty texts have no words and go; null sources are a source; an empty table stays empty; columns
    keep their names and order, whatever they are.
    """
    # a document's columns travel as one value, so that no name of theirs can clash
    rows = numbered(docs, "mixed-rows")
    ties = [F.xxhash64(raw("doc.text")).alias("tie"), F.col("row")]
    sized = _sized(rows.select("doc.doc_id", "doc.source", "doc.text", "doc", "row"), SEED, *ties)
    copies = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    taken = _taken(sized, WEIGHTS, SHARE, EPOCHS, ("tie", "row")).select("row", copies.alias("copies")).where("copies > 0")
    return rows.join(taken, "row").select(F.explode(F.array_repeat("doc", F.col("copies"))).alias("r")).select("r.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, (source_size * 2)::DOUBLE / weight AS full_at FROM sources),
levels AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
             - coalesce(sum(source_size) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE * 2)
            / (sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
  FROM filled WINDOW f AS (ORDER BY full_at, source IS NULL, encode(source))),
plan AS (
  SELECT source, source_size,
         CASE WHEN l IS NULL THEN (source_size * 2)::DOUBLE ELSE least((source_size * 2)::DOUBLE, l * weight) END AS target
  FROM (SELECT *, (SELECT arg_min(level, full_at) FROM levels WHERE full_at > level) AS l FROM levels)),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, floor(p.target + 0.5)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source),
cut AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS rounds FROM placed)
SELECT doc_id, size, source_size, target,
       (rounds * size + greatest(0, least(size, budget - rounds * source_size - start)))::BIGINT AS taken
FROM cut
"""
