"""I-Match document fingerprints with randomised lexicons, in DataFrame operations only.

The lexicon is every term whose document frequency lies in a band, so that neither function
words nor one-off typos count. SUBSETS random parts of it, of four densities, each give one hash
over a text's sorted distinct terms in that part. Two texts are as alike as the share of parts,
among those that either touches, on which their hashes agree. Thin parts hold one or two terms
of a long text and survive large edits; dense parts serve short texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import documents, materialize

#: Least and greatest share of documents that have a term of the lexicon. A document with d
#: distinct terms adds d to all frequencies, so there are at most mean(d) / LOW such terms.
LOW, HIGH = 1 / 2000, 1 / 20
#: Below so many terms (some 64 bytes each) the lexicon is broadcast, else joined by sort-merge.
BROADCAST_TERMS = 1_000_000
DENSITIES = (12, 48, 128, 384)
SUBSETS = 60
_SEPARATOR = r"[^\p{L}\p{N}]+"
#: The term that every text has, so that texts without any lexicon term keep their row.
_ALWAYS = 0
#: Rows of a block of neighbouring ids, and most blocks that are named in a plan: three billion
#: documents in blocks of that size. Beyond, blocks are larger; each is sorted and read as a stream.
BLOCK_ROWS, MOST_BLOCKS = 1500, 1 << 21
_CHUNK = 128


def _terms(text: Column) -> Column:
    return F.array_distinct(F.split(F.lower(text), _SEPARATOR))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, subsets: int = SUBSETS) -> DataFrame:
    """``term`` (a 64-bit hash) and ``parts`` (the numbers of its subsets, ascending) of the terms in the band.

    Frequencies count every document. At least two documents must share a term, however few
    documents there are.
    """
    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    total = texts.count()
    terms = texts.select(F.explode(_terms(F.col("text"))).alias("t")).where("t <> ''").groupBy(F.xxhash64("t").alias("term")).count()
    banded = terms.where((F.col("count") >= max(2.0, low * total)) & (F.col("count") <= max(2.0, high * total)))
    parts = F.array_compact(
        F.array(*(F.when(F.pmod(F.xxhash64("term", F.lit(k)), F.lit(DENSITIES[k % len(DENSITIES)])) == 0, F.lit(k).cast("tinyint")) for k in range(subsets)))
    )
    # no filter on parts: it would be pushed below the aggregate, to every word of every text
    return banded.where(f"term <> {_ALWAYS}").select("term", parts.alias("parts"))


def signatures(rows: DataFrame, keys: list[str], payload: list[str], texts: dict[str, str], lex: DataFrame) -> DataFrame:
    """For rows with unique keys: payload, and for each (name, column) of texts the array ``name`` of
    (part, hash) of the subsets that have a term, in order.

    A term's rows carry the keys alone; the payload travels in one row, of a term that every text has.
    """
    names = list(texts)
    kept = F.struct(*payload)

    def tagged(n: int, column: str) -> Column:
        return F.transform(_terms(F.col(column)), lambda t: F.struct(F.lit(n).alias("which"), F.xxhash64(t).alias("term"), F.lit(None).cast(rows.select(kept.alias("p")).schema["p"].dataType).alias("kept")))

    found = [tagged(n, c) for n, c in enumerate(texts.values())]
    always = F.array(F.struct(F.lit(0).alias("which"), F.lit(_ALWAYS).cast("long").alias("term"), kept.alias("kept")))
    long = rows.select(*keys, F.explode(F.concat(always, *found)).alias("x")).select(*keys, "x.which", "x.term", "x.kept")
    hit = long.join(lex, "term").where("size(parts) > 0 or kept is not null")
    of = [F.collect_list(F.when((F.col("which") == n) & F.col("kept").isNull(), F.struct("parts", "term"))).alias(f"_{x}") for n, x in enumerate(names)]
    grouped = hit.groupBy(*keys).agg(F.first("kept", ignorenulls=True).alias("kept"), *of)
    return grouped.select(*keys, "kept.*", *(_subset_hashes(F.col(f"_{x}")).alias(x) for x in names))


def _subset_hashes(terms: Column) -> Column:
    """From a text's terms with their parts: for each part with a term (part, hash of its sorted distinct terms).

    One pass over the pairs in order of part and term; 24 bits a subset, so that a fingerprint stays short.
    """
    pairs = F.array_sort(F.flatten(F.transform(terms, lambda t: F.transform(t["parts"], lambda p: F.struct(p.alias("part"), t["term"].alias("term"))))))
    entry = lambda s: F.struct(s["part"].alias("part"), s["hash"].bitwiseAND(F.lit(0xFFFFFF)).cast("int").alias("hash"))
    none = F.array().cast("array<struct<part:tinyint,hash:int>>")
    start = F.struct(F.lit(-1).cast("tinyint").alias("part"), F.lit(0).cast("long").alias("hash"), none.alias("done"))

    def step(s, x):
        same = s["part"] == x["part"]
        seed = F.when(same, s["hash"]).otherwise(x["part"].cast("long"))
        done = F.when(same | (s["part"] < 0), s["done"]).otherwise(F.concat(s["done"], F.array(entry(s))))
        return F.struct(x["part"].alias("part"), F.xxhash64(seed, x["term"]).alias("hash"), done.alias("done"))

    return F.aggregate(pairs, start, step, lambda s: F.when(s["part"] < 0, s["done"]).otherwise(F.concat(s["done"], F.array(entry(s)))))


def _shown(sig: Column, whole: Column, subsets: int) -> Column:
    """A fingerprint as text: six hex digits a subset, or the text's own hash if no subset has a term."""
    of = F.map_from_entries(sig)
    parts = F.concat_ws("", F.transform(F.sequence(F.lit(0), F.lit(subsets - 1)), lambda k: F.coalesce(F.lower(F.lpad(F.hex(F.element_at(of, k.cast("tinyint")).cast("long")), 6, "0")), F.lit("------"))))
    return F.when(F.size(sig) > 0, parts).otherwise(F.concat(F.lit("="), F.lower(F.lpad(F.hex(whole), 16, "0"))))


def _likeness(a: Column, b: Column, whole_a: Column, whole_b: Column) -> Column:
    """Share of equal hashes among the subsets that either text touches; 1 for equal texts."""
    same = F.size(F.array_intersect(a, b))
    used = F.size(F.array_union(F.transform(a, lambda x: x["part"]), F.transform(b, lambda x: x["part"])))
    equal = (whole_a == whole_b).cast("double")
    return F.when(used > 0, same.cast("double") / F.greatest(used, F.lit(1))).otherwise(equal)


# ---------------------------------------------------------------- each document and its successor


def _block(doc_id: Column, splits: list[int]) -> tuple[Column, Column]:
    """How many of the sorted splits lie below doc_id, and whether doc_id is one of them.

    Three levels of _CHUNK-fold steps; each level is one constant array, so the plan stays small.
    """
    if not splits:
        return F.lit(0), F.lit(False)
    levels = [splits]
    while len(levels[-1]) > _CHUNK:
        levels.append([levels[-1][min(i + _CHUNK, len(levels[-1])) - 1] for i in range(0, len(levels[-1]), _CHUNK)])
    at, part = F.lit(0), F.array().cast("array<bigint>")
    for level in reversed(levels):
        constant = F.split(F.lit(",".join(map(str, level))), ",").cast("array<bigint>")
        part = F.slice(constant, at * _CHUNK + 1, _CHUNK)
        at = F.least(at * _CHUNK + F.size(F.filter(part, lambda s: s < doc_id)), F.lit(len(level)))
    # a null id is below all others
    return F.when(doc_id.isNull(), F.lit(0)).otherwise(at), F.coalesce(F.array_contains(part, doc_id), F.lit(False))


def with_successor(docs: DataFrame) -> DataFrame:
    """Rows ``block, row, ghost, doc_id, text, next_text`` in descending order of id.

    Blocks are ranges of ids with about BLOCK_ROWS documents (more in a corpus that has over
    MOST_BLOCKS such blocks). The first document of a block also stands, as a ghost, behind the
    last one of the block before, and the greatest id of all behind the least: so one exchange of
    the texts is enough, and no block needs another.
    """
    ids = docs.select("doc_id")
    bounds = ids.agg(F.count("*").alias("n"), F.max("doc_id").alias("greatest")).first()
    blocks = min(MOST_BLOCKS, max(1, bounds.n // BLOCK_ROWS))
    splits: list[int] = []
    if blocks > 1:
        at = [k / blocks for k in range(1, blocks)]
        got = ids.agg(F.percentile_approx("doc_id", at, max(10_000, 4 * blocks))).first()[0] or []
        splits = sorted(set(got) - {bounds.greatest})
    block, is_split = _block(F.col("doc_id"), splits)
    copy = lambda b, ghost, wrap: F.struct(b.cast("int").alias("block"), F.lit(ghost).alias("ghost"), F.lit(wrap).alias("wrap"))
    copies = F.array_compact(
        F.array(
            copy(block, False, 0),
            F.when(is_split, copy(block + 1, True, 0)),
            F.when(F.col("doc_id").eqNullSafe(F.lit(bounds.greatest).cast("long")), copy(F.lit(0), True, 1)),
        )
    )
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("copy", F.explode(copies)).select("doc_id", "text", "copy.*")
    order = Window.partitionBy("block").orderBy("wrap", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    return rows.select(
        "block", F.row_number().over(order).alias("row"), "ghost", "doc_id", "text", F.coalesce(F.lead("text").over(order), F.lit("")).alias("next_text")
    )


def fingerprint_pairs(docs: DataFrame, subsets: int = SUBSETS) -> DataFrame:
    """One row per document: ids, the edited text's digest, both fingerprints and likenesses.

    * null and empty texts have no term; like every text without a term of the lexicon they are
      fingerprinted by the hash of the whole text, so equal texts have equal fingerprints;
    * the next document of repeated ids is the next row in order of id, then of the text's hash;
      a table of one document is followed by itself; an empty table gives an empty result.
    """
    lex = materialize(lexicon(docs, subsets=subsets), "lexicon")
    always = docs.sparkSession.range(1).select(F.lit(_ALWAYS).cast("long").alias("term"), F.array().cast("array<tinyint>").alias("parts"))
    small = lex.count() <= BROADCAST_TERMS
    lex = lex.union(always)
    lex = F.broadcast(lex) if small else lex
    rows = with_successor(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), n - half), F.left(F.col("next_text"), half))
    rows = rows.select("block", "row", "ghost", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("whole", F.xxhash64("text")).withColumn("whole_edited", F.xxhash64("edited"))
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)))
    payload = ["ghost", "doc_id", "n_chars", "whole", "whole_edited", "sha"]
    sig = signatures(rows, ["block", "row"], payload, {"sig": "text", "sig_edited": "edited"}, lex)
    order = Window.partitionBy("block").orderBy("row")
    sig = sig.withColumn("next_sig", F.lead("sig").over(order)).withColumn("next_whole", F.lead("whole").over(order))
    c = F.col
    return sig.where("not ghost").select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        _shown(c("sig"), c("whole"), subsets).alias("fingerprint"),
        _shown(c("sig_edited"), c("whole_edited"), subsets).alias("edited_fingerprint"),
        _likeness(c("sig"), c("sig_edited"), c("whole"), c("whole_edited")).alias("near_edited"),
        _likeness(c("sig"), c("next_sig"), c("whole"), c("next_whole")).alias("near_next"),
    )


def op10_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_pairs(documents(spark, sf_dir))
