"""Exact deduplication by content-defined chunk recipes.

A text is cut where its own content says so, so equal passages give equal chunks wherever they
stand. Each distinct chunk gets an identifier, and the identifiers are verified: the distinct
(identifier, chunk) pairs are counted, and an identifier with two contents is replaced by one with
the content's rank. A text's recipe is its ordered list of identifiers; equal recipes are equal
texts. Only distinct chunks move, once, after a map-side distinct; grouping moves recipes alone.

Recipes are grouped under a short digest, which is verified like the chunks' identifiers; the digest
then takes each row to its group. Large groups are met by broadcast, so no task gets all their rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, durable, fold, join_sized, text_of

#: A chunk has at least LEAST characters, ends after the first cut point beyond, and has at most MOST.
LEAST, MOST = 512, 8192
#: Cut points: a blank or line end after a letter of a fixed set that holds about a quarter of word ends, or
#: after any letter beyond ASCII; in scripts without blanks, a mark or one of their frequent characters.
CUT = f"(?s).{{{LEAST},{MOST}}}?(?:(?<=[dgrtn[^\\x00-\\x7f]])[ \\n]|(?<=[。、，！？のはをにがでと的一是不了我在有])|\\z)|.{{1,{MOST}}}"


def chunks_of(text: Column) -> Column:
    """The text's chunks in order; joined they are the text. The empty text has none."""
    return F.regexp_extract_all(text, F.lit(CUT), F.lit(0))


def recipes(docs: DataFrame, identify: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, text_sha256 and recipe (verified identifiers in order) of every row."""
    folded = docs.select(F.col("doc_id").alias("doc_id"), fold(text_of()).alias("_text"))
    cut = folded.select("doc_id", F.sha2(F.encode("_text", "UTF-8"), 256).alias("text_sha256"), chunks_of(F.col("_text")).alias("_chunks"))
    contents = cut.select(F.explode("_chunks").alias("_chunk")).select(identify(F.col("_chunk")).alias("_id"), "_chunk").distinct()
    clashes = contents.groupBy("_id").agg(F.count("*").alias("_n")).where("_n > 1").select("_id")
    if not clashes.limit(1).count():
        return cut.select("doc_id", "text_sha256", F.transform("_chunks", lambda c: F.struct(identify(c).alias("id"), F.lit(0).alias("rank"))).alias("recipe"))

    # Some identifier has two contents: chunks under such identifiers get their content's rank too.
    clashes = durable(clashes)
    rank = F.row_number().over(Window.partitionBy("_id").orderBy("_chunk")) - 1
    ranked = contents.join(clashes, "_id", "left_semi").withColumn("_rank", rank)
    row = durable(cut.withColumn("_row", F.monotonically_increasing_id()))
    each = row.select("_row", F.posexplode("_chunks").alias("_at", "_chunk")).withColumn("_id", identify(F.col("_chunk")))
    named = each.join(ranked, ["_id", "_chunk"], "left").select("_row", F.struct("_at", F.struct(F.col("_id").alias("id"), F.coalesce("_rank", F.lit(0)).alias("rank")).alias("part")).alias("_part"))
    lists = named.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list("_part")), lambda p: p["part"]).alias("recipe"))
    empty = F.array().cast(lists.schema["recipe"].dataType)
    return row.join(lists, "_row", "left").select("doc_id", "text_sha256", F.coalesce("recipe", empty).alias("recipe"))


def _digest(recipe: Column) -> Column:
    return F.struct(F.xxhash64(recipe).alias("a"), F.xxhash64(F.lit(1), recipe).alias("b"))


def exact_dedup(docs: DataFrame, identify: Callable[[Column], Column] = F.xxhash64, digest: Callable[[Column], Column] = _digest) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after lower-casing A-Z; null is the empty text, and empty texts
    are equal to each other. The largest doc_id of a group stays. Rows repeated with the same
    doc_id and text are the same document: all count in group_size and share the verdict. Where
    every doc_id of a group is null, keep_id is null and all its rows are kept (there is no telling
    them apart); a null id beside real ones goes. An empty table gives an empty result; other
    columns are not read.
    """
    found = durable(recipes(docs, identify).withColumn("digest", digest(F.col("recipe"))))
    groups = durable(found.groupBy("digest", "recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    on = ["digest", "recipe"] if groups.groupBy("digest").count().where("count > 1").limit(1).count() else ["digest"]
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    joined = join_sized(found.select("doc_id", "text_sha256", *on), groups.select(*on, "keep_id", "group_size"), on, "group_size", total)
    return joined.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


ORACLE_SQL = f"""
WITH folded AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM folded
"""
