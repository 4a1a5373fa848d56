"""Exact deduplication by content-defined chunk recipes, in DataFrame operations alone.

A text (A-Z lower-cased, nothing else) is cut where its content says so, once a chunk holds
``min_chars``: after a blank or line feed that stands between chosen letters, between two words
of another script, or after another script's sentence signs; and at ``max_chars`` at the latest
(a text without any blank or sign is cut there alone).  Equal stretches of text so give
equal chunks wherever they stand.  Chunks are deduplicated first - each distinct
chunk text moves once a map task - and a digest becomes a *verified identifier* once
its distinct texts are known: where two texts share a digest, each gets a rank, so
identifiers are exact for any digest.  A document is then its ordered identifier list
(its recipe, written once); documents with equal recipes are equal.  Long texts never move whole.

Defined results: null text counts as empty; the empty text is a text like others, so
all empty rows form one group; a null ``doc_id`` sorts below all others and stays only
in a group of nulls; of equal texts one row stays: among rows that repeat the largest
id, the one with the largest row number; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .common import ascii_lower, numbered_rows

MIN_CHARS, MAX_CHARS = 512, 8192


def chunk_pattern(min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> str:
    """The cut points: lazily on from ``min_chars`` to a place that the characters around it single out."""
    # Sentence signs of Chinese, Japanese, Indic, Arabic, Ethiopic, Armenian, Khmer and Myanmar script.
    signs = "\u3002\uff0c\u3001\uff01\uff1f\uff1b\u0964\u0965\u061f\u060c\u061b\u06d4\u1361\u1362\u0589\u17d4\u104a\u104b"
    cut = rf"(?<=[aeinrst][ \n])(?=[a-m])|(?<=[^\x00-\u024F][ \n])(?=[^\x00-\u024F])|(?<=[{signs}])"
    return rf"(?s).{{{min_chars},{max_chars}}}?(?:{cut})|.{{1,{max_chars}}}"


def chunks(text: Column, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS) -> Column:
    """The ordered chunks of a text; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(chunk_pattern(min_chars, max_chars)), F.lit(0))


def default_digest(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def recipes(docs: DataFrame, *, digest=default_digest, min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """``(doc_id, row, text_sha256, recipe)``, written: a recipe is an array of verified identifiers ``(digest, rank)``;
    the rank tells texts of one digest apart and is 0 where the digest has one text."""
    marked, row = (docs, row_col) if row_col else numbered_rows(docs)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = marked.select(F.col(id_col).alias("doc_id"), F.col(row).alias("row"), ascii_lower(text).alias("norm"))
    cut = rows.select("doc_id", "row", F.sha2("norm", 256).alias("text_sha256"), chunks(F.col("norm"), min_chars, max_chars).alias("chunks"))
    # Each distinct (digest, text) once a map task, then once in all; a digest with several texts is a collision.
    distinct = rows.select(F.explode(chunks(F.col("norm"), min_chars, max_chars)).alias("chunk")).select(digest(F.col("chunk")).alias("digest"), "chunk").distinct()
    doubled = materialize(distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "collisions")
    if doubled.isEmpty():
        return materialize(cut.select("doc_id", "row", "text_sha256", F.transform("chunks", lambda c: F.struct(digest(c).alias("digest"), F.lit(0).alias("rank"))).alias("recipe")), "recipes")
    # Collided digests: texts are ranked inside their digest, and chunk occurrences look their rank up.
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("chunk")) - 1
    ranked = distinct.join(doubled, "digest", "left_semi").select("digest", "chunk", rank.alias("rank"))
    found = (
        cut.select("doc_id", "text_sha256", "row", F.posexplode_outer("chunks").alias("pos", "chunk"))
        .withColumn("digest", digest(F.col("chunk")))
        .join(ranked, ["digest", "chunk"], "left")
        .groupBy("row", "doc_id", "text_sha256")
        .agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "digest", F.coalesce("rank", F.lit(0)).alias("rank"))))).alias("parts"))
    )
    return materialize(found.select("doc_id", "row", "text_sha256", F.transform("parts", lambda p: F.struct(p.digest.alias("digest"), p.rank.alias("rank"))).alias("recipe")), "recipes")


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, row, keep_id, group_size, kept, text_sha256)``, one row a document; of equal texts the one with the
    largest ``doc_id`` stays.  ``row`` is a number of the row: that of ``row_col``, if given, else a new one.

    Only groups of several rows are joined back, so documents without a copy meet no
    further row.  The groups are written first, so that the join has a plain exchange on
    both sides: a very large group is one row on the right, and the adaptive planner
    splits its left side over tasks (or sends the groups to all, if they are few).
    """
    made = recipes(docs, **options)
    groups = materialize(made.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    out = made.join(groups, "recipe", "left")
    return out.select(
        "doc_id", "row", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("last.row"), F.lit(True)).alias("kept"), "text_sha256",
    )
