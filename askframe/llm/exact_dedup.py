"""Exact duplicates by a heavy-hitter split, in DataFrame functions alone.

Texts are equal when they are identical without the characters U+0020 and U+0009 to U+000D. The digest of each normalised
text is computed once and kept. A Misra-Gries style summary of the digests (approx_top_k, which merges partial summaries)
names every digest that a large share of the rows may have; the candidates are verified by an exact count, and their
winners, at most `heavy` rows, are broadcast so that rows of large groups never leave their map task. The remaining
digests have no large group and meet in an ordinary shuffle of (id, length, digest).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of, tidy


def normalised(text: Column) -> Column:
    for c in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


@tidy
def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = 1024, tracked: int = 8192, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, and row_col if it is given.

    Of equal texts, the row with the most code points in the original text stays, then that with the smallest id.
    A null or empty text, or one of white space alone, is the empty text, so all of these are one group. Rows that repeat
    an id and text share one decision and each count in group_size; with row_col, a column that tells rows apart, only the
    row stays that is least in it. A null id loses ties against any other id. An empty table gives no rows; other columns
    are not read. heavy bounds the broadcast, tracked the summary; neither alters results.
    """
    text = text_of(docs, text_col)
    row = docs[row_col] if row_col else F.lit(0)
    rows = cut(docs.select(docs[id_col].alias("doc_id"), row.alias("row"), F.char_length(text).alias("n"), F.sha2(normalised(text).cast("binary"), 256).alias("digest")))
    order = F.struct(-F.col("n"), F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    summary = rows.agg(F.expr(f"approx_top_k(digest, {heavy}, {tracked})").alias("top"))
    often = summary.select(F.explode("top").alias("t")).where("t.count > 1").select(F.col("t.item").alias("digest"))
    winners = rows.join(F.broadcast(often), "digest", "left_semi").groupBy("digest").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("size"))
    winners = cut(winners)  # partial summaries merge in any order, so the candidates are settled here, once
    decided = ["doc_id", "row", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), F.col("size").alias("group_size"), "digest"]
    of_large = rows.join(F.broadcast(winners), "digest").select(*decided)
    group = Window.partitionBy("digest")
    rest = rows.join(F.broadcast(winners), "digest", "left_anti").withColumns({"first": F.min(order).over(group), "size": F.count(F.lit(1)).over(group)})
    both = of_large.unionByName(rest.select(*decided))
    own = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") == F.col("keep_row"))
    return both.select("doc_id", "keep_id", "group_size", own.alias("kept"), F.col("digest").alias("text_sha256"), *([F.col("row").alias(row_col)] if row_col else []))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""
