"""Matches of patterns with their places in whole texts, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, text_of

#: Code points before and after a match that are looked at as its surroundings.
REACH = 60


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """key (a number of the row), doc_id, text, as a kept table; a null text is empty."""
    rows, row = numbered(docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text")))
    return rows.withColumnRenamed(row, "key").select("key", "doc_id", "text")


def find(rows: DataFrame, patterns: dict[str, str], needs: dict[str, str] | None = None) -> DataFrame:
    """Leftmost non-overlapping matches of each kind: key, kind, start, end (code points), value, before, after.

    The text between matches and the matches come from the same search, so that a match begins after all that precedes it;
    the sum is made once the few matches have left their texts. before and after end at a line's end or after REACH code
    points. needs: text without which a kind has no match.
    """
    needs = needs or {}

    def hits(kind: str, pattern: str) -> Column:
        gaps, found = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
        n = F.size(gaps)
        zipped = F.arrays_zip(found.alias("value"), F.slice(gaps, 1, n - 1).alias("left"), F.slice(gaps, 2, n - 1).alias("right"))

        def one(m: Column, k: Column) -> Column:  # reads the zipped parts alone, so that the text is searched once, not once a match
            before, after = F.concat(F.lit("\n"), m["left"]), F.concat(m["right"], F.lit("\n"))
            return F.struct(F.lit(kind).alias("kind"), k.alias("k"), F.char_length(m["left"]).alias("gap"), m["value"].alias("value"), F.substring(before, -REACH - 1, REACH + 1).alias("before"), F.substring(after, 1, REACH + 1).alias("after"))

        out = F.transform(zipped, one)
        return F.when(F.col("text").contains(needs[kind]), out) if kind in needs else out

    empty = F.array().cast("array<struct<kind:string,k:int,gap:int,value:string,before:string,after:string>>")
    together = F.concat(*(F.coalesce(hits(kind, pattern), empty) for kind, pattern in patterns.items()))
    matches = rows.select("key", F.explode(together).alias("m")).select("key", "m.*")
    run = Window.partitionBy("key", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("value")).over(run)
    placed = matches.withColumn("end", end)
    return placed.select("key", "kind", (F.col("end") - F.char_length("value")).alias("start"), "end", "value", "before", "after")


def listed(spans: Column) -> Column:
    """kind:start:end of an array of structs (start, rank, kind, end), in that order, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
