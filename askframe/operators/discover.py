"""What fields JSON records have, of which kind, and what they hold; one grouped pass over distinct values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import times
from ..functions.values import Value
from ..sources.records import Records

#: Distinct values of a field that are listed, at most.
MAX_LISTED = 2000


def keys(records: Records) -> DataFrame:
    """Every top-level key, sorted."""
    if records.typed:
        return records.frame.sparkSession.createDataFrame([(c,) for c in sorted(records.frame.columns) if c != "key"], "field string")
    fields = F.map_keys(F.try_variant_get("doc", "$", "map<string,variant>"))
    return records.frame.select(F.explode(fields).alias("field")).distinct().orderBy("field")


# Fixed value: what looks like a time or date, readable or not.
LOOKS = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}([Tt ][0-9]{2}:[0-9]{2}(:[0-9]{2}([.,][0-9]+)?)?([Zz]|[+-][0-9]{2}(:?[0-9]{2}(:?[0-9]{2})?)?)?)?\z"


def facts(records: Records) -> DataFrame:
    """What each field holds, one row a field; in JSON records also the fields within fields, as a.b.

    field; kind; present (values), different; least_number, most_number; least_text, most_text; texts (different ones);
    filled, looks, readable, no_date (values that are text and not empty; that look like a time; that are readable times with
    a time of day; that aren't a date); least_time, most_time (of readable times, to the second); least_day, most_day.
    kind: number, text, yesno if all values are; date if all texts are dates; time if one is a readable time and more than half
    of the texts look like one; else mixed. One grouped pass over the different values.
    """
    if records.typed:
        parts = []
        for c in (c for c in records.frame.columns if c != "key"):
            v = records.at((c,))
            parts.append(F.struct(F.lit(c).alias("field"), v.tag.alias("tag"), v.column.cast("string").alias("text"), v.number.alias("num") if v.kind != "str" else F.lit(None).cast("double").alias("num")))
        cells = records.frame.select(F.explode(F.array(*parts)).alias("c")).select("c.*")
    else:
        pairs = "map<string,variant>"
        top = records.frame.select(F.explode(F.try_variant_get("doc", "$", pairs)).alias("field", "value"))
        group = Value("json", F.col("value"))
        within = F.transform(F.map_entries(F.try_variant_get(F.when(group.tag == "obj", F.col("value")), "$", pairs)), lambda e: F.struct(F.concat(F.col("field"), F.lit("."), e["key"]).alias("field"), e["value"].alias("value")))
        own = F.array(F.struct(F.col("field"), F.col("value")))
        every = top.select(F.explode(F.when(within.isNull(), own).otherwise(F.concat(own, within))).alias("e")).select("e.*")
        v = Value("json", F.col("value"))
        cells = every.select("field", v.tag.alias("tag"), F.coalesce(v.text, v.canonical).alias("text"), v.num.alias("num"))
    values = cells.where("tag != 'null'").groupBy("field", "tag", "text").agg(F.count(F.lit(1)).alias("n"), F.first("num").alias("num"))
    text, is_text = F.col("text"), F.col("tag") == "str"
    at, day = times.to_second(text), times.is_day(text)
    marks = {"filled": is_text & (text != ""), "looks": is_text & text.rlike(LOOKS), "time": is_text & at.isNotNull() & ~day, "day": is_text & day, "dated": is_text & text.rlike(times.DATE)}
    own = values.withColumns({**marks, "at": F.when(is_text, at)})

    def total(test: str):
        return F.coalesce(F.sum(F.when(F.expr(test), F.col("n"))), F.lit(0)).cast("bigint")

    def ends(column: str, test: str, name: str):
        return [getattr(F, how)(F.when(F.expr(test), F.col(column))).alias(f"{side}_{name}") for how, side in (("min", "least"), ("max", "most"))]

    sums = own.groupBy("field").agg(
        F.sum("n").cast("bigint").alias("present"), F.count(F.lit(1)).alias("different"), F.count_distinct("tag").alias("tags"), F.min("tag").alias("tag"),
        *ends("num", "tag = 'num'", "number"), *ends("text", "tag = 'str'", "text"), F.count(F.when(is_text, 1)).alias("texts"),
        total("filled").alias("filled"), total("filled and looks").alias("looks"), total("filled and time").alias("readable"), total("filled and not dated").alias("no_date"),
        *ends("at", "time", "time"), *ends("at", "day", "day"),
    )
    of_text = F.when((F.col("filled") > 0) & (F.col("no_date") == 0), "date").when((F.col("readable") > 0) & (F.col("looks") * 2 > F.col("filled")), "time").otherwise("text")
    kind = F.when(F.col("tags") > 1, "mixed").when(F.col("tag") == "num", "number").when(F.col("tag") == "bool", "yesno").when(F.col("tag") == "str", of_text).otherwise("mixed")
    return sums.select("field", kind.alias("kind"), "present", "different", "least_number", "most_number", "least_text", "most_text", "texts", "filled", "looks", "readable", "no_date", "least_time", "most_time", "least_day", "most_day").orderBy("field")


def listed(records: Records, field: str) -> DataFrame:
    """A field's distinct values as JSON text with their counts, most frequent first, MAX_LISTED at most."""
    from ..plans.syntax import parse_path

    v = records.at(parse_path(field))
    out = records.frame.where(~v.missing).groupBy(v.canonical.alias("text")).agg(F.count(F.lit(1)).alias("n"))
    return out.orderBy(F.desc("n"), "text").limit(MAX_LISTED)
