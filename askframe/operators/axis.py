"""A summary's time axis: every slot between its first and last bucket, those without rows too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import Refusal

# The most slots of an axis, and the step of each grain.
MAX_SLOTS = 50_000
STEPS = {"hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY", "week": "INTERVAL 7 DAYS", "month": "INTERVAL 1 MONTH"}


def fill(buckets: DataFrame, grain: str, zone: str | None = None, low: str | None = None, high: str | None = None) -> DataFrame:
    """buckets (bucket, value; a bucket pick's answer) with a row, its value null, for each slot from low to high that has
    none; low and high are labels, by default the first and last bucket. Hours that a zone's clock never shows are no slots,
    but a bucket with rows stays whatever its label is. Refused beyond MAX_SLOTS slots.
    """
    if grain not in STEPS:
        raise Refusal("bucket", f"{grain!r} is none of {', '.join(STEPS)}")
    ends = buckets.agg(F.min("bucket").alias("low"), F.max("bucket").alias("high")).first()
    low, high = low or ends["low"], high or ends["high"]
    if low is None or high is None:
        return buckets.orderBy("bucket")
    start, end = (F.date_trunc(grain, F.lit(x.rstrip("Z")).cast("timestamp")) for x in (low, high))
    spark = buckets.sparkSession
    span = spark.range(1).select(start.alias("a"), end.alias("b"))
    apart = f"timestampdiff({grain.upper()}, a, b)"
    if (span.select(F.expr(apart).alias("n")).first()["n"] or 0) >= MAX_SLOTS:
        raise Refusal("axis", f"an axis has at most {MAX_SLOTS} slots")
    slots = span.where("a <= b").select(F.explode(F.expr(f"sequence(a, b, {STEPS[grain]})")).alias("t"))
    if zone and grain == "hour":

        def shown(t):
            return F.from_utc_timestamp(F.to_utc_timestamp(t, zone), zone) == t

        slots = slots.where(shown(F.col("t")) | shown(F.col("t") + F.expr("INTERVAL '59:59' MINUTE TO SECOND")))
    labels = slots.select(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss" + ("" if zone else "'Z'")).alias("bucket"))
    return labels.join(buckets, "bucket", "full").orderBy("bucket")
