"""Picks: rows, rows that changed, one number, or numbers by time bucket."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import Refusal
from ..functions import times
from ..functions.values import Value, json_order
from ..plans.compiler import compile_condition, compile_value
from ..plans.legality import ROLLING_WIDTH, Pick, validate
from ..plans.syntax import parse_path
from ..sources.records import Records


def exact(function: str, number: Column) -> Column:
    """sum, avg, min or max of exact numbers; sum and avg rounded half up to six places, in one rounding."""
    if function in ("min", "max"):
        return getattr(F, function)(number)
    return F.round(F.sum(number), 6) if function == "sum" else mean(F.sum(number), F.count(number))


def mean(total: Column, n: Column) -> Column:
    """total / n, rounded half up to six places: the quotient of whole numbers, put right by its remainder."""
    count = F.when(n > 0, n).cast("decimal(18,0)")
    twice = (F.abs(total).cast("decimal(38,18)") * F.lit(2_000_000).cast("decimal(7,0)")).cast("decimal(38,12)") + count
    whole = F.floor(twice.cast("decimal(38,12)") / (count * 2)).cast("decimal(26,0)")
    whole = F.when(whole.cast("decimal(38,0)") * (count * 2) > twice, whole - 1).otherwise(whole).cast("decimal(26,0)")
    return (F.signum(total).cast("decimal(1,0)") * whole * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(38,6)")


def sort_keys(value: Value, present: Column, as_time: bool = False) -> list[Column]:
    """Columns in whose order values come, nulls last. Order of JSON values: null < text < number < yes/no < list < group, missing last in both directions.

    Numbers order by value, exactly where 38 digits hold them; lists and groups in depth; the empty list comes before
    everything. as_time: readable times and dates by their moment, any other value last but for a JSON null.
    """
    if value.instant is not None:
        return [value.instant]
    if as_time:
        at = times.moment(value.text)
        blank = (value.tag == "null") & present
        return [F.when(blank, 0).when(at.isNotNull(), 1), at]
    if value.kind != "json":
        return [value.column]
    t = value.tag
    empty = (t == "arr") & (F.size(value.items) == 0)
    rank = F.when(~present, F.lit(None)).when(empty, 0).when(t == "null", 1).when(t == "str", 2).when(t == "num", 3).when(t == "bool", 4).when(t == "arr", 5).otherwise(6)
    return [rank, value.text, value.num, value.held, value.flag, json_order(F.when(t.isin("arr", "obj"), value.canonical))]


def page(rows: DataFrame, number: int, size: int = 50) -> DataFrame:
    """One page, the first is 1, of rows in a fixed order (a sorted pick's)."""
    if isinstance(number, bool) or not isinstance(number, int) or number < 1 or size < 1:
        raise Refusal("page", "pages are numbered from 1")
    return rows.offset((number - 1) * size).limit(size)


def run(records: Records, pick: Pick, strict: bool = False, now_ms: float | None = None) -> DataFrame:
    """The answer to a pick; the order of operations is: source, computed columns, filter, rolling mean, only changed
    records, aggregate or buckets, sort, cap."""
    own = validate(pick, records)
    computed = {name: compile_value(source, records, strict, now_ms) for name, source in pick.computed}
    frame = records.frame
    if pick.filter is not None:
        frame = frame.where(compile_condition(pick.filter, records, strict, now_ms))
    if own == "SCALAR":
        return frame.agg(_aggregate(records, pick).alias("value"))
    if own == "BUCKET":
        path = parse_path(pick.bucket_field or records.series.time)
        at = records.instant(path, pick.bucket_zone)
        if pick.bucket_field is None:
            at = F.coalesce(at, F.raise_error(F.lit("a time of the series can't be read")).cast("timestamp"))
        label = times.bucket(at, pick.bucket, pick.bucket_zone)
        out = frame.withColumn("bucket", label).where(F.col("bucket").isNotNull()).groupBy("bucket").agg(_aggregate(records, pick).alias("value")).orderBy("bucket")
        return out.limit(pick.cap) if pick.cap else out
    columns = [F.col("key")]
    columns += [_shown(records.at(parse_path(p))).alias(parse_path(p)[-1]) for p in pick.columns]
    columns += [_shown(v).alias(name) for name, v in computed.items()]
    keep = []
    if pick.rolling or pick.changed:
        member = records.at(parse_path(records.series.member))
        window = Window.partitionBy(member.canonical).orderBy(records.instant(parse_path(records.series.time)), records.tie)
        if pick.rolling:
            number = records.at(parse_path(pick.rolling)).decimal
            columns.append(_rolling(number, window).alias("rolling"))
        if pick.changed:
            body = _without_time(records)
            before = F.lag(body).over(window)
            first = F.row_number().over(window) == 1
            keep = [(first | ~before.eqNullSafe(body)).alias("_changed")]
    keys = []
    if pick.sort is not None:
        value = computed.get(pick.sort) or records.at(parse_path(pick.sort))
        present = ~value.missing if pick.sort in computed else records.has(parse_path(pick.sort))
        keys = sort_keys(value, present, pick.sort_time)
    out = frame.select(*columns, *(k.alias(f"_sort{i}") for i, k in enumerate(keys)), *keep, F.col(records.tie).alias("_tie"))
    if pick.changed:
        out = out.where("_changed")
    if keys or pick.cap:
        order = [F.col(f"_sort{i}").asc_nulls_last() if pick.direction == "asc" else F.col(f"_sort{i}").desc_nulls_last() for i in range(len(keys))]
        out = out.orderBy(*order, "_tie")
    if pick.cap:
        out = out.limit(pick.cap)
    return out.drop("_tie", "_changed", *(f"_sort{i}" for i in range(len(keys))))


def _shown(value: Value) -> Column:
    return F.to_json(value.column) if value.kind == "json" else value.column


def _aggregate(records: Records, pick: Pick) -> Column:
    if pick.aggregate == "count":
        return F.count(F.lit(1))
    return exact(pick.aggregate, records.at(parse_path(pick.field)).decimal)


def _rolling(number: Column, window) -> Column:
    """The mean of the numbers among the last rows, exact up to one rounding to six places."""
    frame = window.rowsBetween(1 - ROLLING_WIDTH, 0)
    return mean(F.sum(number).over(frame), F.count(number).over(frame))


def _without_time(records: Records) -> Column:
    """Canonical text of a record without its series' time (and a typed record's key, which names the row)."""
    time = parse_path(records.series.time)
    if records.typed:
        rest = [c for c in records.frame.columns if c not in (time[0], "key", records.tie)]
        return F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    return F.to_json(F.map_filter(F.try_variant_get("doc", "$", "map<string,variant>"), lambda k, _: k != time[0]))
