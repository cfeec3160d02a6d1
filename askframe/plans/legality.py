"""Which operations go together in a pick, and what their slots hold."""

from __future__ import annotations

from dataclasses import dataclass
from zoneinfo import available_timezones

from ..errors import Refusal
from ..sources.records import Records
from .gate import check_alias
from .syntax import parse, parse_path

# Fixed values of a pick.
AGGREGATES = ("none", "count", "sum", "avg", "min", "max")
GRAINS = ("off", "hour", "day", "week", "month")
CAP = (1, 20000)
ROLLING_WIDTH = 3


@dataclass(frozen=True)
class Pick:
    """One question: computed columns, a filter, a rolling mean of a field, only changed records, an aggregate, time
    buckets, a sort and a cap. bucket_field None: the series' time."""

    columns: tuple = ()  # field paths that rows show
    computed: tuple = ()  # (name, expression)
    filter: str | None = None
    rolling: str | None = None
    changed: bool = False
    aggregate: str = "none"
    field: str | None = None
    bucket: str = "off"
    bucket_field: str | None = None
    bucket_zone: str | None = None
    sort: str | None = None
    direction: str = "asc"
    sort_time: bool = False  # the sort's field is a time field
    cap: int | None = None


def shape(pick: Pick) -> str:
    return "BUCKET" if pick.bucket != "off" else "SCALAR" if pick.aggregate != "none" else "ROWS"


def validate(pick: Pick, records: Records) -> str:
    """The pick's shape, or a Refusal that names the operation in the way."""
    if pick.aggregate not in AGGREGATES:
        raise Refusal("aggregate", f"{pick.aggregate!r} is none of {', '.join(AGGREGATES)}")
    if pick.bucket not in GRAINS:
        raise Refusal("bucket", f"{pick.bucket!r} is none of {', '.join(GRAINS)}")
    if pick.direction not in ("asc", "desc"):
        raise Refusal("sort", f"{pick.direction!r} is neither asc nor desc")
    if pick.cap is not None and (isinstance(pick.cap, bool) or not isinstance(pick.cap, int) or not CAP[0] <= pick.cap <= CAP[1]):
        raise Refusal("cap", f"a cap is a whole number from {CAP[0]} to {CAP[1]}")
    own = shape(pick)
    needs_field = pick.aggregate in AGGREGATES[2:]
    if needs_field != (pick.field is not None):
        raise Refusal("field", f"{pick.aggregate} {'needs' if needs_field else 'takes no'} field")
    if records.series is None and (pick.rolling or pick.changed):
        raise Refusal("series", "a rolling mean or only changed records need a time series")
    if own == "BUCKET":
        if pick.aggregate == "none":
            raise Refusal("bucket", "time buckets need an aggregate")
        if records.series is None and pick.bucket_field is None:
            raise Refusal("bucket", "time buckets need a time field where there is no series")
    elif pick.bucket_field is not None or pick.bucket_zone is not None:
        raise Refusal("bucket", "a bucket field or zone needs time buckets")
    if pick.bucket_zone is not None and pick.bucket_zone not in available_timezones():
        raise Refusal("zone", f"{pick.bucket_zone!r} is no zone")
    if own != "ROWS" and (pick.rolling or pick.changed):
        raise Refusal("aggregate", "a total leaves no rows for a rolling mean or a comparison with the row before")
    if pick.sort_time and (pick.sort is None or any(pick.sort == name for name, _ in pick.computed)):
        raise Refusal("sort", "a sort by time names a field")
    if pick.sort is not None and own != "ROWS":
        raise Refusal("sort", "a total leaves no rows to sort")
    if pick.cap is not None and own == "SCALAR":
        raise Refusal("cap", "one number needs no cap")
    taken: set[str] = set()
    for name, source in pick.computed:
        check_alias(name, taken)
        parse(source)
    for path in (*pick.columns, pick.field, pick.rolling, pick.bucket_field, pick.sort if pick.sort not in taken else None):
        if path is not None:
            parse_path(path)
    return own
