"""Conditions as clicked: operators by kind of field, joined as all, any, one or neither all nor none, in nested boxes."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import UTC, date, datetime, timedelta
from decimal import Decimal
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Refusal
from ..functions import times
from ..functions.values import Value, equal, ordered
from ..plans.syntax import parse_path
from ..sources.records import Records

# The operators of each kind of field, and limits.
OPERATORS = {
    "text": ("eq", "ne", "in", "present", "blank"),
    "number": ("eq", "ne", "gt", "lt", "ge", "le", "between", "in", "present", "blank"),
    "yesno": ("yes", "no", "present", "blank"),
    "date": ("on", "after", "before", "between", "eq", "ne", "gt", "lt", "ge", "le", "in", "present", "blank"),
    "time": ("on", "after", "before", "between", "from", "until", "clock", "present", "blank"),
    "mixed": ("present", "blank"),
}
MAX_VALUES, MAX_NESTING, VERSION = 200, 64, 1
JOINS = ("all", "any", "one", "allnone")
#: What a date field's own operators compare.
ON_DATES = {"on": "eq", "after": "gt", "before": "lt"}


@dataclass(frozen=True)
class Condition:
    """kind: of the field; zone: of a time's clock, UTC by default."""

    field: str
    op: str
    kind: str = "text"
    values: tuple = ()
    zone: str = "UTC"


@dataclass(frozen=True)
class Box:
    """join: all, any, one (exactly one) or allnone (all or none)."""

    join: str
    parts: tuple


def _literal(v) -> Value:
    if isinstance(v, bool):
        return Value("bool", F.lit(v))
    if isinstance(v, (int, float, Decimal)):
        try:
            held = float(v)
        except OverflowError:
            held = float("inf")
        if held != held or abs(held) == float("inf"):
            raise Refusal("literal", f"{v} is too large to compare with")
        if not isinstance(v, float) and Decimal(repr(held)) != v:
            raise Refusal("literal", f"{v} has more digits than a double's shortest text")
        return Value("num", F.lit(held))
    if "\0" in v or any(0xD800 <= ord(c) < 0xE000 for c in v):
        raise Refusal("literal", "a text holds no NUL and no lone surrogate")
    return Value("str", F.lit(v))


def holds(c: Condition | Box, records: Records, depth: int = 0) -> tuple[Column, Column]:
    """Where it holds and where it fails; an unreadable time does neither."""
    if depth > MAX_NESTING:
        raise Refusal("depth", f"boxes nest at most {MAX_NESTING} deep")
    if isinstance(c, Box):
        parts = [holds(p, records, depth + 1) for p in c.parts]
        if not parts:
            raise Refusal("box", "a box holds a condition at least")
        yes = sum((p[0].cast("int") for p in parts[1:]), parts[0][0].cast("int"))
        no = sum((p[1].cast("int") for p in parts[1:]), parts[0][1].cast("int"))
        n = len(parts)
        if c.join == "all":
            return yes == n, no > 0
        if c.join == "any":
            return yes > 0, no == n
        if c.join == "one":
            return (yes == 1) & (no == n - 1), (yes > 1) | (no == n)
        if c.join == "allnone":
            return (yes == n) | (no == n), (yes > 0) & (no > 0)
        raise Refusal("join", f"{c.join!r} is none of all, any, one, allnone")
    if c.op not in OPERATORS.get(c.kind, ()):
        raise Refusal("operator", f"{c.kind} fields have no {c.op}")
    if c.kind == "date":
        for v in c.values:
            _day(v)
    if len(c.values) > MAX_VALUES:
        raise Refusal("values", f"at most {MAX_VALUES} values")
    value = records.at(parse_path(c.field))
    if c.op in ("present", "blank"):
        return _two(value.missing if c.op == "blank" else ~value.missing)
    if c.kind == "yesno":
        return _two(equal(value, Value("bool", F.lit(c.op == "yes"))))
    if c.kind == "time":
        return _time(c, records)
    given = [_literal(v) for v in dict.fromkeys(c.values)]
    if c.op == "in":
        return _two(_any([equal(value, v) for v in given]))
    if c.op == "between":
        low, high = (_literal(v) for v in sorted(c.values))
        return _two(F.coalesce(ordered(">=", value, low) & ordered("<=", value, high), F.lit(False)))
    op = ON_DATES.get(c.op, c.op) if c.kind == "date" else c.op
    if op in ("eq", "ne"):
        same = equal(value, given[0])
        return _two(same if op == "eq" else ~same)
    return _two(F.coalesce(ordered({"gt": ">", "lt": "<", "ge": ">=", "le": "<="}[op], value, given[0]), F.lit(False)))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _two(test: Column) -> tuple[Column, Column]:
    return test, ~test


def _day(text) -> date:
    if not isinstance(text, str) or not re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", text):
        raise Refusal("day", "a day is picked as a date")
    try:
        return date.fromisoformat(text)
    except ValueError:
        raise Refusal("day", f"{text} is no day") from None


def _wall(at: datetime, zone: str) -> datetime:
    """The moment of a time on a zone's clock, the first of two; one that the clock skips is refused."""
    out = at.replace(tzinfo=ZoneInfo(zone)).astimezone(UTC)
    if out.astimezone(ZoneInfo(zone)).replace(tzinfo=None) != at:
        raise Refusal("time", f"the clock of {zone} skips {at.isoformat()}")
    return out


def _moment(text, zone: str) -> datetime:
    """A picked date and time: on the zone's clock, or in UTC with a Z behind it."""
    m = re.fullmatch(r"([0-9]{4}-[0-9]{2}-[0-9]{2})T([01][0-9]|2[0-3]):([0-5][0-9])(?::([0-5][0-9])(?:\.([0-9]{1,6}))?)?(Z?)", text) if isinstance(text, str) else None
    if not m:
        raise Refusal("time", "a time is picked as a date and a time")
    at = datetime.combine(_day(m[1]), datetime.min.time()) + timedelta(hours=int(m[2]), minutes=int(m[3]), seconds=int(m[4] or 0))
    return (at.replace(tzinfo=UTC) if m[6] else _wall(at, zone)) + timedelta(microseconds=int((m[5] or "0").ljust(6, "0")))


def _clock(text) -> int:
    m = re.fullmatch("([01][0-9]|2[0-3]):([0-5][0-9])(?::([0-5][0-9]))?", text) if isinstance(text, str) else None
    if not m:
        raise Refusal("clock", "a time of day is picked as hours and minutes, such as 17:00")
    return int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3] or 0)


def _literal_moment(at: datetime) -> Column:
    return F.timestamp_micros(F.lit((at - datetime(1970, 1, 1, tzinfo=UTC)) // timedelta(microseconds=1)))


def _time(c: Condition, records: Records) -> tuple[Column, Column]:
    """on: from a day's first moment on the clock to the next day's; after, before: past or ahead of a moment; between: from
    one to the other, both included, in either order. A date in the data is its midnight on the clock, and has no time of day."""
    path = parse_path(c.field)
    if c.op in ("from", "until", "clock"):
        value = records.at(path)
        seconds = times.seconds_of_day(times.clock_instant(value.text) if value.instant is None else value.instant, c.zone)
        of = [_clock(v) for v in c.values]
        if c.op == "from":
            test = seconds >= of[0]
        elif c.op == "until":
            test = seconds < of[0]
        elif of[0] <= of[1]:
            test = (seconds >= of[0]) & (seconds < of[1])
        else:
            test = (seconds >= of[0]) | (seconds < of[1])  # past midnight
    else:
        at = records.instant(path, c.zone)
        if c.op == "on":
            day = _day(c.values[0])
            test = at >= F.to_utc_timestamp(F.lit(day.isoformat()).cast("timestamp"), c.zone)
            if day < date.max:
                test = test & (at < F.to_utc_timestamp(F.lit((day + timedelta(days=1)).isoformat()).cast("timestamp"), c.zone))
        else:
            given = sorted(_moment(v, c.zone) for v in c.values)
            if c.op == "after":
                test = at > _literal_moment(given[0])
            elif c.op == "before":
                test = at < _literal_moment(given[0])
            else:
                test = (at >= _literal_moment(given[0])) & (at <= _literal_moment(given[-1]))
    return F.coalesce(test, F.lit(False)), F.coalesce(~test, F.lit(False))


def from_filter(question: dict, kinds: dict[str, str], zone: str = "UTC") -> Box | None:
    """The box of a question's filter, which is stored as {"filter": {"version": 1, "join": .., "items": [..]}} or, in the old
    flat form, as {"conditions": [..], "logic": ..}; None where it holds nothing. kinds: of the fields.

    An item with items is a box, any other a card {"field", "op", "value", "value2", "values", "part"}; an empty box adds
    nothing, a box of one is that one. A join may be left out where there is nothing to join.
    """
    stored, cards, logic = question.get("filter"), question.get("conditions"), question.get("logic")
    if stored is not None:
        if cards or logic is not None:
            raise Refusal("filter", "a question sends its filter once")
        if not isinstance(stored, dict) or set(stored) - {"version", "join", "items"}:
            raise Refusal("filter", "a filter has a version, a join and items")
        if type(stored.get("version")) is not int or stored["version"] != VERSION:
            raise Refusal("filter", f"filters are of version {VERSION}")
        cards, logic = stored.get("items"), stored.get("join")
    if not isinstance([] if cards is None else cards, list):
        raise Refusal("filter", "a filter's items are a list")
    found = _stored_box(cards or [], logic, kinds, zone, 0)
    return found if found is None or isinstance(found, Box) else Box("all", (found,))


def _stored_box(items: list, join: str | None, kinds: dict[str, str], zone: str, depth: int) -> Box | Condition | None:
    if depth > MAX_NESTING:
        raise Refusal("depth", f"boxes nest at most {MAX_NESTING} deep")
    parts = []
    for item in items:
        if isinstance(item, dict) and "items" in item:
            if set(item) - {"join", "items"} or not isinstance(item["items"], list):
                raise Refusal("filter", "a group has a join and items")
            part = _stored_box(item["items"], item.get("join"), kinds, zone, depth + 1)
        else:
            part = _card(item, kinds, zone)
        if part is not None:
            parts.append(part)
    if join is not None and join not in JOINS:
        raise Refusal("join", f"{join!r} is none of {', '.join(JOINS)}")
    if len(parts) > 1 and join is None:
        raise Refusal("join", "several conditions need a join")
    return Box(join, tuple(parts)) if len(parts) > 1 else parts[0] if parts else None


def _card(item, kinds: dict[str, str], zone: str) -> Condition:
    if not isinstance(item, dict) or item.get("field") not in kinds:
        raise Refusal("field", "a condition names a field of the data set")
    kind, op = kinds[item["field"]], item.get("op")
    if item.get("part") is not None:
        if item["part"] != "time_of_day" or kind != "time" or op not in ("from", "until", "between"):
            raise Refusal("part", "a condition reads a field, or a time field's time of day")
        op = "clock" if op == "between" else op
    wanted = {"in": ("values",), "between": ("value", "value2"), "clock": ("value", "value2")}.get(op, () if op in ("present", "blank", "yes", "no") else ("value",))
    given = {k for k in ("value", "value2", "values") if item.get(k) not in (None, [])}
    if given - set(wanted):
        raise Refusal("values", f"{op} takes no {min(given - set(wanted))}")
    values = tuple(item.get("values") or ()) if op == "in" else tuple(item.get(k) for k in wanted)
    if op == "in" and not values or any(v is None for v in values):
        raise Refusal("values", f"{op} needs a value")
    return Condition(item["field"], op, kind, values, zone)
