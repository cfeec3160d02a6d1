"""Which constructs the strict profile of the language allows."""

from __future__ import annotations

import re
from zoneinfo import available_timezones

from ..errors import Refusal
from .syntax import Binary, Call, Literal, Path, walk

# The functions of the strict profile, and those that only the full language has.
ALLOWED = frozenset({"abs", "coalesce", "count", "if", "length", "max", "min", "time_of_day"})
FULL_ONLY = frozenset({"round", "floor", "ceil", "sum", "avg", "string", "number", "concat", "contains", "lower", "upper", "today", "now", "days_between", "date_add"})
RESERVED = frozenset({"key", "collection", "bucket", "value"})
MAX_INDEX = 1 << 31


def check(tree) -> None:
    """Refuses what the strict profile lacks, by name."""
    for node in walk(tree):
        if isinstance(node, Binary) and node.op == "%":
            raise Refusal("operator", "% is outside the strict profile")
        if isinstance(node, Path) and any(isinstance(s, int) and abs(s) >= MAX_INDEX for s in node.steps):
            raise Refusal("index", "an index is below 2**31 in size")
        if isinstance(node, Call):
            if node.name in FULL_ONLY:
                raise Refusal("function", f"{node.name} is outside the strict profile")
            if node.name not in ALLOWED:
                raise Refusal("function", f"{node.name} is unknown")
            if node.name == "time_of_day":
                check_zone(node)


def check_zone(node: Call) -> str:
    """The zone that a time_of_day call names."""
    if len(node.args) != 2 or not isinstance(node.args[1], Literal) or not isinstance(node.args[1].value, str):
        raise Refusal("zone", "time_of_day takes a time and a zone written out")
    if node.args[1].value not in available_timezones():
        raise Refusal("zone", f"{node.args[1].value!r} is no zone")
    return node.args[1].value


def check_alias(name: str, taken: set[str]) -> None:
    """Refuses a computed column's name that is malformed, reserved or taken."""
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]{0,62}", name):
        raise Refusal("alias", f"{name!r} is no name of a column")
    if name in RESERVED:
        raise Refusal("alias", f"{name} is reserved")
    if name in taken:
        raise Refusal("alias", f"{name} is taken")
    taken.add(name)
