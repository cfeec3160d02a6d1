"""Expressions as columns. Every function is total: bad input gives null, never an error, but for numbers out of range."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import Refusal
from ..functions import times
from ..functions.values import Value, equal, ordered
from ..sources.records import Records
from .gate import check, check_zone
from .syntax import COMPARISONS, Binary, Call, Literal, Path, Unary, parse, walk

#: Nodes of a tree, at most: a deep CASE would leave generated code.
MAX_NODES = 400


def _num(c: Column) -> Value:
    return Value("num", c)


def _text(c: Column) -> Value:
    return Value("str", c)


class Compiler:
    def __init__(self, records: Records, now_ms: float | None = None):
        self.records = records
        self.now_ms = now_ms if now_ms is not None else datetime.now(UTC).timestamp() * 1000

    def value(self, tree) -> Value:
        if isinstance(tree, Literal):
            v = tree.value
            if v is None:
                return Value("null", F.lit(None).cast("string"))
            return Value("bool" if isinstance(v, bool) else "num" if isinstance(v, float) else "str", F.lit(v))
        if isinstance(tree, Path):
            return self.records.at(tree.steps)
        if isinstance(tree, Unary):
            v = self.value(tree.operand)
            return _num(-v.number) if tree.op == "-" else Value("bool", ~v.truthy)
        if isinstance(tree, Binary):
            return self.binary(tree.op, self.value(tree.left), self.value(tree.right))
        rule = getattr(self, f"f_{tree.name}", None)
        if rule is None:
            raise Refusal("function", f"{tree.name} is unknown")
        return rule(tree)

    def binary(self, op: str, a: Value, b: Value) -> Value:
        if op in ("and", "or"):
            return Value("bool", a.truthy & b.truthy if op == "and" else a.truthy | b.truthy)
        if op in ("==", "!="):
            return Value("bool", equal(a, b) if op == "==" else ~equal(a, b))
        if op in COMPARISONS:
            return Value("bool", ordered(op, a, b))
        x, y = a.number, b.number
        if op in "+-*":
            out = x + y if op == "+" else x - y if op == "-" else x * y
            return _num(F.when(F.abs(out) == float("inf"), F.raise_error(F.lit("number out of range")).cast("double")).otherwise(out))
        safe = F.when(y != 0, y)
        return _num(x / safe if op == "/" else x % safe)

    def args(self, call: Call, n: int) -> list[Value] | None:
        """The values of n arguments; None if the call has another number of them."""
        return [self.value(a) for a in call.args] if len(call.args) == n else None

    def one(self, call: Call, rule, kind: str = "num") -> Value:
        v = self.args(call, 1)
        return Value(kind, rule(v[0])) if v else Value("null", F.lit(None).cast("string"))

    def f_number(self, c):
        return self.one(c, lambda v: v.number)

    def f_string(self, c):
        return self.one(c, lambda v: v.string, "str")

    def f_lower(self, c):
        return self.one(c, lambda v: F.lower(v.string), "str")

    def f_upper(self, c):
        return self.one(c, lambda v: F.upper(v.string), "str")

    def f_abs(self, c):
        return self.one(c, lambda v: F.abs(v.number))

    def f_floor(self, c):
        return self.one(c, lambda v: _whole(v.number, F.floor))

    def f_ceil(self, c):
        return self.one(c, lambda v: _whole(v.number, F.ceil))

    def f_round(self, c):
        if not 1 <= len(c.args) <= 2:
            return Value("null", F.lit(None).cast("string"))
        x, d = self.value(c.args[0]).number, self.value(c.args[1]).number if len(c.args) == 2 else F.lit(0.0)
        scale = F.pow(F.lit(10.0), _whole(d, lambda y: F.when(y < 0, F.ceil(y)).otherwise(F.floor(y))))
        return _num(F.signum(x) * _whole(F.abs(x * scale) + 0.5, F.floor) / scale)

    def f_length(self, c):
        def rule(v: Value) -> Column:
            if v.kind == "str":
                return F.char_length(v.column).cast("double")
            if v.kind != "json":
                return F.lit(None).cast("double")
            group = F.size(F.map_keys(F.try_variant_get(F.when(v.tag == "obj", v.column), "$", "map<string,variant>")))
            return F.coalesce(F.char_length(v.text), F.when(v.tag == "arr", F.size(v.items)), F.when(v.tag == "obj", group)).cast("double")

        return self.one(c, rule)

    def f_concat(self, c):
        return _text(F.concat(F.lit(""), *(F.coalesce(self.value(a).string, F.lit("")) for a in c.args)))

    def f_contains(self, c):
        v = self.args(c, 2)
        if not v:
            return Value("null", F.lit(None).cast("string"))
        within = F.coalesce(v[0].string.contains(v[1].string), F.lit(False))
        if v[0].kind != "json":
            return Value("bool", within)
        member = F.exists(v[0].items, lambda x: equal(Value("json", x), v[1], item=True))
        return Value("bool", F.coalesce(F.when(v[0].tag == "arr", member).otherwise(within), F.lit(False)))

    def _listed(self, call: Call, rule_value, rule_item) -> Column:
        """An array of all arguments, or of the elements of a single list."""
        values = [self.value(a) for a in call.args]
        array = F.array(*(rule_value(v) for v in values)) if values else F.array().cast("array<double>")
        if len(values) == 1 and values[0].kind == "json":
            return F.when(values[0].tag == "arr", F.transform(values[0].items, rule_item)).otherwise(array)
        return array

    def _numbers(self, call: Call) -> Column:
        return F.filter(self._listed(call, lambda v: v.number, lambda x: Value("json", x).number), lambda x: x.isNotNull())

    def f_count(self, c):
        present = self._listed(c, lambda v: F.when(~v.missing, 1.0), lambda x: F.when(~Value("json", x).missing, 1.0))
        return _num(F.size(F.filter(present, lambda x: x.isNotNull())).cast("double"))

    def f_sum(self, c):
        xs = self._numbers(c)
        return _num(F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)))

    def f_avg(self, c):
        xs = self._numbers(c)
        return _num(F.when(F.size(xs) > 0, F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)))

    def f_min(self, c):
        return _num(F.array_min(self._numbers(c)))

    def f_max(self, c):
        return _num(F.array_max(self._numbers(c)))

    def _either(self, tests: list[Column], values: list[Value]) -> Value:
        """The value of the first test that holds, in the one kind of all values or as JSON."""
        kinds = {v.kind for v in values if v.kind != "null"}
        kind = kinds.pop() if len(kinds) == 1 else "json" if kinds else "null"
        sql = {"num": "double", "str": "string", "bool": "boolean", "json": "variant", "null": "string"}[kind]
        out = F.lit(None).cast("string").cast(sql) if kind != "json" else F.try_parse_json(F.lit(None).cast("string"))
        for test, v in reversed(list(zip(tests, values, strict=True))):
            column = v.column if v.kind == kind else F.lit(None).cast(sql) if v.kind == "null" and kind != "json" else _as_json(v)
            out = F.when(test, column).otherwise(out)
        return Value(kind, out, branches=tuple(zip(tests, values, strict=True)) if kind == "json" else ())

    def f_coalesce(self, c):
        values = [self.value(a) for a in c.args]
        return self._either([~v.missing for v in values], values)

    def f_if(self, c):
        if len(c.args) != 3:
            return Value("null", F.lit(None).cast("string"))
        test, a, b = (self.value(x) for x in c.args)
        return self._either([test.truthy, ~test.truthy], [a, b])

    def f_now(self, c):
        return _text(times.written(F.lit(self.now_ms), F.lit(False)))

    def f_today(self, c):
        return _text(times.written(F.lit(self.now_ms), F.lit(True)))

    def f_days_between(self, c):
        v = self.args(c, 2)
        return _num((times.millis(v[1].text) - times.millis(v[0].text)) / times.DAY_MS) if v else Value("null", F.lit(None).cast("string"))

    def f_date_add(self, c):
        v = self.args(c, 2)
        return _text(times.written(times.millis(v[0].text) + v[1].number * times.DAY_MS, times.is_date(v[0].text))) if v else Value("null", F.lit(None).cast("string"))

    def f_time_of_day(self, c):
        zone = check_zone(c)
        v = self.value(c.args[0])
        return _num(times.seconds_of_day(times.clock_instant(v.text) if v.instant is None else v.instant, zone))


def _whole(x: Column, rule) -> Column:
    """Rounding that stays a double: from 2**53 on every double is whole, and a long would saturate."""
    return F.when(F.abs(x) < float(1 << 53), rule(x).cast("double")).otherwise(x)


def _as_json(v: Value) -> Column:
    if v.kind == "json":
        return v.column
    if v.kind == "null":
        return F.try_parse_json(F.lit(None).cast("string"))
    return F.try_variant_get(F.to_variant_object(F.array(v.column)), "$[0]", "variant")


def compile_value(source: str, records: Records, strict: bool = False, now_ms: float | None = None) -> Value:
    """The value of an expression over records."""
    tree = parse(source)
    if strict:
        check(tree)
    if sum(1 for _ in walk(tree)) > MAX_NODES:
        raise Refusal("size", f"an expression has at most {MAX_NODES} parts")
    return Compiler(records, now_ms).value(tree)


def compile_condition(source: str, records: Records, strict: bool = False, now_ms: float | None = None) -> Column:
    """True exactly where the expression is truthy."""
    return compile_value(source, records, strict, now_ms).truthy
