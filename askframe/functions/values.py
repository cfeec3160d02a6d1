"""A value of the language as a bundle of lazy columns: what it is, and what it reads as."""

from __future__ import annotations

import json
from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space that text may have around a number.
TRIM = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0                　"
#: Exact numbers: 20 digits before the point and 18 behind it. JSON numbers beyond that are refused by name.
DECIMAL = "decimal(38,18)"


def _digits() -> tuple[str, str]:
    import unicodedata

    other = [chr(c) for c in range(128, 0x20000) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(other), "".join(str(unicodedata.digit(c)) for c in other)


_ANY, _ASCII = _digits()


def plain_text(text: Column) -> Column:
    """A text without white space around it, its digits of any script as 0 to 9."""
    return F.translate(F.btrim(text, F.lit(TRIM)), _ANY, _ASCII)


def number_text(text: Column) -> Column:
    """A double, where the trimmed text is a whole decimal in digits of any script; else null."""
    plain = plain_text(text)
    fits = plain.rlike(r"\A[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z")
    read = F.when(fits, plain.try_cast("double"))
    return F.when(F.abs(read) == float("inf"), F.raise_error(F.lit("number out of range")).cast("double")).otherwise(read)


def number_shape(x: Column) -> Column:
    """A number's shortest text: whole numbers below 2**53 natively, others by Python's shortest digits in ECMA form."""
    whole = (x == F.floor(x)) & (F.abs(x) < float(1 << 53))
    return F.when(x.isNull(), F.lit(None)).when(whole, F.when(whole, x).cast("bigint").cast("string")).otherwise(_ecma(F.when(~whole, x)))


@F.pandas_udf(T.StringType())
def _ecma(s: pd.Series) -> pd.Series:
    return s.map(ecma_text)


def ecma_text(x) -> str | None:
    """The shortest text of a double: plain from 1e-6 up to 1e21, with an exponent beyond."""
    if x is None or x != x:
        return None
    sign, shortest = ("-" if x < 0 else ""), repr(abs(x))
    digits, _, e = shortest.partition("e")
    whole, _, part = digits.partition(".")
    point = len(whole) + int(e or 0)
    body = (whole + part).lstrip("0")
    point -= len(whole + part) - len((whole + part).lstrip("0"))
    body = body.rstrip("0") or "0"
    if body == "0":
        return "0"
    n = len(body)
    if n <= point <= 21:
        return sign + body + "0" * (point - n)
    if 0 < point <= 21:
        return sign + body[:point] + "." + body[point:]
    if -6 < point <= 0:
        return sign + "0." + "0" * -point + body
    e = point - 1
    return sign + body[0] + ("." + body[1:] if n > 1 else "") + f"e{'+' if e > 0 else '-'}{abs(e)}"


def order_bytes(v) -> bytes:
    """Bytes that order JSON values as null < text < number < yes/no < list < group: lists by length, then by element; groups
    by their number of pairs, then by key (shorter first) and value, pair by pair."""
    if v is None:
        return b"\x01"
    if isinstance(v, str):
        return b"\x02" + v.encode("utf-8", "surrogatepass").replace(b"\0", b"\0\xff") + b"\0\0"
    if isinstance(v, bool):
        return b"\x04" + bytes([v])
    if isinstance(v, list):
        return b"\x05" + len(v).to_bytes(4, "big") + b"".join(map(order_bytes, v))
    if isinstance(v, dict):
        pairs = sorted(((k.encode("utf-8", "surrogatepass"), x) for k, x in v.items()), key=lambda p: (len(p[0]), p[0]))
        return b"\x06" + len(pairs).to_bytes(4, "big") + b"".join(len(k).to_bytes(4, "big") + k + order_bytes(x) for k, x in pairs)
    sign, digits, exponent = v.as_tuple()
    body = bytes(digits).lstrip(b"\0")
    if not body:
        return b"\x03\x01"
    point = len(body) + exponent
    own = (point + (1 << 31)).to_bytes(4, "big") + bytes(d + 1 for d in body.rstrip(b"\0")) + b"\0"
    return b"\x03" + (b"\0" + bytes(255 - x for x in own) if sign else b"\x02" + own)


@F.pandas_udf(T.BinaryType())
def json_order(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else order_bytes(json.loads(x, parse_float=Decimal, parse_int=Decimal)))


@dataclass
class Value:
    """kind: null, bool, num, str or json (known only in each row). column: of the matching type, a variant for json."""

    kind: str
    column: Column
    exact: Column | None = None  # the number as a decimal, of typed columns
    instant: Column | None = None  # the moment, of typed times
    branches: tuple = ()  # of a choice between kinds: (test, value), the first test that holds; readings go to the values

    def _chosen(self, read, none: Column) -> Column:
        for test, value in reversed(self.branches):
            none = F.when(test, read(value)).otherwise(none)
        return none

    @property
    def tag(self) -> Column:
        """null, bool, num, str, arr or obj in each row."""
        if self.branches:
            return self._chosen(lambda v: v.tag, F.lit("null"))
        if self.kind != "json":
            return F.when(self.column.isNull(), "null").otherwise(self.kind) if self.kind != "null" else F.lit("null")
        shape = F.schema_of_variant(self.column)
        kind = F.when(shape.isNull(), "null").when(shape.startswith("ARRAY"), "arr").when(shape.startswith("OBJECT"), "obj").when(shape == "STRING", "str").when(shape == "BOOLEAN", "bool").when(shape == "VOID", "null").otherwise("num")
        return kind

    @property
    def missing(self) -> Column:
        return self.tag == "null" if self.kind == "json" else F.lit(True) if self.kind == "null" else self.column.isNull()

    def _of(self, kind: str, spark_type: str) -> Column:
        if self.branches:
            return self._chosen(lambda v: v._of(kind, spark_type), F.lit(None).cast(spark_type))
        if self.kind == "json":
            return F.when(self.tag == kind, F.try_variant_get(self.column, "$", spark_type))
        return self.column if self.kind == kind else F.lit(None).cast(spark_type)

    @property
    def num(self) -> Column:
        return self._of("num", "double")

    @property
    def text(self) -> Column:
        return self._of("str", "string")

    @property
    def flag(self) -> Column:
        return self._of("bool", "boolean")

    @property
    def decimal(self) -> Column:
        """The exact number of JSON or typed numbers; text, booleans and lists read as null. One that 38 digits, 18 of them
        behind the point, don't hold is refused, but a typed double is read to 18 places."""
        if self.kind not in ("json", "num"):
            return F.lit(None).cast(DECIMAL)
        number = self.num if self.kind == "json" else self.column
        return F.when(number.isNotNull() & self.held.isNull(), F.raise_error(F.lit("a number is beyond exact reading")).cast(DECIMAL)).otherwise(self.held)

    @property
    def held(self) -> Column:
        """As decimal, but null of a number that isn't held exactly."""
        if self.branches:
            return self._chosen(lambda v: v.held, F.lit(None).cast(DECIMAL))
        if self.exact is not None:
            return self.exact
        if self.kind == "json":
            shape, read = F.schema_of_variant(self.column), F.try_variant_get(self.column, "$", DECIMAL)
            scale = F.regexp_extract(shape, r"\ADECIMAL\([0-9]+,([0-9]+)\)\z", 1).try_cast("int")
            whole = F.when(shape == "DOUBLE", read.cast("double") == self.num).otherwise(F.coalesce(scale, F.lit(0)) <= 18)
            return F.when((self.tag == "num") & whole, read)
        return self.column.try_cast(DECIMAL) if self.kind == "num" else F.lit(None).cast(DECIMAL)

    @property
    def canonical(self) -> Column:
        """Text that is equal for equal values of the same tag."""
        if self.kind == "json":
            return F.to_json(self.column)
        return self.column.cast("string")

    @property
    def number(self) -> Column:
        """What arithmetic reads: a number, 1 or 0 of a boolean, or a text that is a decimal."""
        if self.branches:
            return self._chosen(lambda v: v.number, F.lit(None).cast("double"))
        if self.kind == "num":
            return self.column
        if self.kind == "bool":
            return self.column.cast("double")
        if self.kind == "str":
            return number_text(self.column)
        if self.kind == "null":
            return F.lit(None).cast("double")
        return F.coalesce(self.num, self.flag.cast("double"), number_text(self.text))

    @property
    def truthy(self) -> Column:
        """false for null, false, 0, empty text, empty list and empty group; never null."""
        if self.branches:
            return self._chosen(lambda v: v.truthy, F.lit(False))
        if self.kind == "bool":
            return F.coalesce(self.column, F.lit(False))
        if self.kind == "num":
            return F.coalesce(self.column != 0, F.lit(False))
        if self.kind == "str":
            return F.coalesce(self.column != "", F.lit(False))
        if self.kind == "null":
            return F.lit(False)
        t = self.tag
        full = ~F.to_json(self.column).isin("[]", "{}")
        return F.coalesce(F.when(t == "bool", self.flag).when(t == "num", self.num != 0).when(t == "str", self.text != "").when(t.isin("arr", "obj"), full), F.lit(False))

    @property
    def string(self) -> Column:
        """The text form: text itself, true/false, a number's shortest text; null of lists and groups."""
        if self.branches:
            return self._chosen(lambda v: v.string, F.lit(None).cast("string"))
        if self.kind == "str":
            return self.column
        if self.kind == "num":
            return number_shape(self.column)
        if self.kind == "bool":
            return self.column.cast("string")
        if self.kind == "null":
            return F.lit(None).cast("string")
        return F.coalesce(self.text, self.flag.cast("string"), number_shape(self.num))

    @property
    def items(self) -> Column:
        """A list's elements as variants; null of anything else."""
        if self.kind != "json":
            return F.lit(None).cast("array<variant>")
        return F.when(self.tag == "arr", F.try_variant_get(self.column, "$", "array<variant>"))


def equal(a: Value, b: Value, item: bool = False) -> Column:
    """Two-valued equality: null equals null, no boolean equals a number, numbers compare as doubles, lists in depth by value;
    an item of a list by its canonical text, as no Python runs within a list's functions."""
    if "json" not in (a.kind, b.kind):
        if a.kind == b.kind and a.kind != "null":
            return a.column.eqNullSafe(b.column)
        return a.missing & b.missing
    ta, tb = a.tag, b.tag
    same = F.when(ta == "num", a.num == b.num).when(ta == "str", a.text == b.text).when(ta == "bool", a.flag == b.flag)
    if a.kind == b.kind == "json":
        deep = ta.isin("arr", "obj") & (ta == tb)
        same = same.when(deep, a.canonical == b.canonical if item else json_order(F.when(deep, a.canonical)) == json_order(F.when(deep, b.canonical)))
    return F.coalesce(F.when(ta != tb, False).when(ta == "null", True).otherwise(same), F.lit(False))


def ordered(op: str, a: Value, b: Value) -> Column:
    """Three-valued order: number with number and text with text; null otherwise."""

    def compare(x: Column, y: Column) -> Column:
        return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    if a.kind == b.kind == "num":
        return compare(a.column, b.column)
    if a.kind == b.kind == "str":
        return compare(a.column, b.column)
    return F.when(a.num.isNotNull() & b.num.isNotNull(), compare(a.num, b.num)).when(a.text.isNotNull() & b.text.isNotNull(), compare(a.text, b.text))
