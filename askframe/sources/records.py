"""Records: typed tables or JSON documents, read by field paths."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import Refusal
from ..functions.values import DECIMAL, Value


@dataclass(frozen=True)
class Series:
    """Fields that hold a record's time and the member whose series it belongs to."""

    time: str
    member: str


@dataclass(frozen=True)
class Records:
    """frame has key (string) and either doc (variant) or typed columns; series if the records are a time series."""

    frame: DataFrame
    typed: bool
    series: Series | None = None
    tie: str = "key"
    folded: bool = False
    noun: str | None = None

    @classmethod
    def from_table(cls, df: DataFrame, key: list[str], series: Series | None = None) -> Records:
        """A typed table: a path of one name is its column, so filters and columns reach the scan. Numbers tie by value."""
        return cls(df.withColumn("key", F.concat_ws(":", *(F.col(k).cast("string") for k in key))), True, series, key[0] if len(key) == 1 else "key")

    @classmethod
    def from_json(cls, df: DataFrame, collection: str | None = None, owner: tuple[str, str] | None = None, series: Series | None = None, folded: bool = False) -> Records:
        """(collection, key, data) rows with JSON text; one collection and owner of them. A text that isn't JSON is null.

        folded: a record also answers to its top-level keys with all spaces as underscores or the other way round, where it
        lacks the key itself, and to _noun_type with the collection's name."""
        if collection is not None:
            df = df.where(F.col("collection") == collection)
        if owner is not None:
            df = df.where(F.col(owner[0]) == owner[1])
        return cls(df.select("key", F.try_parse_json("data").alias("doc")), False, series, folded=folded, noun=collection)

    def at(self, steps: tuple) -> Value:
        """The value at a path; a step that fails gives null."""
        if self.typed:
            return self._column(steps)
        v = F.col("doc")
        if self.folded:
            if not steps:
                raise Refusal("fold", "the whole record has no fixed form where keys are folded")
            if isinstance(steps[0], str):
                v, steps = self._folded(steps[0]), steps[1:]
        if any(isinstance(s, int) for s in steps):
            for s in steps:
                if isinstance(s, int):
                    items = F.try_variant_get(F.when(F.schema_of_variant(v).startswith("ARRAY"), v), "$", "array<variant>")
                    v = F.get(items, F.lit(s) if s >= 0 else F.size(items) + s)
                else:
                    v = F.try_variant_get(v, _json_path((s,)), "variant")
            return Value("json", v)
        return Value("json", F.try_variant_get(v, _json_path(steps), "variant") if steps else v)

    def _folded(self, key: str) -> Column:
        """The first of a key and of those it may be a copy of that the record has, if only with a JSON null."""
        found = [F.try_variant_get("doc", _json_path((k,)), "variant") for k in (key, *copied_from(key))]
        if key == "_noun_type" and self.noun is not None:
            found.append(F.try_variant_get(F.to_variant_object(F.array(F.lit(self.noun))), "$[0]", "variant"))
        return F.coalesce(*found)

    def _column(self, steps: tuple) -> Value:
        if len(steps) == 1 and isinstance(steps[0], str) and steps[0] in self.frame.columns:
            kind = self.frame.schema[steps[0]].dataType
            c = F.col(f"`{steps[0]}`")
            if isinstance(kind, T.NumericType):
                real = isinstance(kind, (T.DoubleType, T.FloatType))
                finite = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c) if real else c
                return Value("num", finite.cast("double"), exact=finite.try_cast(DECIMAL))
            if isinstance(kind, T.BooleanType):
                return Value("bool", c)
            if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
                return Value("str", F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'"), instant=c.cast("timestamp"))
            if isinstance(kind, (T.StringType, T.DateType)):
                return Value("str", c.cast("string"))
            raise Refusal("type", f"{steps[0]} is neither text, number, yes/no nor time")
        return Value("null", F.lit(None).cast("string"))

    def instant(self, steps: tuple, zone: str | None = None) -> Column:
        """The moment that a field holds; typed times are UTC wall time."""
        from ..functions.times import moment

        if self.typed and len(steps) == 1 and steps[0] in self.frame.columns and isinstance(self.frame.schema[steps[0]].dataType, (T.TimestampType, T.TimestampNTZType)):
            return F.col(steps[0]).cast("timestamp")
        return moment(self.at(steps).text, zone)

    def has(self, steps: tuple) -> Column:
        """Whether the record has the field at all, if only with a JSON null."""
        return F.lit(True) if self.typed and steps and steps[0] in self.frame.columns else self.at(steps).column.isNotNull()


# Fixed value: the most separators of a folded key.
MAX_SEPARATORS = 6


def copied_from(key: str) -> list[str]:
    """The keys whose copy a key may be, in code point order: one with separators of one kind is the copy of those with some
    of them swapped for the other kind."""
    kinds = {c for c in key if c in " _"}
    if len(kinds) != 1:
        return []
    own = kinds.pop()
    places = [k for k, c in enumerate(key) if c == own]
    if len(places) > MAX_SEPARATORS:
        raise Refusal("fold", f"{key!r} has more than {MAX_SEPARATORS} separators")
    spellings = [""]
    for c in key:
        spellings = [s + x for s in spellings for x in ((own, "_" if own == " " else " ") if c == own else (c,))]
    return sorted(s for s in spellings if s != key)


def _json_path(steps: tuple) -> str:
    return "$" + "".join('["' + s.replace("\\", "\\\\").replace('"', '\\"') + '"]' for s in steps)
