"""Boards by group, matches with another data set, and the profiles that say whether a match is safe to count over."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import Refusal
from ..functions import times
from ..plans.compiler import compile_condition
from ..plans.syntax import parse_path
from ..sources.records import Records
from .pick import mean, sort_keys

# The most count-if columns of a board, and the most fields that a match adds.
MAX_COUNTS, MAX_FIELDS = 6, 6


@dataclass(frozen=True)
class Match:
    """Records of other whose `theirs` equals `ours`, as a number or as text; nothing else ever matches."""

    ours: str
    theirs: str
    kind: str = "string"


@dataclass(frozen=True)
class Board:
    """Groups of a field, or one row a record of the parents when match relates counted records to these.

    counts: (name, expression); shares: names of counts that get their percentage too; times: (name, min or max, field),
    of texts as they are or, with a fourth part "time", of moments;
    measures: (name, sum, avg, min or max, field); sort: a column's name.
    """

    group: str
    counts: tuple = ()
    shares: bool = True
    times: tuple = ()
    measures: tuple = ()
    sort: str | None = None
    direction: str = "asc"
    cap: int | None = None


def match_key(records: Records, path: str, kind: str) -> Column:
    """What compares in a match: null never matches, numbers by value, text exactly."""
    if kind not in ("string", "number"):
        raise Refusal("match", f"{kind!r} is neither string nor number")
    value = records.at(parse_path(path))
    if kind == "string":
        return value.text
    number = value.num + F.lit(0.0)  # no negative zero
    return F.concat(number.cast("string"), F.lit("|"), F.coalesce(value.held.cast("string"), F.lit("")))


@dataclass(frozen=True)
class _Column:
    """A board's column in two steps: partial aggregates of counted rows, and what comes of partials that are put together."""

    name: str
    partials: dict[str, Column]
    merged: dict[str, str]  # sum, min or max of each partial
    final: Callable[[Callable[[str], Column]], Column]


def _columns(records: Records, board: Board) -> list[_Column]:
    if len(board.counts) > MAX_COUNTS:
        raise Refusal("counts", f"a board has at most {MAX_COUNTS} counts")
    out = [_Column("rows", {"_rows": F.count(F.lit(1))}, {"_rows": "sum"}, lambda c: F.coalesce(c("_rows"), F.lit(0)))]
    for i, (name, source) in enumerate(board.counts):
        hit = f"_hit{i}"
        partial = {hit: F.sum(F.when(compile_condition(source, records), 1).otherwise(0))}
        out.append(_Column(name, partial, {hit: "sum"}, lambda c, hit=hit: F.coalesce(c(hit), F.lit(0))))
        if board.shares:

            def share(c, hit=hit):
                rows = c("_rows")
                return F.coalesce(F.round(c(hit).cast("decimal(18,0)") * 100 / F.when(rows > 0, rows).cast("decimal(18,0)"), 1), F.lit(0)).cast("decimal(38,1)")

            out.append(_Column(f"{name}_pct", {}, {}, share))
    for i, (name, function, field, *kind) in enumerate(board.times):
        value, at = records.at(parse_path(field)), f"_time{i}"
        text = value.text if value.kind == "json" else value.column
        if kind:
            text = F.date_format(value.instant, "yyyy-MM-dd'T'HH:mm:ss'Z'") if value.instant is not None else times.to_second(text)
        out.append(_Column(name, {at: getattr(F, function)(text)}, {at: function}, lambda c, at=at: c(at)))
    for i, (name, function, field) in enumerate(board.measures):
        number, total, n = records.at(parse_path(field)).decimal, f"_total{i}", f"_n{i}"
        if function in ("min", "max"):
            out.append(_Column(name, {total: getattr(F, function)(number)}, {total: function}, lambda c, total=total: c(total)))
        elif function == "sum":
            out.append(_Column(name, {total: F.sum(number)}, {total: "sum"}, lambda c, total=total: F.round(c(total), 6)))
        else:
            out.append(_Column(name, {total: F.sum(number), n: F.count(number)}, {total: "sum", n: "sum"}, lambda c, total=total, n=n: mean(c(total), F.coalesce(c(n), F.lit(0)))))
    return out


def _partials(columns: list[_Column]) -> list[Column]:
    return [c.alias(k) for column in columns for k, c in column.partials.items()]


def _finals(columns: list[_Column]) -> list[Column]:
    return [column.final(F.col).alias(column.name) for column in columns]


def own_rows(records: Records, board: Board, where: str | None = None) -> DataFrame:
    """A board of the records' own groups; blanks are one group, empty text is a group of its own."""
    frame = records.frame.where(compile_condition(where, records)) if where else records.frame
    value = records.at(parse_path(board.group))
    keys = sort_keys(replace(value, instant=None), ~value.missing)
    names = [f"_k{i}" for i in range(len(keys))]
    held = frame.withColumns({"_shown": F.to_json(value.column) if value.kind == "json" else value.column, **dict(zip(names, keys, strict=True))})
    columns = _columns(records, board)
    out = held.groupBy(*names).agg(F.first("_shown", ignorenulls=True).alias("_group"), *_partials(columns))
    return _finished(out.select(*names, F.col("_group").alias(parse_path(board.group)[-1]), *_finals(columns)), board, names)


def related(parents: Records, counted: Records, match: Match, board: Board) -> DataFrame:
    """A board with every parent's group, counting the records that match the parents; groups without any stay, at 0.

    Counted records are aggregated by what they match before they meet the parents. Refused where a counted record matches
    several parents: it would count twice. For that, only what several parents share is looked for.
    """
    several = _repeated(parents, match.ours, match.kind)
    if several.take(1) and several.join(counted.frame.select(match_key(counted, match.theirs, match.kind).alias("_match")), "_match", "left_semi").take(1):
        raise Refusal("double count", "a counted record matches more than one parent")
    columns = _columns(counted, board)
    rows = counted.frame.withColumn("_match", match_key(counted, match.theirs, match.kind)).where("_match is not null").groupBy("_match").agg(*_partials(columns))
    own = parents.frame.select(match_key(parents, match.ours, match.kind).alias("_match"), parents.at(parse_path(board.group)).canonical.alias("_group"))
    merged = [getattr(F, how)(k).alias(k) for column in columns for k, how in column.merged.items()]
    out = own.join(rows, "_match", "left").groupBy("_group").agg(*merged)
    return _finished(out.select(F.col("_group").alias(board.group), *_finals(columns)), board, [board.group])


def _repeated(records: Records, path: str, kind: str) -> DataFrame:
    """_match of what several records have."""
    return records.frame.groupBy(match_key(records, path, kind).alias("_match")).count().where("count > 1 and _match is not null").select("_match")


def _finished(out: DataFrame, board: Board, keys: list[str]) -> DataFrame:
    first = [F.col(board.sort).asc_nulls_last() if board.direction == "asc" else F.col(board.sort).desc_nulls_last()] if board.sort else []
    out = out.orderBy(*first, *(F.col(k).asc_nulls_last() for k in keys))
    out = out.limit(board.cap) if board.cap else out
    return out.drop(*(k for k in keys if k.startswith("_k")))


def _degrees(left: Records, right: Records, match: Match) -> tuple[DataFrame, DataFrame]:
    """How many rows of either side have each key."""
    ours = left.frame.groupBy(match_key(left, match.ours, match.kind).alias("k")).agg(F.count(F.lit(1)).alias("n_left"))
    theirs = right.frame.groupBy(match_key(right, match.theirs, match.kind).alias("k2")).agg(F.count(F.lit(1)).alias("n_right"))
    return ours, theirs


def profile_related(parents: Records, counted: Records, match: Match) -> DataFrame:
    """One row: parents, parents_none, least, most (counted records of a parent), counted, counted_none, counted_twice,
    most_parents (of a counted record). Both sides meet as counts by key."""
    ours, theirs = _degrees(parents, counted, match)
    both = ours.join(theirs, F.col("k") == F.col("k2"), "full")
    has = F.coalesce("n_right", F.lit(0))
    of_parents = F.when(F.col("n_left").isNotNull(), has)
    up = F.coalesce("n_left", F.lit(0))
    of_counted = F.when(F.col("n_right").isNotNull(), up)
    long = "bigint"
    return both.agg(
        F.coalesce(F.sum("n_left"), F.lit(0)).cast(long).alias("parents"),
        F.coalesce(F.sum(F.when(of_parents == 0, F.col("n_left"))), F.lit(0)).cast(long).alias("parents_none"),
        F.min(of_parents).cast(long).alias("least"),
        F.max(of_parents).cast(long).alias("most"),
        F.coalesce(F.sum("n_right"), F.lit(0)).cast(long).alias("counted"),
        F.coalesce(F.sum(F.when(of_counted == 0, F.col("n_right"))), F.lit(0)).cast(long).alias("counted_none"),
        F.coalesce(F.sum(F.when(of_counted > 1, F.col("n_right"))), F.lit(0)).cast(long).alias("counted_twice"),
        F.max(of_counted).cast(long).alias("most_parents"),
    )


def profile_lookup(rows: Records, other: Records, match: Match) -> DataFrame:
    """One row: rows, rows_none, least, most (others of a row), repeated (rows with several), others."""
    ours, theirs = _degrees(rows, other, match)
    has = F.when(F.col("n_left").isNotNull(), F.coalesce("n_right", F.lit(0)))

    def total(test: Column, of: str) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col(of))), F.lit(0)).cast("bigint")

    both = ours.join(theirs, F.col("k") == F.col("k2"), "full")
    return both.agg(total(F.lit(True), "n_left").alias("rows"), total(has == 0, "n_left").alias("rows_none"), F.min(has).cast("bigint").alias("least"), F.max(has).cast("bigint").alias("most"), total(has > 1, "n_left").alias("repeated"), total(F.lit(True), "n_right").alias("others"))


def lookup(rows: Records, other: Records, match: Match, columns: tuple, added: tuple, sort: str | None = None, direction: str = "asc", cap: int | None = None) -> DataFrame:
    """Rows with fields of the matching record of other, named other_<field>; refused where a row matches several."""
    if len(added) > MAX_FIELDS:
        raise Refusal("fields", f"a match adds at most {MAX_FIELDS} fields")
    several = _repeated(other, match.theirs, match.kind)
    if several.take(1) and several.join(rows.frame.select(match_key(rows, match.ours, match.kind).alias("_match")), "_match", "left_semi").take(1):
        raise Refusal("double count", "a row matches more than one record")

    def shown(records: Records, path: str) -> Column:
        v = records.at(parse_path(path))
        return F.to_json(v.column) if v.kind == "json" else v.column

    keys = sort_keys(rows.at(parse_path(sort)), rows.has(parse_path(sort))) if sort else []
    left = rows.frame.select("key", match_key(rows, match.ours, match.kind).alias("_match"), *(shown(rows, c).alias(parse_path(c)[-1]) for c in columns), *(k.alias(f"_s{i}") for i, k in enumerate(keys)), F.col(rows.tie).alias("_tie"))
    right = other.frame.select(match_key(other, match.theirs, match.kind).alias("_other"), F.col(other.tie).alias("_tie2"), *(shown(other, c).alias(f"other_{parse_path(c)[-1]}") for c in added))
    out = left.join(right, F.col("_match") == F.col("_other"), "left")
    if sort or cap:
        way = "asc_nulls_last" if direction == "asc" else "desc_nulls_last"
        out = out.orderBy(*(getattr(F.col(f"_s{i}"), way)() for i in range(len(keys))), "_tie", "_tie2")
    out = out.limit(cap) if cap else out
    return out.drop("_match", "_other", "_tie", "_tie2", *(f"_s{i}" for i in range(len(keys))))
