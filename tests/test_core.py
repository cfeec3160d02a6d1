"""The library's queries against DuckDB, and the language's rules one by one."""

import glob
import json
import math
import os
import random
from decimal import Decimal
from fractions import Fraction

import duckdb
import pytest

from askframe import contract
from askframe.errors import Refusal
from askframe.functions.values import ecma_text, order_bytes
from askframe.operators import axis, board, conditions, pick, probes
from askframe.operators.board import Board, Match
from askframe.plans import gate
from askframe.plans.compiler import compile_value
from askframe.plans.legality import Pick, validate
from askframe.plans.syntax import Binary, Literal, parse, parse_path, spell_path
from askframe.sources import store
from askframe.sources.records import Records, Series, copied_from

SF = "/root/testdata/sf0.001"


def _normal(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "~"
    if isinstance(value, (bool, str)):
        return str(value)
    try:
        return f"{float(value):.9g}"
    except (TypeError, ValueError):
        return str(value)


@pytest.mark.parametrize("name", sorted(contract.QUERIES))
def test_same_as_duckdb(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got, want = contract.QUERIES[name](spark, SF), con.sql(contract.ORACLE[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(tuple(_normal(r[c]) for c in columns) for r in got.collect())
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(tuple(_normal(r[k]) for k in at) for r in want.fetchall())


def test_grammar():
    assert parse("1 + 2 * 3") == Binary("+", Literal(1.0), Binary("*", Literal(2.0), Literal(3.0)))
    assert spell_path(parse_path('["a b"].c')) == '["a b"].c'
    for bad in ("1 < 2 < 3", "$.", "1 +", "and", "$[1.5]", "1e999", "(" * 70 + "1" + ")" * 70, "1" * 2001, "f(1"):
        with pytest.raises(Refusal):
            parse(bad)


def test_gate():
    for ok in ("$.a > 1", "if($.a, 1, 2)", 'time_of_day($.t, "America/Denver") < 3600'):
        gate.check(parse(ok))
    for bad in ("$.a % 2", "round($.a)", "nosuch(1)", "$[2147483648]", 'time_of_day($.t, "Mars/Base")', "time_of_day($.t, $.z)"):
        with pytest.raises(Refusal):
            gate.check(parse(bad))


@pytest.mark.parametrize("x, text", [(1e21, "1e+21"), (1e23, "1e+23"), (123456789012345680000.0, "123456789012345680000"), (0.1, "0.1"), (1e-7, "1e-7"), (1.5e-6, "0.0000015"), (-2.25, "-2.25"), (0.0, "0"), (5e-324, "5e-324"), (1e100, "1e+100")])
def test_shortest_number_text(x, text):
    assert ecma_text(x) == text


DOCS = [
    ("a", '{"n": 1, "t": "12.5", "l": [1, "1", true], "z": null, "d": "2024-02-28", "s": "", "w": "2024-01-01T00:00:00+05:30"}'),
    ("b", '{"n": 2.50, "t": " \\uff11\\uff12 ", "l": [], "z": 0, "d": "2024-02-30", "o": {"a": 1, "b": [2]}}'),
    ("c", '{"n": true, "t": "1d", "l": {"x": 1}, "d": "2024-3-1", "w": "2024-01-01 00:00:00Z"}'),
    ("d", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame([("c1", k, d) for k, d in DOCS], "collection string, key string, data string")
    return Records.from_json(rows, "c1")


@pytest.mark.parametrize(
    "source, want",
    [
        ("$.n + 1", [2.0, 3.5, 2.0, None]),
        ("number($.t)", [12.5, 12.0, None, None]),
        ("$.n == 1", [True, False, False, False]),
        ("$.z == null", [True, False, True, True]),
        ('$.t < "2"', [True, True, True, None]),
        ("$.n < $.t", [None, None, None, None]),
        ("length($.l)", [3.0, 0.0, 1.0, None]),
        ("contains($.l, 1)", [True, False, False, False]),
        ("$.l[-1] == true", [True, False, False, False]),
        ("not $.s", [True, True, True, True]),
        ("count($.l)", [3.0, 0.0, 1.0, 0.0]),
        ("sum($.l)", [3.0, None, None, None]),
        ("$.n / 0", [None, None, None, None]),
        ("-7 % 3 + $.n * 0", [-1.0, -1.0, -1.0, None]),
        ("round(1.005, 2)", [1.0] * 4),
        ("floor(1e20)", [1e20] * 4),
        ('date_add($.d, 2)', ["2024-03-01", None, None, None]),
        ('days_between("2024-01-01", $.d)', [58.0, None, None, None]),
        ('time_of_day($.w, "UTC")', [66600.0, None, 0.0, None]),
        ("string($.n)", ["1", "2.5", "true", None]),
        ('coalesce($.z, $.t, "x")', None),
        ('if($.n > 1, "big", "small")', ["small", "big", "small", "small"]),
        ("$.o == $.o", [True, True, True, True]),
        ("min(3, $.n, 2)", [1.0, 2.0, 1.0, 2.0]),
        ("now() == now()", [True] * 4),
        ("abs(1, 2)", [None] * 4),
    ],
)
def test_language(docs, source, want):
    value = compile_value(source, docs)
    column = value.column if value.kind != "json" else value.string
    got = [r[0] for r in docs.frame.select(column.alias("v"), "key").orderBy("key").select("v").collect()]
    assert want is None and got == ["12.5", "0", "1d", "x"] or got == want


def test_overflow_is_refused(docs):
    with pytest.raises(Exception, match="out of range"):
        docs.frame.select(compile_value("$.n * 1e308 * 1e10", docs).column).collect()
    assert docs.frame.select(compile_value("if(false, 1e308 * 1e10 * $.n, 1)", docs).column).count() == 4


def test_sort_order_and_cap(docs):
    up = [r["key"] for r in pick.run(docs, Pick(sort="l")).collect()]
    down = [r["key"] for r in pick.run(docs, Pick(sort="l", direction="desc")).collect()]
    assert up == ["b", "a", "c", "d"] and down == ["c", "a", "b", "d"]
    assert [r["key"] for r in pick.run(docs, Pick(sort="n", cap=2)).collect()] == ["a", "b"]


def test_buckets_leave_unreadable_times_out(docs):
    rows = pick.run(docs, Pick(aggregate="count", bucket="month", bucket_field="d")).collect()
    assert [tuple(r) for r in rows] == [("2024-02-01T00:00:00Z", 1)]


def test_series_time_is_refused(spark):
    rows = spark.createDataFrame([("c", "k", '{"t": "soon", "m": 1}')], "collection string, key string, data string")
    own = Records.from_json(rows, series=Series("t", "m"))
    with pytest.raises(Exception, match="can't be read"):
        pick.run(own, Pick(aggregate="count", bucket="day")).collect()


def test_legality(docs):
    for bad in (Pick(aggregate="sum"), Pick(aggregate="count", field="n"), Pick(bucket="day"), Pick(changed=True), Pick(cap=0), Pick(cap=20001), Pick(aggregate="count", sort="n"), Pick(direction="up"), Pick(aggregate="count", bucket="day"), Pick(computed=(("key", "1"),)), Pick(computed=(("x", "1"), ("x", "2")))):
        with pytest.raises(Refusal):
            validate(bad, docs)
    assert validate(Pick(aggregate="count"), docs) == "SCALAR"


def test_average_rounds_once(spark):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate([0.000001, 0.000002])], "id long, v double")
    own = Records.from_table(rows, ["id"])
    assert str(pick.run(own, Pick(aggregate="avg", field="v")).first()[0]) == "0.000002"
    rows = spark.createDataFrame([(k, v) for k, v in enumerate([-0.000001, -0.000002])], "id long, v double")
    assert str(pick.run(Records.from_table(rows, ["id"]), Pick(aggregate="avg", field="v")).first()[0]) == "-0.000002"


def test_double_count_is_refused(spark):
    p = Records.from_table(spark.createDataFrame([(1, 1), (2, 1)], "id long, k long"), ["id"])
    c = Records.from_table(spark.createDataFrame([(9, 1)], "id long, k long"), ["id"])
    with pytest.raises(Refusal):
        board.related(p, c, Match("k", "k", "number"), Board("id"))
    with pytest.raises(Refusal):
        board.lookup(c, p, Match("k", "k", "number"), (), ("id",))


def test_blank_and_empty_text_are_groups(docs):
    rows = board.own_rows(docs, Board("s")).collect()
    assert [(r["s"], r["rows"]) for r in rows] == [('""', 1), (None, 3)]


def test_probes(docs):
    found = {(r["probe"], r["field"], r["key"]) for r in probes.probe(docs, "$.l == 1 and $.n > 2").collect()}
    assert found == {("nested", "l", "a")}
    with pytest.raises(Refusal):
        probes.refuse_unsafe(docs, "$.l == 1")


def json_records(spark, docs, series=None, **more):
    rows = spark.createDataFrame([("c", f"k{i}", d) for i, d in enumerate(docs)], "collection string, key string, data string")
    return Records.from_json(rows, "c", series=series, **more)


@pytest.mark.parametrize(
    "text, days",
    [
        ("2024-01-01T10:00Z", 10 / 24), ("2024-01-01T10:00", 10 / 24), ("2024-01-01 10:00+0530", 4.5 / 24), ("2024-01-01T00:00:00.25-01:00", (3600.25) / 86400), ("　2024-01-02 ", 1.0), ("２024-01-02", 1.0),
        ("２０２４-01-03", 2.0), ("2024-01-01T24:00", None), ("2024-01-01T10:00:00+99:99", (10 * 60 - 99 * 60 - 99) / 1440), ("2024-01-01T1:00", None), ("2024-02-30", None), ("0000-01-01", None), ("2024-01-01T10:00:00.1234567", None), ("2024-01-01t10:00", None),
    ],
)
def test_times_that_functions_read(spark, text, days):
    own = json_records(spark, [json.dumps({"t": text})])
    got = own.frame.select(compile_value('days_between("2024-01-01", $.t)', own).column).first()[0]
    assert got == days or got is not None and days is not None and abs(got - days) < 1e-12


def test_time_of_day_reads_naive_times_and_no_dates(spark):
    own = json_records(spark, ['{"t": "2024-01-01T10:00"}', '{"t": "2024-01-01"}', '{"t": "1969-12-31T23:59:59.5Z"}'])
    got = [r[0] for r in own.frame.orderBy("key").select(compile_value('time_of_day($.t, "UTC")', own).column).collect()]
    assert got == [36000.0, None, 86399.0]


def test_exact_numbers_are_exact_or_refused(spark):
    small = json_records(spark, ['{"n": 1e-13}', '{"n": 0.5}', '{"n": "7"}', '{"n": true}'])
    assert pick.run(small, Pick(aggregate="min", field="n")).first()[0] == Decimal("1E-13")
    assert pick.run(small, Pick(aggregate="sum", field="n")).first()[0] == Decimal("0.5")
    for odd in ("123456789012345678901234567890123456789012", "0.1234567890123456789", "1e400", "1e-19", "123456789012345678901"):
        own = json_records(spark, [f'{{"n": {odd}}}', '{"n": 1}'])
        with pytest.raises(Exception, match="beyond exact reading"):
            pick.run(own, Pick(aggregate="sum", field="n")).collect()
    typed = Records.from_table(spark.createDataFrame([(1, 2e12), (2, 1e-7), (3, float("nan"))], "id long, v double"), ["id"])
    assert pick.run(typed, Pick(aggregate="sum", field="v")).first()[0] == Decimal("2000000000000.000000")
    ours = Records.from_table(spark.createDataFrame([(1, 1e-7), (2, 5.0), (3, -0.0)], "id long, v double"), ["id"])
    theirs = Records.from_table(spark.createDataFrame([(1, 2e-7), (2, 5.0), (3, 0.0)], "id long, v double"), ["id"])
    got = {r["key"]: r["other_id"] for r in board.lookup(ours, theirs, Match("v", "v", "number"), (), ("id",)).collect()}
    assert got == {"1": None, "2": 2, "3": 3}
    json_side = json_records(spark, ['{"v": 5}', '{"v": 1e-7}', '{"v": "5"}', '{"v": 0.0000001000000000000001}'])
    assert {r["key"]: r["other_id"] for r in board.lookup(json_side, ours, Match("v", "v", "number"), (), ("id",)).collect()} == {"k0": 2, "k1": 1, "k2": None, "k3": None}


def test_mean_is_rounded_once(spark):
    r = random.Random(7)
    rows = [(k % 40, Decimal(r.randint(-(10**12), 10**12)).scaleb(-r.randint(0, 9))) for k in range(400)]
    own = Records.from_table(spark.createDataFrame([(i, g, x) for i, (g, x) in enumerate(rows)], "id long, g long, v decimal(30,12)"), ["id"])
    out = {r["g"]: r["m"] for r in board.own_rows(own, Board("g", measures=(("m", "avg", "v"),))).collect()}
    for g in range(40):
        mine = [x for k, x in rows if k == g]
        exact = Fraction(sum(map(Fraction, mine), Fraction(0)), len(mine)) * 10**6
        half_up = math.floor(abs(exact) + Fraction(1, 2)) * (1 if exact >= 0 else -1)
        assert out[g] == Decimal(half_up).scaleb(-6)


def test_order_of_nested_values(spark):
    docs = ['{"v": [10, 1]}', '{"v": [2, 1]}', '{"v": [2, "a"]}', '{"v": []}', '{"v": null}', '{"v": "z"}', '{"v": 3}', '{"v": true}', '{"v": [9]}', '{"v": {"bb": 1}}', '{"v": {"a": 2}}', '{"v": {"a": 1, "b": 0}}', "{}", '{"v": [[]]}', '{"v": 12345678901234567890}', '{"v": 12345678901234567891}', '{"v": -5}', '{"v": [-5.5]}', '{"v": [-5.25]}']
    own = json_records(spark, docs)
    order = [r["key"] for r in pick.run(own, Pick(sort="v")).collect()]
    want = ["k3", "k4", "k5", "k16", "k6", "k14", "k15", "k7", "k17", "k18", "k8", "k13", "k2", "k1", "k0", "k10", "k9", "k11", "k12"]
    assert order == want
    assert [r["key"] for r in pick.run(own, Pick(sort="v", direction="desc")).collect()] == want[-2::-1] + ["k12"]
    assert order_bytes(Decimal("1.50")) == order_bytes(Decimal("1.5")) and order_bytes(Decimal("-2")) < order_bytes(Decimal("-1.9")) < order_bytes(Decimal(0)) < order_bytes(Decimal("1e-9")) < order_bytes(Decimal("10")) < order_bytes(Decimal("10.01"))


def test_times_order_by_moment(spark):
    docs = ['{"t": "2024-01-01T00:00:00+05:00", "g": 1}', '{"t": "2023-12-31T23:00:00Z", "g": 1}', '{"t": "soon", "g": 1}', '{"t": null, "g": 1}', "{}", '{"t": "2023-12-31", "g": 2}']
    own = json_records(spark, docs)
    assert [r["key"] for r in pick.run(own, Pick(sort="t", sort_time=True)).collect()] == ["k3", "k5", "k0", "k1", "k2", "k4"]
    assert [r["key"] for r in pick.run(own, Pick(sort="t", sort_time=True, direction="desc")).collect()] == ["k1", "k0", "k5", "k3", "k2", "k4"]
    out = {r["g"]: r["last"] for r in board.own_rows(own, Board("g", times=(("last", "max", "t", "time"),))).collect()}
    assert out == {"1": "2023-12-31T23:00:00Z", "2": "2023-12-31", None: None}
    with pytest.raises(Refusal):
        validate(Pick(sort_time=True), own)


def test_stored_filters(spark):
    own = json_records(spark, ['{"t": "2024-01-10T12:00:00Z", "n": 1}', '{"t": "soon", "n": 2}', '{"n": 3}', '{"t": "2024-01-10", "n": 4}'])
    kinds = {"t": "time", "n": "number"}

    def keys(question, zone="UTC"):
        return [r["key"] for r in own.frame.where(conditions.holds(conditions.from_filter(question, kinds, zone), own)[0]).orderBy("key").collect()]

    after = {"field": "t", "op": "after", "value": "2024-01-10T00:00Z"}
    assert keys({"filter": {"version": 1, "join": "all", "items": [after]}}) == ["k0"]
    assert keys({"conditions": [after, {"field": "n", "op": "ge", "value": 2}], "logic": "one"}) == ["k0", "k3"]
    assert keys({"conditions": [{"field": "t", "op": "on", "value": "2024-01-10"}]}) == ["k0", "k3"]
    assert keys({"conditions": [{"field": "t", "op": "on", "value": "2024-01-10"}]}, "Asia/Kolkata") == ["k0", "k3"]
    assert keys({"conditions": [{"field": "t", "part": "time_of_day", "op": "between", "value": "11:00", "value2": "13:00"}]}) == ["k0"]
    assert keys({"conditions": [{"field": "n", "op": "between", "value": 3, "value2": 2}]}) == ["k1", "k2"]
    assert keys({"filter": {"version": 1, "join": "any", "items": [{"items": []}, {"join": "all", "items": [{"field": "n", "op": "eq", "value": 4}]}]}}) == ["k3"]
    assert conditions.from_filter({}, kinds) is None and conditions.from_filter({"filter": {"version": 1, "items": []}}, kinds) is None
    deep = {"field": "n", "op": "eq", "value": 1}
    for _ in range(70):
        deep = {"items": [deep]}
    bad = [
        {"filter": {"version": 2, "items": []}}, {"filter": {"version": True, "items": []}}, {"filter": {"version": 1, "items": [], "x": 1}}, {"filter": {"version": 1, "items": {}}}, {"filter": {"version": 1, "items": []}, "logic": "all"},
        {"conditions": [after, after]}, {"conditions": [after], "logic": "xor"}, {"conditions": [{"field": "z", "op": "eq", "value": 1}]}, {"conditions": [{"field": "n", "op": "eq"}]}, {"conditions": [{"field": "n", "op": "present", "value": 1}]},
        {"conditions": [{"field": "n", "op": "from", "part": "time_of_day", "value": "10:00"}]}, {"filter": {"version": 1, "items": [deep]}}, {"filter": {"version": 1, "items": [{"items": [], "version": 1}]}},
    ]
    for question in bad:
        with pytest.raises(Refusal):
            conditions.from_filter(question, kinds)
    for card in ({"field": "t", "op": "after", "value": "2024-01-10"}, {"field": "t", "op": "on", "value": "2024-02-30"}, {"field": "t", "op": "eq", "value": 1}, {"field": "n", "op": "eq", "value": 2**60 + 1}, {"field": "n", "op": "eq", "value": 10**400}):
        with pytest.raises(Refusal):
            conditions.holds(conditions.from_filter({"conditions": [card]}, kinds), own)
    with pytest.raises(Refusal, match="skips"):
        conditions.holds(conditions.from_filter({"conditions": [{"field": "t", "op": "after", "value": "2026-03-08T02:30"}]}, kinds, "America/Denver"), own)


def test_folded_keys(spark):
    assert copied_from("a b c") == ["a b_c", "a_b c", "a_b_c"] and copied_from("a_b c") == [] and copied_from("ab") == []
    with pytest.raises(Refusal):
        copied_from("a_b_c_d_e_f_g_h")
    own = json_records(spark, ['{"a b": 1}', '{"a_b": 2, "a b": 1}', '{"a_b": null, "a b": 3}', "{}"], folded=True)
    got = own.frame.orderBy("key").select(compile_value("number($.a_b)", own).column, compile_value("string($._noun_type)", own).column).collect()
    assert [tuple(r) for r in got] == [(1.0, "c"), (2.0, "c"), (None, "c"), (None, "c")]
    with pytest.raises(Refusal):
        compile_value("length($)", own)


def test_axis(spark):
    rows = spark.createDataFrame([("2026-03-08T01:00:00", 1.0), ("2026-03-08T04:00:00", 2.0)], "bucket string, value double")
    assert [tuple(r) for r in axis.fill(rows, "hour", "America/Denver").collect()] == [("2026-03-08T01:00:00", 1.0), ("2026-03-08T03:00:00", None), ("2026-03-08T04:00:00", 2.0)]
    months = spark.createDataFrame([("2025-11-01T00:00:00Z", 1.0), ("2026-02-01T00:00:00Z", 2.0)], "bucket string, value double")
    assert [r["bucket"][:7] for r in axis.fill(months, "month").collect()] == ["2025-11", "2025-12", "2026-01", "2026-02"]
    half = spark.createDataFrame([("2026-10-04T01:00:00", 1.0), ("2026-10-04T03:00:00", 2.0)], "bucket string, value double")
    assert [r["bucket"][11:13] for r in axis.fill(half, "hour", "Australia/Lord_Howe").collect()] == ["01", "02", "03"]
    with pytest.raises(Refusal):
        axis.fill(months, "hour", low="1900-01-01T00:00:00Z")
    assert axis.fill(months.where("false"), "day").count() == 0


def test_pages(spark):
    own = Records.from_table(spark.createDataFrame([(k,) for k in range(120)], "id long"), ["id"])
    rows = pick.run(own, Pick(sort="id", direction="desc"))
    assert [r["key"] for r in pick.page(rows, 3).collect()] == [str(k) for k in range(19, -1, -1)] and pick.page(rows, 4).count() == 0
    with pytest.raises(Refusal):
        pick.page(rows, 0)


def test_related_counts_after_aggregation(spark):
    p = Records.from_table(spark.createDataFrame([(1, 10.0, "a"), (2, 20.0, "a"), (3, None, "b"), (4, 30.0, "b"), (5, 30.0, "c")], "id long, k double, g string"), ["id"])
    c = Records.from_table(spark.createDataFrame([(1, 10.0, 1.0), (2, 10.0, 2.0), (3, 20.0, 4.0), (4, None, 9.0), (5, 99.0, 9.0)], "id long, k double, v double"), ["id"])
    rows = board.related(p, c, Match("k", "k", "number"), Board("g", counts=(("big", "$.v >= 2"),), measures=(("mean", "avg", "v"), ("most", "max", "v"))))
    got = {r["g"]: (r["rows"], r["big"], float(r["big_pct"]), r["mean"], r["most"]) for r in rows.collect()}
    assert got == {"a": (3, 2, 66.7, Decimal("2.333333"), 4), "b": (0, 0, 0.0, None, None), "c": (0, 0, 0.0, None, None)}


def test_store(spark, tmp_path):
    rows = spark.createDataFrame([("a", "1", '{"n": 1}'), ("a", "2", None), ("b", "1", "{}")], "collection string, key string, data string")
    store.save(rows, str(tmp_path / "s"))
    assert {tuple(r) for r in store.load(spark, str(tmp_path / "s"), "a").select("key", "data").collect()} == {("1", '{"n": 1}'), ("2", None)}
    want = {r["collection"]: (r["rows"], r["digest"]) for r in store.digest(rows).collect()}
    store.verify(store.load(spark, str(tmp_path / "s")).repartition(3), want)
    with pytest.raises(Refusal):
        store.verify(rows.where("key = '1'"), want)
    with pytest.raises(Refusal):
        store.save(rows.union(rows), str(tmp_path / "t"))


def test_lists_are_equal_by_value(spark):
    own = json_records(spark, ['{"a": [1, {"x": 100}], "b": [1.0, {"x": 1e2}]}', '{"a": [1, 2], "b": [2, 1]}', '{"a": [], "b": {}}', '{"a": {"p": 1, "q": 2}, "b": {"q": 2, "p": 1.0}}', '{"a": [1], "b": 1}'])
    got = own.frame.orderBy("key").select(compile_value("$.a == $.b", own).column, compile_value("$.a != $.b", own).column).collect()
    assert [tuple(r) for r in got] == [(True, False), (False, True), (False, True), (True, False), (False, True)]
