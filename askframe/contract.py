"""The library's queries over the given tables, each with the SQL that states its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import axis, board, discover, pick, probes
from .operators.board import Board, Match
from .operators.conditions import Box, Condition, from_filter, holds
from .plans.compiler import compile_condition, compile_value
from .plans.legality import Pick
from .sources import store
from .sources.records import Records, Series

NOW_MS = 1_709_294_400_000.0  # 2024-03-01T12:00:00Z


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark, sf_dir) -> Records:
    return Records.from_table(_read(spark, sf_dir, "events"), ["event_id"], Series("ts", "user_id"))


def orders(spark, sf_dir) -> Records:
    return Records.from_table(_read(spark, sf_dir, "orders"), ["o_orderkey"])


def customers(spark, sf_dir) -> Records:
    return Records.from_table(_read(spark, sf_dir, "customer"), ["c_custkey"])


def items(spark, sf_dir) -> Records:
    return Records.from_table(_read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def props(spark, sf_dir) -> Records:
    """Events as JSON documents: their properties, with type, value and user."""
    rows = _read(spark, sf_dir, "events")
    return Records.from_json(rows.select(F.lit("events").alias("collection"), F.col("event_id").cast("string").alias("key"), F.to_json(F.struct(F.col("event_type").alias("type"), "value", F.from_json("props", "k bigint").alias("props"), F.array("user_id", F.col("value")).alias("pair"))).alias("data")), "events")


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_SUM = "CAST(round(sum(CAST({} AS DECIMAL(18,6))), 6) AS DECIMAL(38,6))"
_AVG = "CAST(round(CAST(sum(CAST({0} AS DECIMAL(18,6))) AS DECIMAL(38,14)) / count({0}), 6) AS DECIMAL(38,6))"


@_query("""SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderkey, o_totalprice, o_orderpriority FROM orders
WHERE o_totalprice > 200000 AND o_orderstatus <> 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def rows_filter_sort_cap(spark, sf_dir):
    return pick.run(orders(spark, sf_dir), Pick(columns=("o_orderkey", "o_totalprice", "o_orderpriority"), filter='$.o_totalprice > 200000 and $.o_orderstatus != "F"', sort="o_totalprice", direction="desc", cap=50))


@_query("""SELECT l_orderkey || ':' || l_linenumber AS key, CAST(l_quantity AS DOUBLE) * l_extendedprice * (1 - l_discount) AS net,
CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS band, coalesce(l_returnflag, 'none') AS flag FROM lineitem WHERE l_quantity >= 45""")
def rows_computed_if_coalesce(spark, sf_dir):
    return pick.run(items(spark, sf_dir), Pick(computed=(("net", "$.l_quantity * $.l_extendedprice * (1 - $.l_discount)"), ("band", 'if($.l_discount > 0.05, "high", "low")'), ("flag", 'coalesce($.l_returnflag, "none")')), filter="$.l_quantity >= 45"))


@_query("""SELECT CAST(event_id AS VARCHAR) AS key, coalesce(value, 0) + event_id % 4 * 25 AS load_score FROM events
WHERE coalesce(value, 0) + event_id % 4 * 25 > 60 ORDER BY load_score DESC, event_id LIMIT 50""")
def load_score(spark, sf_dir):
    """The derive, filter, sort, cap question of the reference's benchmark."""
    return pick.run(events(spark, sf_dir), Pick(computed=(("load_score", "coalesce($.value, 0) + $.event_id % 4 * 25"),), filter="coalesce($.value, 0) + $.event_id % 4 * 25 > 60", sort="load_score", direction="desc", cap=50))


def _box(join: str) -> Box:
    return Box(join, (Condition("o_totalprice", "gt", "number", (150000,)), Condition("o_orderstatus", "in", "text", ("O", "P")), Condition("o_orderpriority", "eq", "text", ("1-URGENT",))))


@_query("""WITH c AS (SELECT o_orderkey, (o_totalprice > 150000)::INT + (o_orderstatus IN ('O','P'))::INT + (o_orderpriority = '1-URGENT')::INT AS n FROM orders)
SELECT 'all' AS joined, count(*) AS n FROM c WHERE n = 3 UNION ALL SELECT 'any', count(*) FROM c WHERE n > 0
UNION ALL SELECT 'one', count(*) FROM c WHERE n = 1 UNION ALL SELECT 'allnone', count(*) FROM c WHERE n IN (0, 3)""")
def conditions_all_any_one_allnone(spark, sf_dir):
    own = orders(spark, sf_dir)
    totals = own.frame.agg(*(F.coalesce(F.sum(F.when(holds(_box(j), own)[0], 1)), F.lit(0)).alias(j) for j in ("all", "any", "one", "allnone")))
    return totals.select(F.explode(F.array(*(F.struct(F.lit(j).alias("joined"), F.col(j).alias("n")) for j in totals.columns))).alias("r")).select("r.*")


@_query("""SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING','MACHINERY') AND c_acctbal BETWEEN 100 AND 5000 AND c_name IS NOT NULL AND c_nationkey <> 7""")
def cond_in_between_present(spark, sf_dir):
    own = customers(spark, sf_dir)
    box = Box("all", (Condition("c_mktsegment", "in", "text", ("BUILDING", "MACHINERY")), Condition("c_acctbal", "between", "number", (5000, 100)), Condition("c_name", "present"), Condition("c_nationkey", "ne", "number", (7,))))
    return own.frame.where(holds(box, own)[0]).select("c_custkey")


@_query("""SELECT event_id FROM events WHERE CAST(timezone('America/Denver', timezone('UTC', ts)) AS DATE) = DATE '2024-01-10'
AND (hour(timezone('America/Denver', timezone('UTC', ts))) >= 22 OR hour(timezone('America/Denver', timezone('UTC', ts))) < 6)""")
def cond_time_on_clock(spark, sf_dir):
    own = events(spark, sf_dir)
    box = Box("all", (Condition("ts", "on", "time", ("2024-01-10",), "America/Denver"), Condition("ts", "clock", "time", ("22:00", "06:00"), "America/Denver")))
    return own.frame.where(holds(box, own)[0]).select("event_id")


@_query("SELECT count(*) AS value FROM lineitem WHERE l_returnflag = 'R'")
def scalar_count(spark, sf_dir):
    return pick.run(items(spark, sf_dir), Pick(aggregate="count", filter='$.l_returnflag == "R"'))


@_query(f"SELECT {_SUM.format('l_extendedprice')} AS value FROM lineitem")
def scalar_sum(spark, sf_dir):
    return pick.run(items(spark, sf_dir), Pick(aggregate="sum", field="l_extendedprice")).select(F.col("value").cast("decimal(38,6)"))


@_query(f"SELECT {_AVG.format('l_discount')} AS value FROM lineitem")
def scalar_avg(spark, sf_dir):
    return pick.run(items(spark, sf_dir), Pick(aggregate="avg", field="l_discount"))


@_query("SELECT CAST(min(l_extendedprice) AS DECIMAL(18,6)) AS value FROM lineitem")
def scalar_min(spark, sf_dir):
    return pick.run(items(spark, sf_dir), Pick(aggregate="min", field="l_extendedprice")).select(F.col("value").cast("decimal(18,6)"))


@_query("SELECT CAST(max(l_extendedprice) AS DECIMAL(18,6)) AS value FROM lineitem")
def scalar_max(spark, sf_dir):
    return pick.run(items(spark, sf_dir), Pick(aggregate="max", field="l_extendedprice")).select(F.col("value").cast("decimal(18,6)"))


def _bucket(grain: str, where: str = "", zone: str | None = None) -> str:
    at = f"timezone('{zone}', timezone('UTC', ts))" if zone else "ts"
    mark = "" if zone else "Z"
    return f"SELECT strftime(date_trunc('{grain}', {at}), '%Y-%m-%dT%H:%M:%S{mark}') AS bucket, {_SUM.format('value')} AS value FROM events {where} GROUP BY 1"


def _buckets(spark, sf_dir, **slots) -> DataFrame:
    return pick.run(events(spark, sf_dir), Pick(aggregate="sum", field="value", **slots)).select("bucket", F.col("value").cast("decimal(38,6)").alias("value"))


@_query(_bucket("hour"))
def bucket_hour(spark, sf_dir):
    return _buckets(spark, sf_dir, bucket="hour")


@_query(_bucket("day"))
def bucket_day(spark, sf_dir):
    return _buckets(spark, sf_dir, bucket="day")


@_query(_bucket("week", "WHERE value > 20"))
def bucket_week(spark, sf_dir):
    return _buckets(spark, sf_dir, bucket="week", filter="$.value > 20")


@_query(_bucket("month"))
def bucket_month(spark, sf_dir):
    return _buckets(spark, sf_dir, bucket="month", bucket_field="ts")


@_query(_bucket("day", zone="America/Denver"))
def bucket_zone_denver(spark, sf_dir):
    return _buckets(spark, sf_dir, bucket="day", bucket_zone="America/Denver")


@_query("""SELECT CAST(event_id AS VARCHAR) AS key, CAST(round(CAST(sum(CAST(value AS DECIMAL(18,6))) OVER w AS DECIMAL(38,14)) / nullif(count(value) OVER w, 0), 6) AS DECIMAL(38,6)) AS rolling
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def rolling_avg3(spark, sf_dir):
    return pick.run(events(spark, sf_dir), Pick(rolling="value"))


@_query("""WITH s AS (SELECT event_id, event_type, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT CAST(event_id AS VARCHAR) AS key, event_type FROM s WHERE n = 1 OR event_type IS DISTINCT FROM before""")
def keep_changed(spark, sf_dir):
    own = Records.from_table(_read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), ["event_id"], Series("ts", "user_id"))
    return pick.run(own, Pick(columns=("event_type",), changed=True))


@_query(f"""SELECT o_orderpriority, count(*) AS rows, CAST(sum((o_totalprice > 200000)::INT) AS BIGINT) AS large, CAST(round(sum((o_totalprice > 200000)::INT) * 100 / CAST(count(*) AS DECIMAL(18,4)), 1) AS DECIMAL(38,1)) AS large_pct,
strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%SZ') AS latest, {_AVG.format('o_totalprice')} AS mean FROM orders GROUP BY 1""")
def board_own_rows(spark, sf_dir):
    return board.own_rows(orders(spark, sf_dir), Board("o_orderpriority", counts=(("large", "$.o_totalprice > 200000"),), times=(("latest", "max", "o_orderdate"),), measures=(("mean", "avg", "o_totalprice"),), sort="large", direction="desc"))


@_query(f"""SELECT c_mktsegment, count(o_orderkey) AS rows, CAST(sum(coalesce((o_orderstatus = 'F')::INT, 0)) AS BIGINT) AS finished, {_SUM.format('o_totalprice')} AS total
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def board_related(spark, sf_dir):
    out = board.related(customers(spark, sf_dir), orders(spark, sf_dir), Match("c_custkey", "o_custkey", "number"), Board("c_mktsegment", counts=(("finished", '$.o_orderstatus == "F"'),), shares=False, measures=(("total", "sum", "o_totalprice"),)))
    return out.withColumn("total", F.col("total").cast("decimal(38,6)"))


@_query("""SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderdate AS d, o_totalprice, c_name AS other_c_name, c_mktsegment AS other_c_mktsegment FROM
(SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS o_orderdate, o_totalprice, c_name, c_mktsegment FROM orders LEFT JOIN customer ON c_custkey = o_custkey) ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
def lookup_matched(spark, sf_dir):
    return board.lookup(orders(spark, sf_dir), customers(spark, sf_dir), Match("o_custkey", "c_custkey", "number"), ("o_orderdate", "o_totalprice"), ("c_name", "c_mktsegment"), sort="o_totalprice", direction="desc", cap=100).withColumnRenamed("o_orderdate", "d")


@_query("""WITH n AS (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1),
u AS (SELECT o_orderkey, count(c_custkey) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT (SELECT count(*) FROM n) AS parents, (SELECT count(*) FROM n WHERE n = 0) AS parents_none, (SELECT min(n) FROM n) AS least, (SELECT max(n) FROM n) AS most,
(SELECT count(*) FROM u) AS counted, (SELECT count(*) FROM u WHERE n = 0) AS counted_none, (SELECT count(*) FROM u WHERE n > 1) AS counted_twice, (SELECT max(n) FROM u) AS most_parents""")
def profile_related(spark, sf_dir):
    return board.profile_related(customers(spark, sf_dir), orders(spark, sf_dir), Match("c_custkey", "o_custkey", "number"))


@_query("""WITH n AS (SELECT o_orderkey, count(c_custkey) AS n FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT count(*) AS rows, count(*) FILTER (n = 0) AS rows_none, min(n) AS least, max(n) AS most, count(*) FILTER (n > 1) AS repeated, (SELECT count(*) FROM customer) AS others FROM n""")
def profile_lookup(spark, sf_dir):
    return board.profile_lookup(orders(spark, sf_dir), customers(spark, sf_dir), Match("o_custkey", "c_custkey", "number"))


@_query(f"SELECT l_returnflag, count(*) AS rows, {_SUM.format('l_quantity')} AS quantity FROM lineitem GROUP BY 1")
def category_summary(spark, sf_dir):
    out = board.own_rows(items(spark, sf_dir), Board("l_returnflag", measures=(("quantity", "sum", "l_quantity"),)))
    return out.withColumn("quantity", F.col("quantity").cast("decimal(38,6)"))


@_query("""SELECT CAST(event_id AS VARCHAR) AS key, CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) AS k FROM events
WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50 AND event_type <> 'view'""")
def json_props_filter(spark, sf_dir):
    return pick.run(props(spark, sf_dir), Pick(columns=("props.k",), filter='$.props.k >= 50 and $.type != "view"'))


@_query(f"""SELECT event_type, count(*) AS rows, CAST(sum((CAST(json_extract(props, '$.k') AS BIGINT) > 50)::INT) AS BIGINT) AS many, {_SUM.format("CAST(json_extract(props, '$.k') AS BIGINT)")} AS total FROM events GROUP BY 1""")
def json_board(spark, sf_dir):
    out = board.own_rows(props(spark, sf_dir), Board("type", counts=(("many", "$.props.k > 50"),), shares=False, measures=(("total", "sum", "props.k"),)))
    return out.select(F.get_json_object(F.concat(F.lit('{"v":'), "type", F.lit("}")), "$.v").alias("event_type"), "rows", "many", F.col("total").cast("decimal(38,6)").alias("total"))


@_query("""SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) + 1 AS grown, CAST(user_id AS DOUBLE) AS first, value AS last, CAST(NULL AS DOUBLE) AS gone,
CAST(2 AS DOUBLE) AS n, upper(event_type) || '-' AS shout FROM events""")
def json_paths(spark, sf_dir):
    own = props(spark, sf_dir)
    out = {"grown": "$.props.k + 1", "first": "number($.pair[0])", "last": "number($.pair[-1])", "gone": "number($.pair[7])", "n": "length($.pair)", "shout": 'concat(upper($["type"]), "-")'}
    return own.frame.select(F.col("key").cast("bigint").alias("event_id"), *(compile_value(e, own).column.alias(k) for k, e in out.items()))


@_query("""SELECT * FROM (SELECT 'event_id' AS field, 'number' AS kind, count(event_id) AS present, count(DISTINCT event_id) AS different FROM events
UNION ALL SELECT 'event_type', 'text', count(event_type), count(DISTINCT event_type) FROM events
UNION ALL SELECT 'props', 'text', count(props), count(DISTINCT props) FROM events
UNION ALL SELECT 'ts', 'time', count(ts), count(DISTINCT strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) FROM events
UNION ALL SELECT 'user_id', 'number', count(user_id), count(DISTINCT user_id) FROM events
UNION ALL SELECT 'value', 'number', count(value), count(DISTINCT value) FROM events)""")
def field_facts(spark, sf_dir):
    return discover.facts(events(spark, sf_dir)).select("field", "kind", "present", "different")


@_query("SELECT unnest(['pair', 'props', 'type', 'value']) AS field")
def field_keys(spark, sf_dir):
    return discover.keys(props(spark, sf_dir))


@_query("""SELECT CAST(event_id AS VARCHAR) AS key, CAST(round(100 * 0) AS DOUBLE) + floor(value) AS down, ceil(value) AS up, abs(-value) AS size,
sign(value) * trunc(abs(value * 10) + 0.5) / 10 AS near, value / nullif(event_id % 3, 0) AS part, event_id % 7.0 AS rest, greatest(value, 50) AS most, (value + event_id) / 2 AS mean FROM events""")
def expr_numeric(spark, sf_dir):
    return pick.run(events(spark, sf_dir), Pick(computed=(("down", "floor($.value)"), ("up", "ceil($.value)"), ("size", "abs(-$.value)"), ("near", "round($.value, 1)"), ("part", "$.value / ($.event_id % 3)"), ("rest", "$.event_id % 7"), ("most", "max($.value, 50)"), ("mean", "avg($.value, $.event_id)"))))


@_query("""SELECT CAST(c_custkey AS VARCHAR) AS key, upper(c_mktsegment) || '/' || CAST(c_custkey AS VARCHAR) AS label, lower(c_name) AS small, CAST(length(c_name) AS DOUBLE) AS n,
contains(c_name, '7') AS has, CAST(c_custkey AS DOUBLE) AS back, c_mktsegment < 'C' AS early FROM customer""")
def expr_string(spark, sf_dir):
    return pick.run(customers(spark, sf_dir), Pick(computed=(("label", 'concat(upper($.c_mktsegment), "/", $.c_custkey)'), ("small", "lower($.c_name)"), ("n", "length($.c_name)"), ("has", 'contains($.c_name, "7")'), ("back", "number(string($.c_custkey))"), ("early", '$.c_mktsegment < "C"'))))


@_query("""SELECT CAST(event_id AS VARCHAR) AS key, date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-03-01 12:00:00') / 86400.0::DOUBLE AS age,
strftime(date_trunc('second', ts) + INTERVAL 36 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS later, '2024-03-01' AS today,
CAST(hour(timezone('America/Denver', timezone('UTC', ts))) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT) AS DOUBLE) AS clock FROM events""")
def expr_date(spark, sf_dir):
    return pick.run(events(spark, sf_dir), Pick(computed=(("age", "days_between($.ts, now())"), ("later", "date_add($.ts, 1.5)"), ("today", "today()"), ("clock", 'time_of_day($.ts, "America/Denver")'))), now_ms=NOW_MS)


@_query("SELECT 'nested' AS probe, 'pair' AS field, min(CAST(event_id AS VARCHAR)) AS key FROM events")
def probe_nested(spark, sf_dir):
    return probes.probe(props(spark, sf_dir), "$.pair == 1 and $.props.k > 3")


@_query("SELECT CAST(event_id AS VARCHAR) AS key FROM events WHERE event_type = 'click' OR value > 90")
def predicate_strict(spark, sf_dir):
    own = events(spark, sf_dir)
    return own.frame.where(compile_condition('$.event_type == "click" or $.value > 90', own, strict=True)).select("key")


def order_docs(spark, sf_dir, owner: str | None = None, folded: bool = False) -> Records:
    """Orders as JSON documents among others: times with and without a zone's offset, unreadable and null ones, yes/no, lists,
    groups and long numbers."""
    rows = _read(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("timestamp"))
    k, later = F.col("o_orderkey"), F.col("d") + F.expr("INTERVAL '5:30' HOUR TO MINUTE")
    at = F.when(k % 2 == 0, F.date_format("d", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.concat(F.date_format(later, "yyyy-MM-dd HH:mm:ss"), F.lit("+0530")))
    body = F.struct(
        F.when(k % 11 == 0, None).when(k % 7 == 0, "soon").otherwise(at).alias("at"),
        F.concat(F.lit(" "), F.date_format("d", "yyyy-MM-dd'T'HH:mm"), F.lit("+01:30 ")).alias("short"),
        F.date_format("d", "yyyy-MM-dd").alias("day"),
        (F.col("o_orderpriority") == "1-URGENT").alias("urgent"),
        F.array(k % 5, k % 3).alias("pair"),
        F.struct((k % 4).alias("n"), F.array(F.col("o_orderstatus")).alias("in")).alias("group"),
        F.col("o_orderpriority").alias("order name"),
    )
    text = F.to_json(body, {"ignoreNullFields": "false"})
    long = F.concat(F.lit(', "long": '), k.cast("string"), F.lit(".000000000000000001"), F.when(k % 97 == 0, ', "odd": 12345678901234567').otherwise(', "odd": 1'), F.lit("}"))
    data = F.concat(F.regexp_replace(text, r"\}\z", ""), long)
    own = rows.select(F.lit("orders").alias("collection"), F.col("o_orderstatus").alias("owner"), k.cast("string").alias("key"), data.alias("data"))
    others = own.where("owner = 'F'").withColumns({"collection": F.lit("others"), "key": F.concat(F.lit("x"), "key")})
    return Records.from_json(own.unionByName(others), "orders", ("owner", owner) if owner else None, folded=folded)


_KEY = "CAST(o_orderkey AS VARCHAR)"
_READ = "(o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0)"


@_query(f"SELECT {_KEY} AS key, '\"' || strftime(o_orderdate, '%Y-%m-%d') || '\"' AS day FROM orders WHERE o_orderstatus = 'F'")
def scan_owner(spark, sf_dir):
    return pick.run(order_docs(spark, sf_dir, "F"), Pick(columns=("day",)))


@_query(f"SELECT {_KEY} AS key, o_orderpriority = '1-URGENT' AS urgent FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderkey % 3 = 0")
def cond_yes_no(spark, sf_dir):
    own = order_docs(spark, sf_dir)
    box = Box("all", (Condition("urgent", "no", "yesno"), Condition("pair", "present", "mixed")))
    return own.frame.where(holds(box, own)[0] & compile_condition("$.pair[1] == 0", own)).select("key", own.at(("urgent",)).flag.alias("urgent"))


@_query(f"""SELECT 'after' AS op, count(*) AS n FROM orders WHERE {_READ} AND o_orderdate > TIMESTAMP '1995-06-01 12:00:00'
UNION ALL SELECT 'before', count(*) FROM orders WHERE {_READ} AND o_orderdate < TIMESTAMP '1995-06-01 18:00:00'
UNION ALL SELECT 'between', count(*) FROM orders WHERE {_READ} AND o_orderdate BETWEEN TIMESTAMP '1994-01-01 07:00:00' AND TIMESTAMP '1996-01-01 00:00:00'
UNION ALL SELECT 'date', count(*) FROM orders WHERE CAST(o_orderdate AS DATE) > DATE '1995-06-01'""")
def cond_time_after_before_between(spark, sf_dir):
    own = order_docs(spark, sf_dir)
    tests = {
        "after": Condition("at", "after", "time", ("1995-06-01T12:00Z",)),
        "before": Condition("at", "before", "time", ("1995-06-01T12:00",), "America/Denver"),
        "between": Condition("at", "between", "time", ("1996-01-01T00:00:00Z", "1994-01-01T00:00"), "America/Denver"),
        "date": Condition("day", "after", "date", ("1995-06-01",)),
    }
    sums = own.frame.agg(*(F.coalesce(F.sum(F.when(holds(c, own)[0], 1)), F.lit(0)).alias(k) for k, c in tests.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(k).alias("op"), F.col(k).alias("n")) for k in tests))).alias("r")).select("r.*")


@_query(f"""WITH c AS (SELECT {_KEY} AS key, o_orderpriority = '1-URGENT' AS u, o_orderkey % 4 = 1 AS n, CASE WHEN {_READ} THEN o_orderdate > TIMESTAMP '1995-06-01 12:00:00' END AS t FROM orders)
SELECT key FROM c WHERE t IS NOT NULL AND (t::INT + (u OR n)::INT) = 1""")
def filter_tree(spark, sf_dir):
    """A stored tree: exactly one of a time, which holds and fails nowhere where it can't be read, and a group."""
    own = order_docs(spark, sf_dir)
    tree = {"version": 1, "join": "one", "items": [{"field": "at", "op": "after", "value": "1995-06-01T12:00:00Z"}, {"join": "any", "items": [{"field": "urgent", "op": "yes"}, {"field": "group.n", "op": "eq", "value": 1}, {"items": []}]}]}
    box = from_filter({"filter": tree}, {"at": "time", "urgent": "yesno", "group.n": "number"})
    return own.frame.where(holds(box, own)[0]).select("key")


@_query(f"SELECT {_KEY} AS key FROM orders ORDER BY CASE WHEN o_orderkey % 11 = 0 THEN 0 WHEN o_orderkey % 7 = 0 THEN 2 ELSE 1 END, CASE WHEN {_READ} THEN o_orderdate END, key LIMIT 2000")
def sort_time_field(spark, sf_dir):
    return pick.run(order_docs(spark, sf_dir), Pick(sort="at", sort_time=True, cap=2000)).select("key")


@_query(f"SELECT {_KEY} AS key FROM orders ORDER BY o_orderkey % 5 DESC, o_orderkey % 3 DESC, key LIMIT 777")
def sort_lists(spark, sf_dir):
    return pick.run(order_docs(spark, sf_dir), Pick(sort="pair", direction="desc", cap=777)).select("key")


@_query(f"SELECT {_KEY} AS key FROM orders ORDER BY o_orderkey % 4, o_orderstatus, key LIMIT 777")
def sort_groups(spark, sf_dir):
    """Groups order by their keys, shorter first: n before in."""
    return pick.run(order_docs(spark, sf_dir), Pick(sort="group", cap=777)).select("key")


@_query(f"""SELECT o_orderpriority AS p, count(*) AS rows, strftime(max(o_orderdate) FILTER ({_READ}), '%Y-%m-%dT%H:%M:%SZ') AS latest, strftime(min(o_orderdate) FILTER ({_READ}), '%Y-%m-%dT%H:%M:%SZ') AS earliest,
strftime(max(o_orderdate), '%Y-%m-%d') AS day FROM orders GROUP BY 1""")
def board_latest_by_instant(spark, sf_dir):
    out = board.own_rows(order_docs(spark, sf_dir), Board('["order name"]', times=(("latest", "max", "at", "time"), ("earliest", "min", "at", "time"), ("day", "max", "day"))))
    return out.select(F.regexp_replace("order name", '"', "").alias("p"), "rows", "latest", "earliest", "day")


@_query("SELECT CAST(sum(o_orderkey) + count(*) * CAST('0.000000000000000001' AS DECIMAL(38,18)) AS DECIMAL(38,6)) AS total, CAST(max(o_orderkey) + CAST('0.000000000000000001' AS DECIMAL(38,18)) AS VARCHAR) AS most FROM orders")
def exact_json_numbers(spark, sf_dir):
    own = order_docs(spark, sf_dir)
    total = pick.run(own, Pick(aggregate="sum", field="long")).select(F.col("value").cast("decimal(38,6)").alias("total"))
    return total.join(pick.run(own, Pick(aggregate="max", field="long")).select(F.col("value").cast("string").alias("most")), how="cross")


@_query(f"SELECT {_KEY} AS key, CAST(2 AS DOUBLE) AS pairs, CAST(CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 2 END AS DOUBLE) AS given, (epoch(date_trunc('minute', o_orderdate)) - 5400) / 86400.0::DOUBLE AS days FROM orders")
def expr_count_and_loose_times(spark, sf_dir):
    own = order_docs(spark, sf_dir)
    return pick.run(own, Pick(computed=(("pairs", "count($.pair)"), ("given", "count($.at, null, 1)"), ("days", 'days_between("1970-01-01", $.short)'))))


@_query(f"SELECT 'held' AS probe, 'odd' AS field, min({_KEY}) AS key FROM orders WHERE o_orderkey % 97 = 0 HAVING count(*) > 0")
def probe_held(spark, sf_dir):
    return probes.probe(order_docs(spark, sf_dir), "$.odd + 1 > 2")


@_query(f"SELECT {_KEY} AS key, o_orderpriority AS name, 'orders' AS noun FROM orders WHERE o_orderpriority < '3'")
def folded_keys(spark, sf_dir):
    own = order_docs(spark, sf_dir, folded=True)
    return pick.run(own, Pick(computed=(("name", "string($.order_name)"), ("noun", "string($._noun_type)")), filter='$.order_name < "3"'))


@_query(f"""WITH b AS (SELECT date_trunc('hour', timezone('America/Denver', timezone('UTC', ts))) AS t, {_SUM.format('value')} AS value FROM events WHERE event_id % 50 = 0 GROUP BY 1)
SELECT strftime(g.t, '%Y-%m-%dT%H:%M:%S') AS bucket, b.value FROM (SELECT unnest(generate_series((SELECT min(t) FROM b), (SELECT max(t) FROM b), INTERVAL 1 HOUR)) AS t) AS g LEFT JOIN b ON b.t = g.t""")
def axis_hours(spark, sf_dir):
    filled = axis.fill(_buckets(spark, sf_dir, bucket="hour", bucket_zone="America/Denver", filter="$.event_id % 50 == 0"), "hour", "America/Denver")
    return filled


@_query(f"SELECT {_KEY} AS key, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100")
def third_page(spark, sf_dir):
    return pick.page(pick.run(orders(spark, sf_dir), Pick(columns=("o_totalprice",), sort="o_totalprice", direction="desc")), 3)


@_query(f"""SELECT 'at' AS field, 'time' AS kind, count(*) FILTER (o_orderkey % 11 <> 0) AS present, count(*) FILTER (o_orderkey % 11 <> 0) AS filled, count(*) FILTER ({_READ}) AS readable,
strftime(min(o_orderdate) FILTER ({_READ}), '%Y-%m-%dT%H:%M:%SZ') AS least_time, strftime(max(o_orderdate) FILTER ({_READ}), '%Y-%m-%dT%H:%M:%SZ') AS most_time, NULL::VARCHAR AS most_day FROM orders
UNION ALL SELECT 'day', 'date', count(*), count(*), 0, NULL, NULL, strftime(max(o_orderdate), '%Y-%m-%d') FROM orders
UNION ALL SELECT 'urgent', 'yesno', count(*), 0, 0, NULL, NULL, NULL FROM orders
UNION ALL SELECT 'group.n', 'number', count(*), 0, 0, NULL, NULL, NULL FROM orders
UNION ALL SELECT 'group', 'mixed', count(*), 0, 0, NULL, NULL, NULL FROM orders
UNION ALL SELECT 'pair', 'mixed', count(*), 0, 0, NULL, NULL, NULL FROM orders""")
def field_facts_json(spark, sf_dir):
    found = discover.facts(order_docs(spark, sf_dir)).where(F.col("field").isin("at", "day", "urgent", "group.n", "group", "pair"))
    return found.select("field", "kind", "present", "filled", "readable", "least_time", "most_time", "most_day")


@_query("""SELECT o_orderstatus AS collection, count(*) AS rows, CAST(sum(CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || chr(10) || '{"p":"' || o_orderpriority || '"}'), 1, 15) AS HUGEINT)) AS VARCHAR) AS digest FROM orders GROUP BY 1""")
def record_digest(spark, sf_dir):
    rows = _read(spark, sf_dir, "orders")
    data = F.concat(F.lit('{"p":"'), "o_orderpriority", F.lit('"}'))
    return store.digest(rows.select(F.col("o_orderstatus").alias("collection"), F.col("o_orderkey").cast("string").alias("key"), data.alias("data")))
