"""The engine's operators as queries over the test tables, each with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions.types import ColumnDef
from .session import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def engine_on(spark: SparkSession, sf_dir: str) -> Engine:
    """An engine that sees the tables of a folder, for reading."""
    e = Engine(spark)
    for t in TABLES:
        e.register_parquet(t, f"{sf_dir}/{t}.parquet")
    return e


#: name -> (statement of the dialect, equivalent SQL if it differs)
SELECTS: dict[str, tuple[str, str | None]] = {
    "scan_star": ("SELECT * FROM region", None),
    "project_cols": ("SELECT c_custkey, c_name FROM customer", None),
    "project_star_mix": ("SELECT *, n_nationkey + 1 AS next_key FROM nation", "SELECT *, CAST(n_nationkey + 1 AS BIGINT) AS next_key FROM nation"),
    "project_alias_arith": ("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_orderkey < 500", None),
    "project_wide": ("SELECT l_orderkey + 1 AS a, l_partkey - 2 AS b, l_suppkey * 3 AS c, l_linenumber / 2 AS d, l_quantity / 4 AS e, l_extendedprice + l_tax AS f, l_discount * 2 AS g, l_quantity - l_discount AS h FROM lineitem",
                     "SELECT l_orderkey + 1 AS a, l_partkey - 2 AS b, l_suppkey * 3 AS c, CAST(l_linenumber // 2 AS BIGINT) AS d, l_quantity / 4 AS e, l_extendedprice + l_tax AS f, l_discount * 2 AS g, l_quantity - l_discount AS h FROM lineitem"),
    "from_less": ("SELECT 1 + 2 AS three, 'x' AS x, true AS yes", "SELECT CAST(3 AS BIGINT) AS three, 'x' AS x, true AS yes"),
    "filter_eq_str": ("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'", None),
    "filter_range": ("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey >= 100 AND o_orderkey <= 900 AND o_totalprice != 0", None),
    "filter_or_not": ("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 300000) AND NOT (o_orderpriority = '5-LOW')", None),
    "filter_int_float": ("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size < p_retailprice AND p_size >= 10.5", None),
    "filter_qualified": ("SELECT o.o_orderkey FROM orders AS o WHERE o.o_custkey < 50", None),
    "filter_timestamp": ("SELECT event_id, ts FROM events WHERE ts >= '2024-01-10 00:00:00' AND ts < '2024-01-12T00:00:00Z'", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00'"),
    "point_lookup": ("SELECT * FROM orders WHERE o_orderkey = 77", None),
    "like": ("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget%'", None),
    "like_single": ("SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#_'", None),
    "not_like": ("SELECT p_partkey, p_brand FROM part WHERE p_brand NOT LIKE 'Brand#_'", None),
    "like_int": ("SELECT o_orderkey FROM orders WHERE o_orderkey LIKE '12%'", "SELECT o_orderkey FROM orders WHERE CAST(o_orderkey AS VARCHAR) LIKE '12%'"),
    "int_div": ("SELECT o_orderkey, o_orderkey / 7 AS q FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q FROM orders"),
    "div_zero_null": ("SELECT p_partkey, p_retailprice / (p_size - 10) AS q, p_partkey / (p_size - 10) AS i FROM part", "SELECT p_partkey, p_retailprice / NULLIF(p_size - 10, 0) AS q, CAST(trunc(p_partkey / NULLIF(p_size - 10, 0)) AS BIGINT) AS i FROM part"),
    "negative_literal": ("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal < -100.5", None),
    "agg_global": ("SELECT COUNT(*) AS n, SUM(l_quantity) AS qty, MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi, COUNT(l_tax) AS taxed FROM lineitem", None),
    "agg_avg": ("SELECT l_returnflag, AVG(l_linenumber) AS line FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, SUM(l_linenumber) / COUNT(*) AS line FROM lineitem GROUP BY l_returnflag"),
    "agg_sum_int": ("SELECT SUM(p_size) AS total, SUM(p_size + 1) AS more FROM part", "SELECT CAST(SUM(p_size) AS BIGINT) AS total, CAST(SUM(p_size + 1) AS BIGINT) AS more FROM part"),
    "agg_group": ("SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, COUNT(*) AS count_order, MIN(l_shipdate) AS first_ship, MAX(l_discount) AS max_disc FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus",
                  "SELECT l_returnflag, l_linestatus, SUM(l_quantity) AS sum_qty, COUNT(*) AS count_order, MIN(l_shipdate) AS first_ship, MAX(l_discount) AS max_disc FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus"),
    "agg_group_expr": ("SELECT o_custkey / 100 AS bucket, COUNT(*) AS n FROM orders GROUP BY o_custkey / 100", "SELECT o_custkey // 100 AS bucket, COUNT(*) AS n FROM orders GROUP BY 1"),
    "agg_expr_of_aggs": ("SELECT o_orderstatus, MAX(o_orderkey) - MIN(o_orderkey) + 1 AS span FROM orders GROUP BY o_orderstatus", None),
    "agg_empty": ("SELECT COUNT(*) AS n, SUM(o_totalprice) AS s, MIN(o_orderkey) AS lo FROM orders WHERE o_orderkey < 0", None),
    "agg_empty_group": ("SELECT o_orderstatus, COUNT(*) AS n FROM orders WHERE o_orderkey < 0 GROUP BY o_orderstatus", None),
    "agg_minmax_str": ("SELECT MIN(p_name) AS lo, MAX(p_name) AS hi FROM part", None),
    "distinct": ("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders", None),
    "count_distinct": ("SELECT o_orderstatus, COUNT(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderstatus", None),
    "having": ("SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) > 12", None),
    "order_limit": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", None),
    "order_limit_offset": ("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey, o_orderkey LIMIT 10 OFFSET 30", None),
    "limit_comma": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20, 5", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 20"),
}

ORDER_COLUMNS = [ColumnDef("o_orderkey", "INT64", False), ColumnDef("o_custkey", "INT64"), ColumnDef("o_orderstatus", "STRING"), ColumnDef("o_totalprice", "FLOAT64")]


def _select(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine_on(spark, sf_dir).query(text)


def _orders(spark: SparkSession, sf_dir: str, engine: str = "lsm") -> Engine:
    """An engine with a keyed table ``t`` that holds the orders."""
    e = engine_on(spark, sf_dir)
    e.create_table("t", ORDER_COLUMNS, ["o_orderkey"], engine)
    e.load("t", e.query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"))
    return e


def dml_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders(spark, sf_dir)
    e.execute("UPDATE t SET o_totalprice = o_totalprice + 1, o_orderstatus = 'X' WHERE o_custkey < 100")
    return e.query("SELECT * FROM t")


def dml_update_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders(spark, sf_dir)
    e.execute("UPDATE t SET o_orderkey = o_orderkey + 1")
    return e.query("SELECT * FROM t")


def dml_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders(spark, sf_dir)
    e.execute("DELETE FROM t WHERE o_orderstatus = 'F' AND o_totalprice > 1000")
    return e.query("SELECT * FROM t")


def dml_insert_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delete, insert, upsert and compaction, then one more change."""
    e = _orders(spark, sf_dir)
    e.execute("DELETE FROM t WHERE o_orderkey < 10")
    e.execute("INSERT INTO t (o_orderkey, o_custkey) VALUES (1, 11), (2, 12)")
    e.compact("t")
    e.load("t", spark.createDataFrame([(2, 22, "N", 2.5), (3, 23, None, None)], "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double"))
    return e.query("SELECT * FROM t")


def dml_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders(spark, sf_dir, "memory")
    e.execute("UPDATE t SET o_custkey = -o_custkey WHERE o_orderstatus != 'F'")
    return e.query("SELECT o_orderstatus, SUM(o_custkey) AS s, COUNT(*) AS n FROM t GROUP BY o_orderstatus")


def dml_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as JSON objects, as servers take them: over old keys, new ones, and a key twice, of which the last wins."""
    e = _orders(spark, sf_dir)
    e.write("t", [{"o_orderkey": 1, "o_custkey": 5, "o_orderstatus": "W", "o_totalprice": 1}, {"o_orderkey": -1, "o_custkey": 6, "unknown": 0}, {"o_orderkey": -1, "o_custkey": 7, "o_totalprice": 2.5}])
    return e.query("SELECT * FROM t")


def dml_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements that would leave two rows with one key, or one without, change nothing."""
    e = _orders(spark, sf_dir)
    texts = ("INSERT INTO t (o_orderkey) VALUES (-5), (1)", "INSERT INTO t (o_orderkey) VALUES (-6), (-6)", "UPDATE t SET o_orderkey = 1 WHERE o_orderkey < 10", "UPDATE t SET o_orderkey = NULL WHERE o_orderkey = 1")
    failed = sum(e.sql(x).code != 0 for x in texts)
    return e.query(f"SELECT o_orderkey, o_custkey, {failed} AS failed FROM t WHERE o_orderkey < 100")


def ddl_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column added and filled, one dropped."""
    e = _orders(spark, sf_dir)
    e.add_column("t", ColumnDef("note", "STRING"))
    e.drop_column("t", "o_custkey")
    e.execute("UPDATE t SET note = 'high' WHERE o_totalprice > 100000")
    return e.query("SELECT * FROM t")


def ddl_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dropped table's name can be given again; dropping what isn't there is no error with IF EXISTS."""
    e = _orders(spark, sf_dir)
    e.execute("DROP TABLE t")
    e.execute("DROP TABLE IF EXISTS t")
    e.execute("CREATE TABLE t (o_orderstatus STRING PRIMARY KEY, n BIGINT)")
    e.load("t", e.query("SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"))
    return e.query("SELECT * FROM t")


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of each user's last event: an upsert in which the largest event_id of a key wins."""
    e = engine_on(spark, sf_dir)
    e.create_table("last_event", [ColumnDef("user_id", "INT64", False), ColumnDef("event_id", "INT64"), ColumnDef("event_type", "STRING"), ColumnDef("value", "FLOAT64")], ["user_id"])
    e.load("last_event", e.query("SELECT user_id, event_id, event_type, value FROM events"), order_by="event_id")
    return e.query("SELECT * FROM last_event")


def show_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_on(spark, sf_dir).query("SHOW TABLES")


def describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders_definition(spark, sf_dir).query("DESCRIBE t")


def explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_on(spark, sf_dir).query("EXPLAIN SELECT o_custkey, COUNT(*) AS n FROM orders WHERE o_orderkey > 5 GROUP BY o_custkey LIMIT 3")


def _orders_definition(spark: SparkSession, sf_dir: str) -> Engine:
    e = engine_on(spark, sf_dir)
    e.execute("CREATE TABLE IF NOT EXISTS t (o_orderkey BIGINT, o_custkey INT NOT NULL, o_orderstatus VARCHAR(1), o_totalprice DOUBLE, PRIMARY KEY (o_orderkey))")
    return e


_T = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"
OTHERS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "dml_update": (dml_update, "SELECT o_orderkey, o_custkey, CASE WHEN o_custkey < 100 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_custkey < 100 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders"),
    "dml_update_key": (dml_update_key, "SELECT o_orderkey + 1 AS o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"),
    "dml_delete": (dml_delete, f"{_T} WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 1000)"),
    "dml_insert_compact": (dml_insert_compact, f"{_T} WHERE o_orderkey >= 10 UNION ALL SELECT * FROM (VALUES (1, 11, NULL, NULL), (2, 22, 'N', 2.5::DOUBLE), (3, 23, NULL, NULL))"),
    "dml_write": (dml_write, f"{_T} WHERE o_orderkey <> 1 UNION ALL SELECT * FROM (VALUES (1, 5, 'W', 1.0::DOUBLE), (-1, 7, NULL, 2.5))"),
    "dml_conflict": (dml_conflict, "SELECT o_orderkey, o_custkey, CAST(4 AS BIGINT) AS failed FROM orders WHERE o_orderkey < 100"),
    "ddl_columns": (ddl_columns, "SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_totalprice > 100000 THEN 'high' END AS note FROM orders"),
    "ddl_drop": (ddl_drop, "SELECT o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"),
    "dml_memory": (dml_memory, "SELECT o_orderstatus, CAST(SUM(CASE WHEN o_orderstatus != 'F' THEN -o_custkey ELSE o_custkey END) AS BIGINT) AS s, COUNT(*) AS n FROM orders GROUP BY o_orderstatus"),
    "latest_version": (latest_version, "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"),
    "show_tables": (show_tables, "SELECT unnest(['customer', 'events', 'lineitem', 'nation', 'orders', 'part', 'region', 'supplier']) AS \"table\""),
    "describe": (describe, "SELECT * FROM (VALUES ('o_orderkey', 'INT64', false, true), ('o_custkey', 'INT64', false, false), ('o_orderstatus', 'STRING', true, false), ('o_totalprice', 'FLOAT64', true, false)) AS d(field, type, \"null\", \"key\")"),
    "explain": (explain, "SELECT CAST(id AS INTEGER) AS id, CAST(depth AS INTEGER) AS depth, operation, detail FROM (VALUES (1, 0, 'Limit', 'Offset: 0, Count: 3'), (2, 1, 'Project', 'Expressions: [o_custkey, count(*) AS n]'), (3, 2, 'Aggregate', 'GroupBy: [o_custkey], Aggregates: [count(*)]'), (4, 3, 'Scan', 'Table: orders, Columns: [o_orderkey o_custkey], Predicate: (o_orderkey > 5)')) AS d(id, depth, operation, detail)"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {n: _select(s) for n, (s, _) in SELECTS.items()} | {n: f for n, (f, _) in OTHERS.items()}


def oracle_sql() -> dict[str, str]:
    return {n: sql or text for n, (text, sql) in SELECTS.items()} | {n: s for n, (_, s) in OTHERS.items()}
