import pytest

from widecairn.errors import AnalysisError, ColumnNotFound, TableNotFound, TypeMismatch
from widecairn.session import Engine


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    users = spark.createDataFrame([(1, "alice", 30, 95.5), (2, "bob", 25, 88.0), (3, "diana", 40, 72.0)], "id long, name string, age long, score double")
    e.register("users", users, ["id"])
    e.register("gaps", spark.createDataFrame([(1, None, 1.5, True), (2, 5, None, False), (3, 0, 2.5, None), (4, None, None, True)], "id long, x long, y double, b boolean"))
    e.register("days", spark.sql("SELECT id, date_add(DATE'2024-01-14', CAST(id AS INT)) AS d, timestamp_ntz'2024-01-15 08:00:00' AS at, timestamp'2024-01-15 08:00:00' AS tz FROM range(1, 4)"))
    e.register("none", users.limit(0))
    return e


def rows(engine, text):
    return sorted((tuple(r) for r in engine.query(text).collect()), key=repr)


@pytest.mark.parametrize(
    "cond, n",
    [
        ("name LIKE '%a%'", 2), ("name LIKE 'al%'", 1), ("name LIKE '%b'", 1), ("name LIKE 'b_b'", 1), ("name LIKE '%'", 3), ("name LIKE 'zzz'", 0), ("name LIKE 'A%'", 0),
        ("name NOT LIKE 'b%'", 2), ("NOT (name LIKE '%a%')", 1), ("name LIKE '%a%' AND age > 35", 1), ("age LIKE '3%'", 1), ("score LIKE '72'", 1), ("score LIKE '%.5'", 1), ("name LIKE '\\%'", 0),
        ("age >= 30", 2), ("age != 30", 2), ("age <> 30", 2), ("age = 30.0", 1), ("score > age", 3), ("age", 3), ("NOT age = 25 AND score < 90", 1), ("true", 3), ("1 = 2", 0), ("NULL", 0),
    ],
)
def test_filters(engine, cond, n):
    assert engine.query(f"SELECT id FROM users WHERE {cond}").count() == n


def test_null_logic(engine):
    assert rows(engine, "SELECT id FROM gaps WHERE x = 5") == [(2,)]
    assert rows(engine, "SELECT id FROM gaps WHERE NOT x = 5") == [(3,)]
    assert rows(engine, "SELECT id FROM gaps WHERE x != 5 OR b") == [(1,), (3,), (4,)]
    assert rows(engine, "SELECT id FROM gaps WHERE x = NULL") == []
    assert rows(engine, "SELECT id FROM gaps WHERE b = 1") == [(1,), (4,)]


def test_arithmetic(engine):
    assert rows(engine, "SELECT id, 7 / x AS q, y / 0 AS z, b + 1 AS c FROM gaps") == [(1, None, None, 2), (2, 1, None, 1), (3, None, None, None), (4, None, None, 2)]
    assert rows(engine, "SELECT -7 / 2 AS q, 7 / 2.0 AS r, 2 - 3 * 4 AS s") == [(-3, 3.5, -10)]
    with pytest.raises(Exception, match="overflow|OVERFLOW"):
        engine.query("SELECT 9223372036854775807 + id AS x FROM gaps").collect()


def test_dates(engine):
    assert rows(engine, "SELECT id FROM days WHERE d >= '2024-01-16'") == [(2,), (3,)]
    assert rows(engine, "SELECT id FROM days WHERE at = '2024-01-15T08:00:00Z' AND tz < '2024-01-15T10:00:00+01:00' AND id = 1") == [(1,)]
    assert rows(engine, "SELECT id FROM days WHERE d LIKE '%-17'") == [(3,)]
    assert rows(engine, "SELECT d + 1 AS n FROM days WHERE id = 1") == [(19738,)]
    with pytest.raises(TypeMismatch):
        engine.query("SELECT id FROM days WHERE d = 'soon'")


def test_projection_names(engine):
    assert engine.query("SELECT *, age + 1, name AS n FROM users").columns == ["id", "name", "age", "score", "(age + 1)", "n"]
    assert engine.query("SELECT score, id FROM users WHERE age > 1").columns == ["score", "id"]
    assert engine.query("SELECT u.name FROM users u").columns == ["name"]
    assert rows(engine, "SELECT 1 AS one") == [(1,)]


def test_aggregates(engine):
    assert rows(engine, "SELECT COUNT(*), SUM(score), MIN(age), MAX(age), AVG(age), MIN(name) FROM users") == [(3, 255.5, 25, 40, 95 / 3, "alice")]
    assert rows(engine, "SELECT COUNT(x) AS n, SUM(x) AS s, AVG(y) AS a, COUNT(DISTINCT b) AS d, MAX(b) AS m FROM gaps") == [(2, 5, 2.0, 2, True)]
    assert rows(engine, "SELECT SUM(age) + 1 AS s, SUM(age * 2) AS t FROM users") == [(96, 190)]
    assert rows(engine, "SELECT COUNT(*), SUM(age), AVG(age) FROM none") == [(0, None, None)]
    assert rows(engine, "SELECT name, COUNT(*) FROM none GROUP BY name") == []
    assert rows(engine, "SELECT b, COUNT(*) AS n FROM gaps GROUP BY b") == [(False, 1), (None, 1), (True, 2)]
    assert rows(engine, "SELECT x / 2 AS h, COUNT(*) AS n FROM gaps GROUP BY x / 2 HAVING n = 1") == [(0, 1), (2, 1)]
    assert rows(engine, "SELECT u.age / 10 + 1 AS k FROM users u GROUP BY age / 10") == [(3,), (4,), (5,)]


def test_sort_distinct_limit(engine):
    q = lambda t: [tuple(r) for r in engine.query(t).collect()]
    assert q("SELECT name FROM users ORDER BY age DESC LIMIT 2") == [("diana",), ("alice",)]
    assert q("SELECT name, age AS y FROM users ORDER BY y LIMIT 1, 1") == [("alice", 30)]
    assert q("SELECT id FROM users ORDER BY 1 DESC LIMIT 1") == [(3,)]
    assert q("SELECT x FROM gaps ORDER BY x, id") == [(None,), (None,), (0,), (5,)]
    assert q("SELECT DISTINCT b FROM gaps ORDER BY b DESC") == [(True,), (False,), (None,)]
    assert q("SELECT b, COUNT(*) FROM gaps GROUP BY b ORDER BY COUNT(*) DESC, b LIMIT 1") == [(True, 2)]
    assert q("SELECT id FROM users LIMIT 0") == []
    assert q("SELECT id FROM users ORDER BY id LIMIT 5 OFFSET 9") == []


@pytest.mark.parametrize(
    "text, error",
    [
        ("SELECT a FROM nowhere", TableNotFound), ("SELECT nope FROM users", ColumnNotFound), ("SELECT Name FROM users", ColumnNotFound), ("SELECT x.id FROM users", ColumnNotFound),
        ("SELECT name, COUNT(*) FROM users", AnalysisError), ("SELECT id FROM users WHERE COUNT(*) > 1", AnalysisError), ("SELECT upper(name) FROM users", AnalysisError),
        ("SELECT id FROM users WHERE upper(name) = 'A'", AnalysisError), ("SELECT SUM(name) FROM users", TypeMismatch), ("SELECT SUM(b) FROM gaps", TypeMismatch),
        ("SELECT name + 1 FROM users", TypeMismatch), ("SELECT id FROM users WHERE name = 1", TypeMismatch), ("SELECT *", AnalysisError), ("SELECT SUM(COUNT(*)) FROM users", AnalysisError),
    ],
)
def test_errors(engine, text, error):
    with pytest.raises(error):
        engine.query(text)


def test_explain(engine):
    r = engine.query("EXPLAIN SELECT name, COUNT(*) AS n FROM users WHERE age > 1 GROUP BY name ORDER BY n LIMIT 2").collect()
    assert [(x.id, x.depth, x.operation) for x in r] == [(1, 0, "Limit"), (2, 1, "Sort"), (3, 2, "Project"), (4, 3, "Aggregate"), (5, 4, "Scan")]
    assert "Predicate: (age > 1)" in r[-1].detail


def test_pushdown(spark):
    e = Engine(spark)
    e.register_parquet("orders", "/root/testdata/sf0.001/orders.parquet")
    plan = e.query("SELECT o_custkey FROM orders WHERE o_orderkey = 5 AND o_totalprice > 10")._jdf.queryExecution().toString()
    assert "EqualTo(o_orderkey,5)" in plan and "GreaterThan(o_totalprice" in plan
    assert "o_orderpriority" not in plan.split("ReadSchema:")[1].split(">")[0]
