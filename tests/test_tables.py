import datetime as dt
import os
import random

import pytest

from widecairn.errors import AnalysisError, ConstraintViolation, InvalidSchema, PrimaryKeyConflict, TableExists, TableNotFound, TypeMismatch
from widecairn.functions.types import ColumnDef
from widecairn.session import Engine


@pytest.fixture()
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, v STRING, n INT, active BOOL)")
    e.execute("INSERT INTO t VALUES (1, 'a', 10, true), (2, 'b', 20, false), (3, NULL, NULL, true)")
    return e


def rows(e, text="SELECT * FROM t"):
    return sorted((tuple(r) for r in e.query(text).collect()), key=repr)


BEFORE = [(1, "a", 10, True), (2, "b", 20, False), (3, None, None, True)]


def test_insert_conflicts(engine):
    for text in ("INSERT INTO t VALUES (1, 'x', 1, true)", "INSERT INTO t (id) VALUES (8), (8)", "INSERT INTO t (id) VALUES (9), (2)"):
        with pytest.raises(PrimaryKeyConflict):
            engine.execute(text)
    assert rows(engine) == BEFORE
    assert engine.execute("INSERT INTO t (n, id) VALUES (5, 4)") == 1
    assert (4, None, 5, None) in rows(engine)


def test_insert_errors(engine):
    with pytest.raises(ConstraintViolation):
        engine.execute("INSERT INTO t (v) VALUES ('x')")
    for text in ("INSERT INTO t (id, n) VALUES (7, 'x')", "INSERT INTO t (id, v) VALUES (7, 1)"):
        with pytest.raises(TypeMismatch):
            engine.execute(text)
    with pytest.raises(AnalysisError):
        engine.execute("INSERT INTO t (id, n) VALUES (7)")
    assert rows(engine) == BEFORE


def test_update(engine):
    assert engine.execute("UPDATE t SET n = n + 1, v = 'z', active = NOT active WHERE active = true") == 2
    assert rows(engine) == [(1, "z", 11, False), (2, "b", 20, False), (3, "z", None, False)]
    assert engine.execute("UPDATE t SET n = 0 WHERE id = 99") == 0
    assert engine.execute("UPDATE t SET n = 2.9") == 3
    assert {r[2] for r in rows(engine)} == {2}
    with pytest.raises(TypeMismatch):
        engine.execute("UPDATE t SET n = v")


def test_update_sees_old_row(engine):
    engine.execute("UPDATE t SET id = id + 100, n = id WHERE id = 1")
    assert (101, "a", 1, True) in rows(engine) and len(rows(engine)) == 3


def test_update_key(engine):
    with pytest.raises(PrimaryKeyConflict):
        engine.execute("UPDATE t SET id = 2 WHERE id = 1")
    with pytest.raises(PrimaryKeyConflict):
        engine.execute("UPDATE t SET id = 7")
    assert rows(engine) == BEFORE
    assert engine.execute("UPDATE t SET id = id + 1") == 3
    assert [r[0] for r in rows(engine)] == [2, 3, 4]
    assert engine.execute("UPDATE t SET id = id WHERE id = 2") == 1
    assert len(rows(engine)) == 3


def test_delete(engine):
    assert engine.execute("DELETE FROM t WHERE n > 15") == 1
    assert engine.execute("DELETE FROM t WHERE n > 15") == 0
    assert engine.execute("INSERT INTO t (id) VALUES (2)") == 1
    assert rows(engine) == [(1, "a", 10, True), (2, None, None, None), (3, None, None, True)]
    assert engine.execute("DELETE FROM t") == 3
    assert rows(engine) == [] and engine.tables() == ["t"]


def test_write(engine):
    r = engine.write("t", [{"id": 1, "v": "p", "extra": 5}, {"id": 5, "n": 1.9}, {"id": 1, "v": "q"}])
    assert (r.code, r.rows) == (0, 2)
    assert rows(engine) == [(1, "q", None, None), (2, "b", 20, False), (3, None, None, True), (5, None, 1, None)]
    assert engine.write("t", [{"v": "x"}]).code and engine.write("t", [{"id": None}]).code
    assert engine.write("t", []).rows == 0


def test_compaction_and_restart(engine, spark):
    engine.execute("DELETE FROM t WHERE id = 2")
    engine.execute("UPDATE t SET v = 'new' WHERE id = 3")
    want = rows(engine)
    engine.compact()
    assert rows(engine) == want
    s = engine.stats()["tables"][0]
    assert (s["base_rows"], s["deltas"]) == (2, 0)
    engine.execute("UPDATE t SET n = 1 WHERE id = 1")
    again = Engine(spark, engine.root)
    assert rows(again) == [(1, "a", 1, True), (3, "new", None, True)]
    engine.table("t").compact(whole=False)
    assert rows(again) == rows(engine) == [(1, "a", 1, True), (3, "new", None, True)]


def test_snapshot_reads(engine):
    df = engine.query("SELECT COUNT(*) AS n FROM t")
    engine.execute("DELETE FROM t WHERE id = 1")
    engine.compact()
    engine.table("t").clean(grace=-1)
    assert df.collect()[0].n == 3 and engine.query("SELECT COUNT(*) AS n FROM t").collect()[0].n == 2


def test_unnamed_files_are_ignored(engine, spark):
    t = engine.table("t")
    spark.range(5).write.parquet(f"{t.root}/data/orphan")
    assert rows(engine) == BEFORE
    assert t.clean() == 0 and t.clean(grace=-1) >= 1 and rows(engine) == BEFORE


def test_many_deltas_compact_themselves(engine):
    for k in range(9):
        engine.write("t", [{"id": 50 + k, "n": k}])
    assert engine.stats()["tables"][0]["deltas"] < 8
    assert len(rows(engine)) == 12


def test_memory_engine(engine, spark):
    engine.execute("CREATE TABLE m (id BIGINT, name STRING, PRIMARY KEY (id)) ENGINE=memory")
    engine.execute("INSERT INTO m VALUES (1, 'a'), (2, 'b')")
    assert rows(engine, "SELECT * FROM m") == [(1, "a"), (2, "b")]
    again = Engine(spark, engine.root)
    assert rows(again, "SELECT * FROM m") == [] and len(rows(again)) == 3


def test_ddl(engine):
    with pytest.raises(TableExists):
        engine.execute("CREATE TABLE t (id INT PRIMARY KEY)")
    engine.execute("CREATE TABLE IF NOT EXISTS t (id INT PRIMARY KEY)")
    assert rows(engine, "SHOW TABLES") == [("t",)]
    assert [tuple(r) for r in engine.query("DESC t").collect()] == [("id", "INT64", False, True), ("v", "STRING", True, False), ("n", "INT64", True, False), ("active", "BOOL", True, False)]
    folder = engine.table("t").root
    engine.execute("DROP TABLE t")
    assert engine.tables() == [] and not os.path.exists(folder)
    with pytest.raises(TableNotFound):
        engine.execute("DROP TABLE t")
    engine.execute("DROP TABLE IF EXISTS t")


def test_alter(engine):
    engine.add_column("t", ColumnDef("extra", "FLOAT64", False))
    assert engine.query("SELECT extra FROM t WHERE id = 1").collect()[0][0] is None
    engine.execute("UPDATE t SET extra = 1.5 WHERE id = 1")
    engine.drop_column("t", "v")
    assert engine.query("SELECT * FROM t WHERE id = 1").collect()[0].asDict() == {"id": 1, "n": 10, "active": True, "extra": 1.5}
    for f in (lambda: engine.drop_column("t", "id"), lambda: engine.add_column("t", ColumnDef("n", "INT64"))):
        with pytest.raises(InvalidSchema):
            f()


def test_typed(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.execute("CREATE TABLE typed (id BIGINT PRIMARY KEY, small SMALLINT, medium MEDIUMINT, tiny TINYINT UNSIGNED, bigu BIGINT UNSIGNED, d DATE, ts TIMESTAMP, score FLOAT64, name STRING)")
    e.execute("INSERT INTO typed VALUES (1, 10, 1000, 200, 50000, '2024-01-15', '2024-01-15T08:00:00Z', 9.5, 'alpha')")
    r = e.sql("SELECT * FROM typed").data[0]
    assert r == {"id": 1, "small": 10, "medium": 1000, "tiny": 200, "bigu": 50000, "d": "2024-01-15", "ts": "2024-01-15T08:00:00Z", "score": 9.5, "name": "alpha"}
    assert e.write("typed", [{"id": 2, "d": 19737, "ts": "2024-01-15T10:00:00+02:00"}]).code == 0
    assert e.query("SELECT d FROM typed WHERE id = 2 AND ts = '2024-01-15T08:00:00Z'").collect()[0][0] == dt.date(2024, 1, 15)
    assert e.sql("INSERT INTO typed (id, tiny) VALUES (3, 300)").code and e.sql("INSERT INTO typed (id, bigu) VALUES (3, -1)").code
    assert e.sql("UPDATE typed SET small = 40000").code and e.sql("UPDATE typed SET bigu = bigu - 60000").code
    assert e.execute("UPDATE typed SET d = '2024-02-01', ts = '2024-02-01T00:00:00Z' WHERE id = 1") == 1
    assert e.sql("SELECT d FROM typed WHERE id = 1").data == [{"d": "2024-02-01"}]


def test_composite_key(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.execute("CREATE TABLE lines (order_id INT, sku STRING, qty INT, PRIMARY KEY (order_id, sku))")
    e.execute("INSERT INTO lines VALUES (1, 'a', 1), (1, 'b', 2), (10, 'a', 3), (2, 'a', 4)")
    assert e.query("SELECT * FROM lines WHERE order_id = 1").count() == 2
    assert e.query("SELECT * FROM lines WHERE order_id >= 2").count() == 2
    assert e.execute("UPDATE lines SET qty = qty + 1 WHERE order_id = 1 AND sku = 'b'") == 1
    assert e.execute("DELETE FROM lines WHERE order_id = 1 AND sku = 'a'") == 1
    with pytest.raises(PrimaryKeyConflict):
        e.execute("UPDATE lines SET order_id = 1, sku = 'b' WHERE order_id = 2")
    assert rows(e, "SELECT * FROM lines") == [(1, "b", 3), (10, "a", 3), (2, "a", 4)]


def test_views_are_read_only(spark, tmp_path):
    e = Engine(spark, str(tmp_path))
    e.register("v", spark.range(3))
    with pytest.raises(AnalysisError):
        e.execute("DELETE FROM v")


def test_against_a_dict(spark, tmp_path):
    """A random mix of statements does what the same steps do to a dict."""
    e, r, model = Engine(spark, str(tmp_path)), random.Random(4), {}
    e.execute("CREATE TABLE d (k INT PRIMARY KEY, v INT)")
    for step in range(14):
        a, b = r.randint(0, 12), r.randint(0, 12)
        kind = r.choice(("insert", "write", "update", "delete", "shift", "compact"))
        if kind == "insert":
            if e.sql(f"INSERT INTO d VALUES ({a}, {b})").code == 0:
                assert a not in model
                model[a] = b
            else:
                assert a in model
        elif kind == "write":
            e.write("d", [{"k": a, "v": b}, {"k": b, "v": a}])
            model |= {a: b}
            model |= {b: a}
        elif kind == "update":
            assert e.execute(f"UPDATE d SET v = v + {b} WHERE k > {a}") == sum(k > a for k in model)
            model = {k: v + b if k > a else v for k, v in model.items()}
        elif kind == "delete":
            assert e.execute(f"DELETE FROM d WHERE v < {a}") == sum(v < a for v in model.values())
            model = {k: v for k, v in model.items() if v >= a}
        elif kind == "shift":
            e.execute("UPDATE d SET k = k + 1")
            model = {k + 1: v for k, v in model.items()}
        else:
            e.compact("d")
        assert dict(rows(e, "SELECT k, v FROM d")) == model, (step, kind)


def test_responses_metrics_slow_log(engine):
    engine.config.slow_query_ms = 1
    ok, bad, worse = engine.sql("SELECT id FROM t WHERE id = 1"), engine.sql("SELECT FROM"), engine.sql("SELECT x FROM t")
    assert (ok.code, ok.rows, ok.columns, ok.data) == (0, 1, ["id"], [{"id": 1}])
    assert (bad.code, worse.code) == (1, 2) and "parse" in bad.message
    assert engine.sql("SELECT id, v AS id FROM t").code == 2
    assert engine.metrics()["query_total"] == 4 and engine.metrics()["query_errors_total"] == 3
    assert engine.slow_queries()[0]["sql"].startswith("SELECT id, v") and engine.slow_queries()[0]["source"] == "inproc"


def test_stream_ingestion(engine, spark, tmp_path):
    from widecairn.streaming.ingest import ingest

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "s", 1, True), (9, "s", 9, None)], "id long, v string, n long, active boolean").write.parquet(src)
    stream = spark.readStream.schema("id long, v string, n long, active boolean").parquet(src)
    q = ingest(engine, "t", stream, str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert rows(engine) == [(1, "s", 1, True), (2, "b", 20, False), (3, None, None, True), (9, "s", 9, None)]


def test_get_and_explain(engine):
    assert engine.get("t", id=2) == {"id": 2, "v": "b", "n": 20, "active": False}
    assert engine.get("t", id=99) is None
    with pytest.raises(AnalysisError):
        engine.get("t", v="a")
    assert "Physical Plan" in engine.explain("SELECT id FROM t WHERE id = 1")


def test_group_commit(engine):
    from widecairn.streaming.group_commit import GroupCommitter

    c = GroupCommitter(lambda rows: engine.write("t", rows), interval=0.2)
    before = engine.table("t").manifest().number
    done = [c.submit([{"id": 100 + k, "n": k}]) for k in range(20)]
    assert [d.result(60).rows for d in done] == [1] * 20
    assert engine.table("t").manifest().number - before < 5
    good, bad = c.submit([{"id": 200}]), c.submit([{"n": 1}])
    assert good.result(60).code == 0 and bad.result(60).code != 0
    c.close()
    assert engine.query("SELECT * FROM t").count() == 24


def test_scheduler(engine):
    from widecairn.sources.scheduler import Scheduler

    s = Scheduler(engine)
    engine.table("t").files.write_new(f"{engine.table('t').root}/data/orphan", "x")
    s.run("clean")
    s.run("compact")
    assert s.counts == {"compact": 1, "clean": 1} and not s.last_error and rows(engine) == BEFORE
    s.start()
    s.stop()


def test_key_set_to_null(engine):
    out = engine.sql("UPDATE t SET id = NULL WHERE id = 1")
    assert out.code == 3 and "must not be null" in out.message


def test_one_writer_of_a_name_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from widecairn.sources.files import Files

    files = Files(spark)
    with ThreadPoolExecutor(8) as pool:
        for k in range(25):
            path = f"{tmp_path}/names/{k}"
            won = list(pool.map(lambda n: files.write_new(path, f"text {n}"), range(8)))
            assert sum(won) == 1 and files.read(path) == f"text {won.index(True)}"
    assert files.list(f"{tmp_path}/names") == sorted(map(str, range(25)))


def test_writers_of_one_table_lose_nothing(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from widecairn.errors import CommitConflict
    from widecairn.session import Engine

    sessions = [Engine(spark, str(tmp_path)) for _ in range(3)]
    sessions[0].execute("CREATE TABLE w (id BIGINT PRIMARY KEY, v BIGINT)")

    def write(k):
        done = []
        for n in range(3):
            try:
                sessions[k].load("w", spark.createDataFrame([(k * 100 + n, n)], "id long, v long"))
                done.append(k * 100 + n)
            except CommitConflict:
                pass
        return done

    with ThreadPoolExecutor(3) as pool:
        done = [i for ids in pool.map(write, range(3)) for i in ids]
    assert sorted(r.id for r in sessions[0].query("SELECT id FROM w").collect()) == sorted(done) != []


def test_two_sessions_change_the_catalog(spark, tmp_path):
    from widecairn.session import Engine

    a, b = Engine(spark, str(tmp_path)), Engine(spark, str(tmp_path))
    a.execute("CREATE TABLE x (id BIGINT PRIMARY KEY)")
    b.execute("CREATE TABLE y (id BIGINT PRIMARY KEY)")
    assert b.execute("INSERT INTO x (id) VALUES (1)") == 1 and a.tables() == b.tables() == ["x", "y"]
    assert b.sql("CREATE TABLE x (id BIGINT PRIMARY KEY)").code != 0
    a.execute("DROP TABLE y")
    b.execute("CREATE TABLE y (id BIGINT PRIMARY KEY, more STRING)")
    assert [r.field for r in a.query("DESCRIBE y").collect()] == ["id", "more"]


def test_writes_through_servers_share_commits(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from widecairn.config import Config
    from widecairn.session import Engine

    e = Engine(spark, str(tmp_path), Config(group_commit_ms=300))
    e.execute("CREATE TABLE g (id BIGINT PRIMARY KEY, v STRING)")
    with ThreadPoolExecutor(8) as pool:
        out = list(pool.map(lambda k: e.submit("g", [{"id": k, "v": "x"}], "http"), range(8)))
    assert [x.code for x in out] == [0] * 8 and [x.rows for x in out] == [1] * 8
    assert e.table("g").manifest().number < 8 and e.query("SELECT COUNT(*) AS n FROM g").head().n == 8
    assert e.submit("missing", [{"id": 1}], "http").code == 2 and e.submit("g", [{"v": "no key"}], "http").code == 3
    e.execute("DROP TABLE g")
    assert e.submit("g", [{"id": 1}], "http").code == 2
    e.close()


def test_repeated_point_reads(spark, tmp_path):
    import time

    from widecairn.config import Config
    from widecairn.session import Engine

    e = Engine(spark, str(tmp_path), Config(cached_rows=2))
    e.execute("CREATE TABLE p (id BIGINT PRIMARY KEY, v STRING)")
    e.write("p", [{"id": k, "v": f"v{k}"} for k in range(5)])
    assert e.get("p", id=1) == {"id": 1, "v": "v1"} and e.get("p", id=9) is None
    took = []
    for _ in range(20):
        began = time.perf_counter()
        assert e.get("p", id=1) == {"id": 1, "v": "v1"}
        took.append(time.perf_counter() - began)
    assert e.metrics()["row_cache_hits_total"] == 20 and sorted(took)[10] < 0.1
    e.get("p", id=1)["v"] = "changed by the caller"
    assert e.get("p", id=1)["v"] == "v1"
    e.execute("UPDATE p SET v = 'new' WHERE id = 1")
    assert e.get("p", id=1)["v"] == "new"
    for k in range(4):
        e.get("p", id=k)
    assert e.metrics()["row_cache_entries"] == 2


def test_memory_table_is_read_from_memory(spark, tmp_path):
    from widecairn.session import Engine

    e = Engine(spark, str(tmp_path))
    e.execute("CREATE TABLE m (id BIGINT PRIMARY KEY, v BIGINT) ENGINE=memory")
    e.write("m", [{"id": k, "v": k} for k in range(50)])
    assert e.query("SELECT SUM(v) AS s FROM m").head().s == 1225
    assert "InMemoryTableScan" in e.explain("SELECT v FROM m WHERE id > 3")
    e.execute("UPDATE m SET v = 0 WHERE id > 0")
    assert e.query("SELECT SUM(v) AS s FROM m").head().s == 0
    e.add_column("m", ColumnDef("w", "STRING"))
    assert e.query("SELECT COUNT(w) AS n FROM m").head().n == 0
    e.close()
