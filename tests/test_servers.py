import io
import json
import socket
import struct
import threading
import urllib.error
import urllib.request

import pytest

from widecairn.cli import Shell
from widecairn.server import tcp
from widecairn.server.http import serve_http
from widecairn.server.pgwire import serve_pg
from widecairn.session import Engine


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("root")))
    e.execute("CREATE TABLE sensor (id INT PRIMARY KEY, name STRING, temp DOUBLE, at TIMESTAMP, ok BOOL)")
    e.write("sensor", [{"id": 1, "name": "a", "temp": 20.5, "at": "2024-01-15T08:00:00Z", "ok": True}, {"id": 2, "name": None}])
    return e


@pytest.fixture(scope="module")
def servers(engine):
    out = {"http": serve_http(engine, port=0), "tcp": tcp.serve_tcp(engine, port=0), "pg": serve_pg(engine, port=0)}
    for s in out.values():
        threading.Thread(target=s.serve_forever, daemon=True).start()
    yield {k: s.server_address[:2] for k, s in out.items()}
    for s in out.values():
        s.shutdown()
        s.server_close()


def http(at, path, body=None, method=None):
    r = urllib.request.Request(f"http://{at[0]}:{at[1]}{path}", None if body is None else json.dumps(body).encode(), method=method)
    try:
        f = urllib.request.urlopen(r)
    except urllib.error.HTTPError as e:
        f = e
    raw = f.read().decode()
    return f.status, json.loads(raw) if raw.startswith("{") else raw


def test_http(servers):
    at = servers["http"]
    status, r = http(at, "/query", {"sql": "SELECT id, temp FROM sensor WHERE id = 1"})
    assert status == 200 and r == {"code": 0, "data": [{"id": 1, "temp": 20.5}], "rows": 1, "columns": ["id", "temp"]}
    assert http(at, "/query", {"sql": "SELECT nope FROM sensor"})[0] == 400
    assert http(at, "/write", {"table": "sensor", "rows": [{"id": 3, "temp": 1}]}) == (200, {"code": 0, "rows": 1})
    assert http(at, "/write", {"table": "sensor", "rows": 5})[0] == 400
    assert http(at, "/query")[0] == 405 and http(at, "/nowhere")[0] == 404 and http(at, "/health", {})[0] == 405
    assert http(at, "/health")[1]["status"] == "ok"
    assert "widecairn_query_total" in http(at, "/metrics")[1]
    assert http(at, "/admin/compact", {})[1]["affected"] == 1 and http(at, "/admin/flush", {})[0] == 200
    assert http(at, "/admin/stats")[1]["tables"][0]["base_rows"] == 3
    assert http(at, "/admin/slow-queries")[1]["code"] == 0


def test_tcp(servers):
    c = tcp.Client(*servers["tcp"])
    assert c.ping() == {"code": 0, "message": "pong"}
    assert c.query("SELECT name FROM sensor WHERE id = 1")["data"] == [{"name": "a"}]
    assert c.query("SELEC")["code"] != 0
    assert c.write("sensor", [{"id": 4}])["rows"] == 1
    c.close()
    s = socket.create_connection(servers["tcp"])
    s.sendall(b"GET / HTTP/1.1\r\n\r\n")
    assert s.recv(1) == b""
    s.close()


class Pg:
    def __init__(self, at):
        self.s = socket.create_connection(at)
        self.f = self.s.makefile("rb")
        self.s.sendall(struct.pack(">II", 8, 80877103))
        assert self.f.read(1) == b"N"
        body = struct.pack(">I", 196608) + b"user\0x\0\0"
        self.s.sendall(struct.pack(">I", len(body) + 4) + body)
        self.until_ready()

    def send(self, *messages):
        self.s.sendall(b"".join(k + struct.pack(">I", len(b) + 4) + b for k, b in messages))

    def until_ready(self):
        out = []
        while True:
            k = self.f.read(1)
            (n,) = struct.unpack(">I", self.f.read(4))
            out.append((k, self.f.read(n - 4)))
            if k == b"Z":
                return out


def values(body):
    (n,), at, out = struct.unpack(">H", body[:2]), 2, []
    for _ in range(n):
        (size,) = struct.unpack(">i", body[at : at + 4])
        at += 4
        out.append(None if size < 0 else body[at : at + size].decode())
        at += max(size, 0)
    return out


def test_pg(servers):
    p = Pg(servers["pg"])
    p.send((b"Q", b"SELECT id, name, temp, at, ok FROM sensor WHERE id <= 2 ORDER BY id\0"))
    r = p.until_ready()
    assert [k for k, _ in r] == [b"T", b"D", b"D", b"C", b"Z"]
    assert values(r[1][1]) == ["1", "a", "20.5", "2024-01-15 08:00:00", "t"] and values(r[2][1]) == ["2", None, None, None, None]
    assert struct.pack(">I", 20) in r[0][1] and struct.pack(">I", 1114) in r[0][1] and r[3][1] == b"SELECT 2\0"
    p.send((b"Q", b"UPDATE sensor SET temp = 3 WHERE id = 2\0"))
    assert p.until_ready()[0] == (b"C", b"UPDATE 1\0")
    p.send((b"Q", b"SELECT nope FROM sensor\0"))
    assert [k for k, _ in p.until_ready()] == [b"E", b"Z"]
    p.send((b"Q", b";\0"), (b"Q", b"BEGIN\0"))
    assert p.until_ready()[0][0] == b"I" and p.until_ready()[0] == (b"C", b"BEGIN\0")
    p.send((b"P", b"s\0SELECT id FROM sensor WHERE id = 1\0\0\0"), (b"D", b"Ss\0"), (b"B", b"\0s\0\0\0\0\0\0\0"), (b"E", b"\0\0\0\0\0"), (b"C", b"Ss\0"), (b"S", b""))
    assert [k for k, _ in p.until_ready()] == [b"1", b"t", b"T", b"2", b"D", b"C", b"3", b"Z"]
    p.send((b"P", b"\0SELECT x FROM sensor\0\0\0"), (b"B", b"\0\0\0\0\0\0\0\0"), (b"E", b"\0\0\0\0\0"), (b"E", b"\0\0\0\0\0"), (b"S", b""))
    assert [k for k, _ in p.until_ready()] == [b"1", b"2", b"E", b"Z"]
    p.send((b"X", b""))


def test_same_rows_over_all_protocols(servers, engine):
    sql = "SELECT ok, COUNT(*) AS n FROM sensor GROUP BY ok ORDER BY ok"
    want = engine.sql(sql).data
    c = tcp.Client(*servers["tcp"])
    assert c.query(sql)["data"] == http(servers["http"], "/query", {"sql": sql})[1]["data"] == want
    c.close()


def test_shell(servers, engine):
    out = io.StringIO()
    shell = Shell(engine, {"TCP": "{}:{}".format(*servers["tcp"]), "HTTP": "{}:{}".format(*servers["http"])}, out)
    shell.run(["\\format csv\n", "SELECT id FROM sensor\n", "WHERE id = 1;\n", "\\use TCP\n", "SELECT 2 AS b;\n", "\\use HTTP\n", "SELECT c;\n", "\\status\n", "\\addrs\n", "\\h\n", "\\what\n", "\\q\n", "SELECT 9 AS never;\n"])
    text = out.getvalue()
    assert "id\n1\n" in text and "b\n2\n" in text and "ERROR" in text and "HTTP" in text and "never" not in text
