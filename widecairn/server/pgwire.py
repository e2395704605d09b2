"""PostgreSQL wire protocol, version 3: simple and extended queries, text format, no password.

Statements are the engine's own; bound parameters are ignored, as the dialect has no
placeholders.  BEGIN, COMMIT, ROLLBACK and SET are accepted and do nothing, which drivers
ask for before their first query.
"""

from __future__ import annotations

import socketserver
import struct
import threading

from ..errors import EngineError
from ..plans.ast import CreateTable, Delete, DropTable, Insert, Update
from ..plans.parser import parse
from ..render import cell
from ..session import Engine, Response

#: Request codes, and type ids with sizes by Spark type.
SSL_REQUEST, GSS_REQUEST, CANCEL_REQUEST, PROTOCOL_3 = 80877103, 80877104, 80877102, 196608
TYPES = {"boolean": (16, 1), "tinyint": (21, 2), "smallint": (21, 2), "int": (23, 4), "bigint": (20, 8), "float": (701, 8), "double": (701, 8), "date": (1082, 4), "timestamp": (1114, 8), "timestamp_ntz": (1114, 8)}
TEXT = (25, -1)
QUIET = ("begin", "commit", "rollback", "set", "start", "discard", "reset")


def message(kind: bytes, body: bytes = b"") -> bytes:
    return kind + struct.pack(">I", len(body) + 4) + body


def _z(s: str) -> bytes:
    return s.encode() + b"\0"


def description(columns: list[str], types: list[str]) -> bytes:
    out = struct.pack(">H", len(columns))
    for n, t in zip(columns, types):
        oid, size = TYPES.get(t, TEXT)
        out += _z(n) + struct.pack(">IHIhiH", 0, 0, oid, size, -1, 0)
    return message(b"T", out)


def text_of(v, kind: str) -> str:
    if isinstance(v, bool):
        return "t" if v else "f"
    if kind.startswith("timestamp"):
        return str(v).replace("T", " ").removesuffix("Z")
    return cell(v)


def data_row(row: dict, columns: list[str], types: list[str]) -> bytes:
    out = struct.pack(">H", len(columns))
    for n, t in zip(columns, types):
        v = row[n]
        raw = None if v is None else text_of(v, t).encode()
        out += struct.pack(">i", -1) if raw is None else struct.pack(">i", len(raw)) + raw
    return message(b"D", out)


def tag_of(sql: str, r: Response) -> str:
    s = parse(sql)
    if isinstance(s, Insert):
        return f"INSERT 0 {r.rows}"
    if isinstance(s, Update):
        return f"UPDATE {r.rows}"
    if isinstance(s, Delete):
        return f"DELETE {r.rows}"
    if isinstance(s, CreateTable):
        return "CREATE TABLE"
    if isinstance(s, DropTable):
        return "DROP TABLE"
    return f"SELECT {r.rows}"


def error(text: str, code: str = "XX000") -> bytes:
    return message(b"E", b"S" + _z("ERROR") + b"C" + _z(code) + b"M" + _z(text) + b"\0")


class Handler(socketserver.StreamRequestHandler):
    timeout = 300

    def setup(self) -> None:
        super().setup()
        self.statements: dict[str, str] = {}
        self.portals: dict[str, str] = {}
        self.failed = False

    @property
    def engine(self) -> Engine:
        return self.server.engine

    def _exactly(self, n: int) -> bytes:
        raw = self.rfile.read(n)
        if len(raw) < n:
            raise ConnectionError
        return raw

    def handle(self) -> None:
        if not self.server.slots.acquire(blocking=False):
            self.wfile.write(error("too many connections", "53300"))
            return
        try:
            if self._start():
                while self._next():
                    pass
        except (OSError, ConnectionError, struct.error):
            pass
        finally:
            self.server.slots.release()

    def _start(self) -> bool:
        while True:
            n, code = struct.unpack(">II", self._exactly(8))
            if n > 10_000:
                return False
            self._exactly(n - 8)
            if code in (SSL_REQUEST, GSS_REQUEST):
                self.wfile.write(b"N")
            elif code == PROTOCOL_3:
                break
            else:
                return False
        out = message(b"R", struct.pack(">I", 0))
        for k, v in (("server_version", "14.0"), ("client_encoding", "UTF8"), ("server_encoding", "UTF8"), ("DateStyle", "ISO, MDY"), ("TimeZone", "UTC"), ("standard_conforming_strings", "on"), ("integer_datetimes", "on")):
            out += message(b"S", _z(k) + _z(v))
        self.wfile.write(out + message(b"K", struct.pack(">II", 0, 0)) + self._ready())
        return True

    @staticmethod
    def _ready() -> bytes:
        return message(b"Z", b"I")

    def _next(self) -> bool:
        kind = self._exactly(1)
        (n,) = struct.unpack(">I", self._exactly(4))
        body = self._exactly(n - 4)
        if kind == b"X":
            return False
        if kind == b"S":
            self.failed = False
            self.wfile.write(self._ready())
        elif kind == b"Q":
            self.wfile.write(self._simple(body[:-1].decode()) + self._ready())
        elif kind in b"PBDEC" and not (self.failed and kind != b"C"):
            try:
                self.wfile.write({b"P": self._parse, b"B": self._bind, b"D": self._describe, b"E": self._execute, b"C": self._close}[kind](body))
            except EngineError as e:
                self.failed = True
                self.wfile.write(error(str(e)))
        return True

    def _simple(self, sql: str) -> bytes:
        parts = [sql] if sql.strip().strip(";").strip() else []
        if not parts:
            return message(b"I")
        try:
            return self._run(sql, True)
        except EngineError as e:
            return error(str(e))

    def _run(self, sql: str, describe: bool) -> bytes:
        first = sql.split(None, 1)[0].lower().strip(";") if sql.strip() else ""
        if not first:
            return message(b"I")
        if first in QUIET:
            return message(b"C", _z("BEGIN" if first == "start" else first.upper()))
        r = self.engine.sql(sql, "pg")
        if r.code:
            self.failed = not describe
            return error(r.message, "42601" if r.code == 1 else "XX000")
        out = b""
        if r.data is not None:
            out += description(r.columns, r.types) if describe else b""
            out += b"".join([data_row(x, r.columns, r.types) for x in r.data])
        return out + message(b"C", _z(tag_of(sql, r)))

    def _parse(self, body: bytes) -> bytes:
        name, sql, _ = body.split(b"\0", 2)
        self.statements[name.decode()] = sql.decode()
        return message(b"1")

    def _bind(self, body: bytes) -> bytes:
        portal, name, _ = body.split(b"\0", 2)
        if name.decode() not in self.statements:
            raise EngineError(f"prepared statement {name.decode()} does not exist")
        self.portals[portal.decode()] = self.statements[name.decode()]
        return message(b"2")

    def _describe(self, body: bytes) -> bytes:
        name = body[1:-1].decode()
        held = self.statements if body[:1] == b"S" else self.portals
        if name not in held:
            raise EngineError(f"{name} does not exist")
        out = message(b"t", struct.pack(">H", 0)) if body[:1] == b"S" else b""
        sql = held[name]
        word = sql.split(None, 1)[0].lower().strip(";") if sql.strip() else ""
        if word in ("select", "show", "describe", "desc", "explain"):
            df = self.engine.query(sql)  # planned, not run
            return out + description(df.columns, [t for _, t in df.dtypes])
        return out + message(b"n")

    def _execute(self, body: bytes) -> bytes:
        name = body.split(b"\0", 1)[0].decode()
        if name not in self.portals:
            raise EngineError(f"portal {name} does not exist")
        return self._run(self.portals[name], False)

    def _close(self, body: bytes) -> bytes:
        (self.statements if body[:1] == b"S" else self.portals).pop(body[1:-1].decode(), None)
        return message(b"3")


class Server(socketserver.ThreadingTCPServer):
    allow_reuse_address = True
    daemon_threads = True


def serve_pg(engine: Engine, host: str | None = None, port: int | None = None) -> Server:
    own = engine.config.address("pg") or (engine.config.host, 0)
    server = Server((host or own[0], own[1] if port is None else port), Handler)
    server.engine, server.slots = engine, threading.BoundedSemaphore(engine.config.pg_connections)
    return server
