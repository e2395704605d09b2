"""JSON packets over TCP: an 11-byte header (magic, version, type, length; big-endian) before each payload."""

from __future__ import annotations

import json
import socket
import socketserver
import struct

from ..session import Engine, Response

#: The packet format.
MAGIC, VERSION, MOST_BYTES = 0x57494442, 1, 16 * 1024 * 1024
QUERY, WRITE, PING, RESPONSE = 1, 2, 3, 10
HEADER = struct.Struct(">IHBI")


class BadPacket(Exception):
    pass


def encode(kind: int, payload: dict) -> bytes:
    raw = json.dumps(payload, ensure_ascii=False).encode()
    return HEADER.pack(MAGIC, VERSION, kind, len(raw)) + raw


def decode(stream) -> tuple[int, bytes] | None:
    """The next packet of a stream, None at its end."""
    head = stream.read(HEADER.size)
    if not head:
        return None
    if len(head) < HEADER.size:
        raise BadPacket("cut short")
    magic, version, kind, n = HEADER.unpack(head)
    if magic != MAGIC or version != VERSION or n > MOST_BYTES:
        raise BadPacket("not a packet of this protocol")
    raw = stream.read(n)
    if len(raw) < n:
        raise BadPacket("cut short")
    return kind, raw


def answer(engine: Engine, kind: int, raw: bytes) -> Response:
    if kind == PING:
        return engine.ping()
    if kind not in (QUERY, WRITE):
        return Response(-1, f"unknown packet type {kind}")
    try:
        body = json.loads(raw or b"{}")
        if kind == QUERY:
            return engine.sql(str(body.get("sql", "")), "tcp")
        return engine.submit(str(body.get("table", "")), body.get("rows") or [], "tcp")
    except (ValueError, AttributeError) as e:
        return Response(-1, f"request is no JSON object: {e}")


class Handler(socketserver.StreamRequestHandler):
    timeout = 30

    def handle(self) -> None:
        try:
            while (packet := decode(self.rfile)) is not None:
                self.wfile.write(encode(RESPONSE, answer(self.server.engine, *packet).as_dict()))
        except (BadPacket, OSError):
            pass


class Server(socketserver.ThreadingTCPServer):
    allow_reuse_address = True
    daemon_threads = True


def serve_tcp(engine: Engine, host: str | None = None, port: int | None = None) -> Server:
    own = engine.config.address("tcp") or (engine.config.host, 0)
    server = Server((host or own[0], own[1] if port is None else port), Handler)
    server.engine = engine
    return server


class Client:
    """A connection to a TCP server."""

    def __init__(self, host: str, port: int, timeout: float = 60):
        self.socket = socket.create_connection((host, port), timeout)
        self.stream = self.socket.makefile("rb")

    def _ask(self, kind: int, payload: dict) -> dict:
        self.socket.sendall(encode(kind, payload))
        found = decode(self.stream)
        if found is None:
            raise BadPacket("closed")
        return json.loads(found[1])

    def query(self, sql: str) -> dict:
        return self._ask(QUERY, {"sql": sql})

    def write(self, table: str, rows: list[dict]) -> dict:
        return self._ask(WRITE, {"table": table, "rows": rows})

    def ping(self) -> dict:
        return self._ask(PING, {})

    def close(self) -> None:
        self.stream.close()
        self.socket.close()
