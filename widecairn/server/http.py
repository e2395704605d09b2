"""HTTP: POST /query, /write, /admin/flush, /admin/compact; GET /health, /metrics, /admin/stats, /admin/slow-queries."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import urlsplit

from ..errors import EngineError
from ..session import Engine

#: Most bytes of a request's body.
MOST_BYTES = 16 * 1024 * 1024
POST = ("/query", "/write", "/admin/flush", "/admin/compact")
GET = ("/health", "/metrics", "/admin/stats", "/admin/slow-queries")


class BadRequest(Exception):
    pass


def _failure(message: str) -> dict:
    return {"code": -1, "message": message}


class Handler(BaseHTTPRequestHandler):
    protocol_version = "HTTP/1.1"

    @property
    def engine(self) -> Engine:
        return self.server.engine

    def log_message(self, *_) -> None:
        pass

    def _send(self, status: int, body, kind: str = "application/json") -> None:
        raw = body.encode() if isinstance(body, str) else json.dumps(body, ensure_ascii=False).encode()
        path = urlsplit(self.path).path
        self.engine.counts[f'http_requests_total{{endpoint="{path if path in POST + GET else "other"}",status="{status // 100}xx"}}'] += 1
        self.send_response(status)
        self.send_header("Content-Type", kind)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def _body(self) -> dict:
        n = int(self.headers.get("Content-Length") or 0)
        if n > MOST_BYTES:
            self.close_connection = True
            raise BadRequest("request body is too large")
        try:
            out = json.loads(self.rfile.read(n) or b"{}")
        except ValueError as e:
            raise BadRequest(f"request body is no JSON: {e}") from None
        if not isinstance(out, dict):
            raise BadRequest("request body is no JSON object")
        return out

    def _route(self, method: str) -> None:
        path = urlsplit(self.path).path
        own = POST if method == "POST" else GET
        if path not in POST + GET:
            return self._send(404, _failure(f"unknown endpoint {path}"))
        if path not in own:
            return self._send(405, _failure(f"{path} takes {'GET' if method == 'POST' else 'POST'} only"))
        try:
            if path in ("/query", "/write"):
                body = self._body()
                if path == "/query":
                    out = self.engine.sql(str(body.get("sql", "")), "http")
                else:
                    rows = body.get("rows") or []
                    if not isinstance(rows, list) or not all(isinstance(r, dict) for r in rows):
                        raise BadRequest("rows are no list of objects")
                    out = self.engine.submit(str(body.get("table", "")), rows, "http")
                return self._send(200 if out.code == 0 else 400, out.as_dict())
            if path in ("/admin/flush", "/admin/compact"):
                self._body()
                (self.engine.flush if path == "/admin/flush" else self.engine.compact)()
                return self._send(200, {"code": 0, "message": "ok", "affected": len(self.engine.catalog.names())})
            if path == "/health":
                return self._send(200, {"status": "ok", "timestamp": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())})
            if path == "/metrics":
                lines = [f"widecairn_{k} {v}" for k, v in sorted(self.engine.metrics().items())]
                return self._send(200, "\n".join(lines) + "\n", "text/plain; version=0.0.4")
            if path == "/admin/stats":
                return self._send(200, {"code": 0, **self.engine.stats()})
            return self._send(200, {"code": 0, "entries": self.engine.slow_queries()})
        except BadRequest as e:
            self._send(400, _failure(str(e)))
        except EngineError as e:
            self._send(500, _failure(str(e)))

    def do_GET(self) -> None:
        self._route("GET")

    def do_POST(self) -> None:
        self._route("POST")


def serve_http(engine: Engine, host: str | None = None, port: int | None = None) -> ThreadingHTTPServer:
    """A server that is bound but not running; port 0 takes a free one."""
    own = engine.config.address("http") or (engine.config.host, 0)
    server = ThreadingHTTPServer((host or own[0], own[1] if port is None else port), Handler)
    server.daemon_threads = True
    server.engine = engine
    return server
