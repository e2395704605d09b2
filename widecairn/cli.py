"""A shell over an engine in this process or over a server: python -m widecairn.cli [--root DIR] [--tcp HOST:PORT] [--serve]."""

from __future__ import annotations

import argparse
import json
import sys
import threading
import urllib.error
import urllib.request

from .config import Config
from .render import FORMATS, render
from .session import Engine, Response

HELP = "\\q quit   \\h help   \\status ping   \\addrs addresses   \\use TCP|HTTP|LOCAL [host:port]   \\format pretty|vertical|json|csv"


class Shell:
    def __init__(self, engine: Engine | None = None, addresses: dict[str, str] | None = None, out=None):
        self.engine, self.addresses, self.kind = engine, addresses or {}, "pretty"
        self.mode = "LOCAL" if engine else "TCP"
        self.out = out or sys.stdout

    def ask(self, sql: str) -> Response:
        if self.mode == "LOCAL":
            return self.engine.sql(sql, "cli")
        host, _, port = self.addresses.get(self.mode, "").rpartition(":")
        if self.mode == "TCP":
            from .server.tcp import Client

            c = Client(host, int(port))
            try:
                d = c.query(sql)
            finally:
                c.close()
        else:
            request = urllib.request.Request(f"http://{host}:{port}/query", json.dumps({"sql": sql}).encode())
            try:
                d = json.load(urllib.request.urlopen(request))
            except urllib.error.HTTPError as e:
                d = json.load(e)
        return Response(d.get("code", 0), d.get("message", ""), d.get("data") or ([] if d.get("columns") else None), d.get("rows", 0), d.get("columns", []))

    def line(self, text: str) -> bool:
        """One line of input; False ends the shell."""
        words = text.strip().rstrip(";").split()
        if not words:
            return True
        if words[0] in ("\\q", "exit", "quit"):
            return False
        if words[0] == "\\h":
            print(HELP, file=self.out)
        elif words[0] == "\\status":
            print(f"{self.mode} {self.addresses.get(self.mode, '')} {'ok' if self.ask('SHOW TABLES').code == 0 else 'failed'}".strip(), file=self.out)
        elif words[0] == "\\addrs":
            print("\n".join(f"{k} {v}" for k, v in sorted(self.addresses.items())) or "none", file=self.out)
        elif words[0] == "\\use" and len(words) > 1 and words[1].upper() in ("TCP", "HTTP", "LOCAL"):
            self.mode = words[1].upper()
            if len(words) > 2:
                self.addresses[self.mode] = words[2]
            print(f"using {self.mode}", file=self.out)
        elif words[0] == "\\format" and len(words) == 2 and words[1] in FORMATS:
            self.kind = words[1]
        elif words[0].startswith("\\"):
            print(f"unknown command; {HELP}", file=self.out)
        else:
            print(render(self.ask(text), self.kind), file=self.out)
        return True

    def run(self, lines) -> None:
        """Statements end with a semicolon; commands with the line."""
        held = ""
        for text in lines:
            held += text
            if held.lstrip().startswith("\\") or held.rstrip().endswith(";") or held.strip() in ("exit", "quit"):
                if not self.line(held):
                    return
                held = ""
        if held.strip():
            self.line(held)


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    from .server.http import serve_http
    from .server.pgwire import serve_pg
    from .server.tcp import serve_tcp
    from .sources.scheduler import Scheduler

    p = argparse.ArgumentParser(prog="widecairn")
    p.add_argument("--root")
    p.add_argument("--config")
    p.add_argument("--tcp")
    p.add_argument("--http")
    p.add_argument("--serve", action="store_true")
    a = p.parse_args(argv)
    addresses = {k: v for k, v in (("TCP", a.tcp), ("HTTP", a.http)) if v}
    if addresses and not a.serve:
        shell = Shell(None, addresses)
        shell.mode = "TCP" if a.tcp else "HTTP"
        return shell.run(sys.stdin)
    config = Config.load(a.config, root=a.root)
    engine = Engine(SparkSession.builder.appName("widecairn").getOrCreate(), config=config)
    if a.serve:
        servers = {k.upper(): serve(engine) for k, serve in (("http", serve_http), ("tcp", serve_tcp), ("pg", serve_pg)) if config.address(k)}
        for s in servers.values():
            threading.Thread(target=s.serve_forever, daemon=True).start()
        addresses = {k: f"{s.server_address[0]}:{s.server_address[1]}" for k, s in servers.items()}
    scheduler = Scheduler(engine, config.compact_seconds, config.clean_seconds)
    if a.serve and config.scheduler:
        scheduler.start()
    try:
        Shell(engine, addresses).run(sys.stdin)
    finally:
        scheduler.stop()
        engine.close()


if __name__ == "__main__":
    main()
