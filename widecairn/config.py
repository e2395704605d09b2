"""Settings: defaults, then a file, then keyword arguments."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, fields
from pathlib import Path


@dataclass
class Config:
    root: str | None = None
    host: str = "127.0.0.1"
    http_port: int = 8080
    tcp_port: int = 9090
    pg_port: int = 5432
    pg_connections: int = 256
    #: Addresses of their own in place of host and port; an empty pg_addr leaves that server out.
    http_addr: str | None = None
    tcp_addr: str | None = None
    pg_addr: str | None = None
    slow_query_ms: int = 100
    slow_query_entries: int = 100
    slow_query_bytes: int = 4096
    #: Rows written within so many milliseconds share a commit; 0: every write has its own.
    group_commit_ms: int = 20
    #: Rows that point reads keep.
    cached_rows: int = 10_000
    scheduler: bool = True
    compact_seconds: float = 10.0
    clean_seconds: float = 30.0

    def __post_init__(self):
        for n in ("http_port", "tcp_port", "pg_port"):
            if not 0 <= getattr(self, n) <= 65535:
                raise ValueError(f"{n} is no port")
        for n in ("http_addr", "tcp_addr", "pg_addr"):
            if getattr(self, n):
                split_address(getattr(self, n))
        if self.slow_query_ms < 0 or self.slow_query_entries < 0 or self.slow_query_bytes < 1 or self.pg_connections < 1:
            raise ValueError("limits are positive")
        if self.group_commit_ms < 0 or self.cached_rows < 0 or self.compact_seconds < 0 or self.clean_seconds < 0:
            raise ValueError("intervals and sizes are not negative")

    def address(self, server: str) -> tuple[str, int] | None:
        """Host and port of the http, tcp or pg server; None if it is left out."""
        given = getattr(self, f"{server}_addr")
        if given is None:
            return self.host, getattr(self, f"{server}_port")
        return split_address(given) if given else None

    @classmethod
    def load(cls, path: str | None = None, **given) -> Config:
        """A JSON file or lines of ``key: value``, with sections (``NESTED``) or without; unknown keys are errors."""
        found = {}
        if path:
            text = Path(path).read_text()
            found = settings(json.loads(text) if text.lstrip().startswith("{") else read_lines(text))
        types = {f.name: f.type for f in fields(cls)}
        for k in found:
            if k not in types:
                raise ValueError(f"unknown setting {k}")
        cast = {k: int(v) if types[k] == "int" else float(v) if types[k] == "float" else (v if isinstance(v, bool) else truth(v)) if types[k] == "bool" else v for k, v in found.items()}
        return cls(**cast | {k: v for k, v in given.items() if v is not None})


#: Settings of a sectioned file: the setting that each stands for, or None if files and commits make it needless here.
NESTED = {
    "server.tcp_addr": "tcp_addr",
    "server.http_addr": "http_addr",
    "server.pg_addr": "pg_addr",
    "server.slow_query_threshold_ms": "slow_query_ms",
    "server.slow_query_max_entries": "slow_query_entries",
    "storage.data_dir": "root",
    "storage.max_memtable_size": None,
    "scheduler.enabled": "scheduler",
    "scheduler.flush_interval": None,
    "scheduler.compact_interval": "compact_seconds",
    "scheduler.wal_clean_interval": "clean_seconds",
    "scheduler.wal_clean_threshold": None,
}


def settings(found: dict) -> dict:
    """Plain settings of a file that may have sections."""
    out = {}
    for k, v in found.items():
        if not isinstance(v, dict):
            out[k] = v
            continue
        for name, x in v.items():
            if f"{k}.{name}" not in NESTED:
                raise ValueError(f"unknown setting {k}.{name}")
            own = NESTED[f"{k}.{name}"]
            if own:
                out[own] = seconds(x) if own.endswith("_seconds") else x
    return out


def read_lines(text: str) -> dict:
    """``key: value`` lines; a key without a value begins a section of the indented lines below it."""
    out: dict = {}
    section = None
    for line in text.splitlines():
        plain = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not plain.strip():
            continue
        k, colon, v = plain.strip().partition(":")
        if not colon:
            raise ValueError(f"no setting: {plain.strip()}")
        v = v.strip()
        if not v and not plain[0].isspace():
            section = out.setdefault(k, {})
        else:
            (section if plain[0].isspace() and section is not None else out)[k] = v.strip("\"'")
    return out


def truth(x: str) -> bool:
    if str(x).lower() not in ("true", "false", "yes", "no", "on", "off"):
        raise ValueError(f"{x} is neither true nor false")
    return str(x).lower() in ("true", "yes", "on")


def seconds(x) -> float:
    """A number of seconds, or amounts with units: 500ms, 5s, 1m30s, 2h."""
    if isinstance(x, (int, float)) or re.fullmatch(r"[0-9.]+", str(x)):
        return float(x)
    parts = re.findall(r"([0-9.]+)(ms|us|ns|s|m|h)", x)
    if "".join(n + u for n, u in parts) != x:
        raise ValueError(f"{x} is no duration")
    return sum(float(n) * {"ns": 1e-9, "us": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}[u] for n, u in parts)


def split_address(x: str) -> tuple[str, int]:
    host, colon, port = x.rpartition(":")
    if not colon or not port.isdigit() or int(port) > 65535:
        raise ValueError(f"{x} is no address")
    return host or "0.0.0.0", int(port)
