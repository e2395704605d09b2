"""Servers before an engine: HTTP, length-prefixed JSON over TCP, and the PostgreSQL wire protocol."""
