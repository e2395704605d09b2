"""Upkeep in the background: due compactions and removal of files that no manifest names."""

from __future__ import annotations

import threading

from ..errors import EngineError


class Scheduler:
    def __init__(self, engine, compact_every: float = 60.0, clean_every: float = 600.0):
        self.engine, self.every = engine, {"compact": compact_every, "clean": clean_every}
        self.counts, self.last_error = {"compact": 0, "clean": 0}, ""
        self.stop_, self.threads = threading.Event(), []

    def start(self) -> None:
        self.stop_.clear()
        # An interval of 0 leaves that upkeep out.
        self.threads = [threading.Thread(target=self._loop, args=(k,), daemon=True) for k, seconds in self.every.items() if seconds]
        for t in self.threads:
            t.start()

    def stop(self) -> None:
        self.stop_.set()
        for t in self.threads:
            t.join()

    def _loop(self, kind: str) -> None:
        while not self.stop_.wait(self.every[kind]):
            self.run(kind)

    def run(self, kind: str) -> None:
        for t in self.engine.keyed_tables():
            try:
                t.compact_if_due() if kind == "compact" else t.clean()
                self.counts[kind] += 1
            except EngineError as e:
                self.last_error = str(e)
