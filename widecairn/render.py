"""Results as text: pretty, vertical, json or csv."""

from __future__ import annotations

import csv
import io
import json
import unicodedata

from .session import Response

FORMATS = ("pretty", "vertical", "json", "csv")


def cell(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    return str(v)


def width(s: str) -> int:
    """Columns on a terminal: wide characters take two."""
    return sum(2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def render(response: Response, kind: str = "pretty") -> str:
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    if response.code:
        return f"ERROR {response.code}: {response.message}"
    if response.data is None:
        return response.message or f"OK, {response.rows} rows affected"
    rows, columns = response.data, response.columns or list(response.data[0] if response.data else ())
    if kind == "json":
        return json.dumps(rows, ensure_ascii=False, indent=2)
    if kind == "csv":
        out = io.StringIO()
        w = csv.writer(out, lineterminator="\n")
        w.writerow(columns)
        w.writerows([["" if r[c] is None else cell(r[c]) for c in columns] for r in rows])
        return out.getvalue()
    cells = [[cell(r[c]) for c in columns] for r in rows]
    if kind == "vertical":
        names = max(map(width, columns), default=0)
        return "\n".join(line for k, r in enumerate(cells, 1) for line in [f"*** row {k} ***", *(f"{' ' * (names - width(c))}{c}: {v}" for c, v in zip(columns, r))])
    wide = [max([width(c), *(width(r[i]) for r in cells)]) for i, c in enumerate(columns)]
    rule = "+" + "+".join("-" * (w + 2) for w in wide) + "+"
    line = lambda r: "|" + "|".join(f" {v}{' ' * (w - width(v))} " for v, w in zip(r, wide)) + "|"
    return "\n".join([rule, line(columns), rule, *map(line, cells), rule, f"({len(rows)} rows)"])
