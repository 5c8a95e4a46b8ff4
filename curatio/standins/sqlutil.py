"""Helpers that write the DuckDB side of the oracle queries."""

from __future__ import annotations

import re


def lit(s: str) -> str:
    """SQL string literal (newlines kept verbatim, quotes doubled)."""
    return "'" + s.replace("'", "''") + "'"


def render(template: str, **slots: str) -> str:
    """DuckDB expression of ``template.format(**slots)`` with SQL slot expressions."""
    parts = re.split(r"\{(\w+)\}", template)
    out = []
    for i, p in enumerate(parts):
        if i % 2 == 0:
            if p:
                out.append(lit(p))
        else:
            out.append(f"CAST(({slots[p]}) AS VARCHAR)")
    return "(" + " || ".join(out) + ")" if out else "''"


def case(on: str, values: dict[str, str]) -> str:
    return "CASE " + " ".join(f"WHEN {on} = {lit(k)} THEN {v}" for k, v in values.items()) + " END"


def arr(values: list) -> str:
    return "[" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in values) + "]"


def py_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\x0B\x1c-\x1f\x85\p{{Z}}]+|[\s\x0B\x1c-\x1f\x85\p{{Z}}]+\z', '', 'g')"


def nodot(x: str) -> str:
    return rf"regexp_replace({x}, '\.\z', '')"


def last_after(x: str, d: str) -> str:
    """Spark ``substring_index(x, d, -1)``."""
    return f"list_extract(string_split({x}, {d}), -1)"


def first_before(x: str, d: str) -> str:
    """Spark ``substring_index(x, d, 1)``."""
    return f"split_part({x}, {d}, 1)"
