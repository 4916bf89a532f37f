"""Turns a check's SQL into one statement by prepending the derived tables it mentions."""

from __future__ import annotations

import re

from loanloom.fixtures import VIEWS


def view_sql(name: str) -> str:
    spec = VIEWS[name]
    source = spec.source
    if spec.join:
        other, left, right = spec.join
        source = f"{source} JOIN {other} ON {left} = {right}"
    if spec.repeat:
        source = f"(SELECT *, unnest(range(0, CAST({spec.repeat} AS INT) + 1)) AS n FROM {source}) r"
    if spec.prepare:
        source = f"(SELECT *, {', '.join(spec.prepare)} FROM {source}) p"
    columns = ", ".join(c.format(q='"', ntz="TIMESTAMP") for c in spec.columns)
    return f"SELECT {columns} FROM {source}"


def with_views(body: str, **parts: str) -> str:
    """`body` with CTEs for the derived tables and named `parts` it refers to, directly or not."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", text):
            if name in needed or name not in VIEWS and name not in parts:
                continue
            if name in parts:
                visit(parts[name])
            needed.append(name)

    visit(body)
    if not needed:
        return body
    ctes = ",\n".join(f"{n} AS ({parts[n] if n in parts else view_sql(n)})" for n in needed)
    return f"WITH {ctes}\n{body}"
