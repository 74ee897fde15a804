"""Registration of runnable queries and their independent SQL statements."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidepanel.session import pin_session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SHARED: dict[str, str] = {}


def shared(**parts: str) -> None:
    """Named SQL fragments; a statement pulls in the ones it mentions."""
    for name, sql in parts.items():
        if name in SHARED:
            raise ValueError(f"fragment defined twice: {name}")
        SHARED[name] = sql.strip()


def assemble(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str, trail: tuple[str, ...]) -> None:
        for name in sorted(set(re.findall(r"\bt_\w+", text))):
            if name in SHARED and name not in needed:
                if name in trail:
                    raise ValueError(f"fragment cycle at {name}")
                visit(SHARED[name], (*trail, name))
                needed.append(name)

    visit(sql, ())
    if not needed:
        return sql.strip()
    head = ",\n".join(f"{name} AS MATERIALIZED (\n{SHARED[name]}\n)" for name in needed)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head},\n{body[5:]}"
    return f"WITH {head}\n{body}"


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query defined twice: {name}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(pin_session(spark), folder)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r(expr: str, alias: str, digits: int = 6) -> str:
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0.0 AS {alias}"
