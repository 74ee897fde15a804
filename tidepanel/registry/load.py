"""Import every registry module once and hand out the collected queries."""

from __future__ import annotations

import importlib
import pkgutil

import tidepanel.registry as package
from tidepanel.registry import base


def _load() -> None:
    for module in sorted(m.name for m in pkgutil.iter_modules(package.__path__)):
        if module not in ("base", "load"):
            importlib.import_module(f"tidepanel.registry.{module}")


def queries():
    _load()
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return {name: base.assemble(sql) for name, sql in base.ORACLES.items()}
