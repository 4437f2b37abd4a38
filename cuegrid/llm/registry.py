"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

import importlib
import pkgutil

import cuegrid.llm as _here

QUERIES: dict = {}
ORACLES: dict = {}
for _found in sorted(x.name for x in pkgutil.iter_modules(_here.__path__) if x.name.startswith("op")):
    _module = importlib.import_module(f"cuegrid.llm.{_found}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
