"""All registered queries."""

from __future__ import annotations

import importlib

from .registry import ORACLES, QUERIES

MODULES = ("detect", "decide", "rewrite", "hidden", "evaluate", "measures", "ingest", "records", "access", "streams", "flagship")

for _name in MODULES:
    importlib.import_module(f"{__package__}.{_name}")


def queries():
    return dict(QUERIES)


def oracles():
    return dict(ORACLES)
