"""Named queries over the given tables, with reference SQL where SQL can express them."""

from __future__ import annotations

import importlib

_MODULES = ("bindings", "decisions", "messages", "anchors", "log", "incremental")


def _load():
    for name in _MODULES:
        importlib.import_module(f"{__name__}.{name}")
    from . import core
    return core


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
