"""Every query over the sample tables, with its SQL twin."""

from __future__ import annotations

import importlib
import pkgutil

from daygrid.catalog import base


def _load() -> None:
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")


def queries():
    _load()
    return dict(base.QUERIES)


def oracles():
    _load()
    return dict(base.ORACLES)


def headline():
    _load()
    return list(base.HEADLINE)
