"""Operators that prepare text corpora for training: search, tokens, mixing, language, quality, duplicates, secrets."""

from __future__ import annotations

import importlib
import pkgutil


def _load() -> None:
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")


def queries():
    from daygrid.llm import catalog

    _load()
    return dict(catalog.QUERIES)


def oracles():
    from daygrid.llm import catalog

    _load()
    return dict(catalog.ORACLES)
