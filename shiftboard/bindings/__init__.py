"""Each library operation bound to the given tables, with SQL that checks it."""

from __future__ import annotations

import importlib
import pkgutil

from . import registry


def load():
    """Import every binding module once and return the filled registry."""
    for module in pkgutil.iter_modules(__path__):
        if module.name != "registry":
            importlib.import_module(f"{__name__}.{module.name}")
    return registry
