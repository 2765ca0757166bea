"""Named queries over the standard tables."""

import importlib
import pkgutil


def load_queries():
    """Import every ``*_queries`` module once; return the queries and their SQL counterparts."""
    from shoal.plans import registry

    for module in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        if module.endswith("_queries"):
            importlib.import_module(f"{__name__}.{module}")
    return registry.QUERIES, registry.ORACLES
