"""All registered queries, keyed by SURVEY section-2 operator id."""

from __future__ import annotations

import importlib

_MODULES = (
    "halyard.plans.registry_customers",
    "halyard.plans.registry_series",
    "halyard.plans.registry_text",
    "halyard.plans.registry_learn",
)


def all_queries() -> dict:
    out = {}
    for m in _MODULES:
        try:
            mod = importlib.import_module(m)
        except ModuleNotFoundError as e:  # module not written yet
            if e.name == m:
                continue
            raise
        out.update(mod.QUERIES)
    return dict(sorted(out.items()))
