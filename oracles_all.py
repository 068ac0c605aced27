"""Every oracle SQL string, keyed like ``halyard.plans.registry``."""

from __future__ import annotations

import importlib


def all_oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for mod_name, attr in (("oracles", "CUSTOMER_SQL"), ("oracles_series", "SERIES_SQL"),
                           ("oracles_text", "TEXT_SQL"), ("oracles_learn", "LEARN_SQL")):
        try:
            mod = importlib.import_module(mod_name)
        except ModuleNotFoundError as e:
            if e.name == mod_name:
                continue
            raise
        out.update(getattr(mod, attr))
    return dict(sorted(out.items()))
