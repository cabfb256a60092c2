"""Registered queries: each runs a plan over the stand-in views of whole tables, with its SQL check."""

from . import blends, games, slates, stats


def _collect():
    found = {}
    for module in (games, stats, blends, slates):
        for name, entry in module.QUERIES.items():
            if name in found:
                raise ValueError(f"query {name} registered twice")
            found[name] = entry
    return found


ALL = _collect()
