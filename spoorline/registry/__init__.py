"""All registered queries and, where SQL can state them, their reference results."""

from __future__ import annotations

from importlib import import_module

MODULES = ("telemetry", "statements", "evaluation", "corpus", "streams", "live")


def _collect(name: str) -> dict:
    out = {}
    for module in MODULES:
        out.update(getattr(import_module(f"spoorline.registry.{module}"), name))
    return out


def all_queries() -> dict:
    return _collect("QUERIES")


def all_oracles() -> dict:
    return _collect("ORACLE")
