"""Registered checks, collected from the modules of this package."""

from __future__ import annotations

from cadencekit.checks.base import Check

MODULES = ("streams", "scalars", "joins", "reports", "controls", "live", "sinks")


def registry() -> dict[str, Check]:
    from importlib import import_module

    found: dict[str, Check] = {}
    for name in MODULES:
        found.update(import_module(f"cadencekit.checks.{name}").CHECKS)
    return found
