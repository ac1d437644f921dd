"""Registered queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

import importlib

MODULES = ("detection", "cleaning", "encoding", "numbers", "reduction", "runs", "text", "learning")


def all_checks() -> dict:
    found: dict = {}
    for name in MODULES:
        found.update(importlib.import_module(f"checks.{name}").CHECKS)
    return found
