"""Registered queries, grouped by area."""

from __future__ import annotations


def all_registries():
    import importlib

    return [importlib.import_module(f"shelfwise.plans.{area}").registry for area in AREAS]


AREAS = ("mirror", "catalogue", "cellar", "streams")
