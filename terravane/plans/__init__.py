"""Registered queries, grouped by theme."""

from __future__ import annotations

import importlib

from terravane.plans.registry import CATALOGUE, Query

THEMES = ("series", "fused", "spatial", "served", "texts", "quality", "ingest", "learned")


def catalogue() -> dict[str, Query]:
    for theme in THEMES:
        importlib.import_module(f"terravane.plans.{theme}")
    return CATALOGUE
