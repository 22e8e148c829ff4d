"""Every registered query, grouped by the section of the blueprint it covers."""

from __future__ import annotations

from importlib import import_module

from tidemark.catalog.common import Catalog

SECTIONS = (
    "sources_facts",
    "cube",
    "quality",
    "anomalies",
    "customers",
    "operations",
    "verdicts",
    "overview",
)


def all_queries() -> Catalog:
    merged = Catalog()
    for section in SECTIONS:
        merged.merge(import_module(f"tidemark.catalog.{section}").C)
    return merged
