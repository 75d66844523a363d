"""All registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

PARTS = ("points", "maps", "series", "gestures", "ingest")


def queries() -> dict:
    return {k: f for part in PARTS for k, f in import_module(f"dopplerlake.plans.{part}").QUERIES.items()}


def oracle_sql() -> dict:
    return {k: q for part in PARTS for k, q in import_module(f"dopplerlake.plans.{part}").SQL.items()}
