"""All registered queries of the library's own operators, gathered from the plan modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("rejects", "witness", "retrieval", "structure", "audit", "extras", "rendering", "quality", "samples", "suite", "inventory")
FLAGSHIP = "witness_census_a2m1"


def _gather(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        part = getattr(import_module(f"ostraka.plans.{name}"), what)
        if clash := out.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _gather("QUERIES")


def sql() -> dict[str, str]:
    return _gather("SQL")
