"""Named queries, each with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
#: Modules that register queries when they are imported.
MODULES = ["kinloom.plans.matching", "kinloom.plans.pairs", "kinloom.plans.decisions", "kinloom.plans.texts", "kinloom.plans.retrieval", "kinloom.plans.models", "kinloom.plans.more", "kinloom.plans.records", "kinloom.plans.rescue"]


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)
    oracles: dict[str, str] = field(default_factory=dict)

    def query(self, oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """Register the function under its name; oracle is None where SQL cannot express it."""

        def add(f: Query) -> Query:
            key = name or f.__name__
            if key in self.queries:
                raise ValueError(f"{key} is registered twice")
            self.queries[key] = f
            if oracle:
                self.oracles[key] = oracle
            return f

        return add


REGISTRY = Registry()


def load() -> Registry:
    """The registry with all modules imported."""
    for name in MODULES:
        importlib.import_module(name)
    return REGISTRY
