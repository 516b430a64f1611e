"""A catalogue of queries: name, function, and SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Catalogue:
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        """Register the decorated function; a name can be taken once."""

        def keep(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"query {name} is registered already")
            self.queries[name] = f
            if sql is not None:
                self.sql[name] = sql
            return f

        return keep
