"""Registry of queries: name -> (builder, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self) -> None:
        self.builders: dict[str, Builder] = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None) -> Callable[[Builder], Builder]:
        """Decorator: register a builder under a name, with its oracle."""

        def register(builder: Builder) -> Builder:
            if name in self.builders:
                raise ValueError(f"query {name} is registered twice")
            self.builders[name] = builder
            if sql is not None:
                self.oracles[name] = sql
            return builder

        return register


CORE = Registry()
