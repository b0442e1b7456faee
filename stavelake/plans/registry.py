"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stavelake.plans.bindings import Bindings, with_bindings

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Registers a function of the bound tables under a name of its own. ``oracle`` may use the bound views by name."""

    def register(build: Callable[[Bindings], DataFrame]) -> Callable[[Bindings], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"a query named {name} exists")
        QUERIES[name] = lambda spark, sf_dir: build(Bindings(spark, sf_dir))
        if oracle:
            ORACLE_SQL[name] = with_bindings(oracle)
        return build

    return register
