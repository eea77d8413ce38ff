"""The named queries: each has a Spark form and, where SQL can say the same, a text to check it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.shapes import Tables, render

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
BUILDS: dict[str, Callable[[Tables], DataFrame]] = {}


def query(name: str, check: str | None = None):
    """Registers ``build(tables)`` under ``name``; ``check`` may use the shapes as ``$name``."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        BUILDS[name] = build
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if check is not None:
            CHECKS[name] = render(check, "duckdb").strip()
        return build

    return register
