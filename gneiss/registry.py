"""name -> query and name -> DuckDB oracle of the reference operators, and named choices of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: kind -> alias -> builder: the extension points (filters, rankers, collators, encoders)
CHOICES: dict[str, dict[str, Callable]] = {}


def query(name: str, sql: str | None = None):
    """Registers a query under a name, with its oracle if SQL can express it."""

    def put(f):
        if name in QUERIES:
            raise ValueError(f"query {name} is already there")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def choice(kind: str, alias: str):
    def put(f):
        CHOICES.setdefault(kind, {})[alias] = f
        return f

    return put


def choose(kind: str, alias: str) -> Callable:
    try:
        return CHOICES[kind][alias]
    except KeyError:
        raise ValueError(f"no {kind} is called {alias}; there are {sorted(CHOICES.get(kind, {}))}") from None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
