"""The register of queries. A text in the common ground of Spark SQL and DuckDB serves as both plan and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rasterloom.sources.screens import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its DuckDB text if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def both(name: str, text: str, tables: tuple[str, ...] = (), ranges: tuple[int, ...] = (), **fixed: tuple[str, list[tuple]]) -> None:
    """Registers one text for Spark and DuckDB.

    {t}: a table of the input; {rN}: the column id from 0 to N - 1; fixed: {name} from (schema, rows).
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: table(spark, sf_dir, t) for t in tables} | {f"r{n}": spark.range(n) for n in ranges}
        frames |= {k: spark.createDataFrame(rows, schema) for k, (schema, rows) in fixed.items()}
        return spark.sql(text, **frames)

    QUERIES[name] = run
    duck = {t: t for t in tables} | {f"r{n}": f"(SELECT range AS id FROM range({n}))" for n in ranges}
    duck |= {k: values(schema, rows) for k, (schema, rows) in fixed.items()}
    SQL[name] = text.format(**duck)


def values(schema: str, rows: list[tuple]) -> str:
    """Rows as a DuckDB table expression with typed columns."""
    cols = [c.strip().rsplit(" ", 1) for c in schema.split(",")]
    kinds = {"int": "INTEGER", "long": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    lit = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return "(SELECT " + ", ".join(f"{c}::{kinds[k]} AS {c}" for c, k in cols) + f" FROM (VALUES {body}) v({', '.join(c for c, _ in cols)}))"
