"""Op 1: typed table reads.

Reads always pass an explicit schema (no inference, no footer sampling), and
callers select the columns they use right after, so Catalyst prunes the Parquet
`ReadSchema` and pushes row filters into the scan.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import types as T

from larder.schemas import DOMAIN


def read_table(spark: SparkSession, base_dir: str, name: str, columns: Iterable[str] | None = None,
               schemas: dict[str, T.StructType] = DOMAIN) -> DataFrame:
    """A table of the kitchen, or of other `schemas`; a name without a schema is read as stored."""
    schema = schemas.get(name)
    path = f"{base_dir.rstrip('/')}/{name}.parquet"
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    return df.select(*columns) if columns else df


def load_tables(spark: SparkSession, base_dir: str, names: Iterable[str] | None = None,
                columns: dict[str, list[str]] | None = None,
                schemas: dict[str, T.StructType] = DOMAIN) -> dict[str, DataFrame]:
    """Lazily bind each table; nothing is read until an action runs."""
    names = list(names) if names else list(schemas)
    columns = columns or {}
    return {n: read_table(spark, base_dir, n, columns.get(n), schemas) for n in names}
