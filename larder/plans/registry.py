"""Query registry: each registered query takes (spark, sf_dir) and returns a DataFrame.

Each one runs a library operator over whole test tables through the bindings.
Money leaves as double and every computed column has a fixed alias, so results
compare with `oracle.py` by name and value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.plans import bindings as b

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str) -> Callable[[Query], Query]:
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def money_out(df: DataFrame) -> DataFrame:
    """Decimals to double at the edge (engines type decimal sums differently)."""
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType)
                       else F.col(f.name) for f in df.schema.fields])


def _t(spark: SparkSession, sf_dir: str) -> b.Tables:
    return b.Tables(spark, sf_dir)
