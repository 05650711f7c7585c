"""Helpers shared by the operators: shared-folder tables, appended columns, words."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larder.session import checkpoint_dir

# Fixed by the contracts: 0x20 and 0x09-0x0D part words. bytes.split() parts at exactly these.
SPACE_CLASS = r"[^\x20\x09-\x0D]+"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared checkpoint folder and read it back.

    Cuts the lineage, survives the loss of executors, and runs the work above
    it once however often the result is read.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table written by `materialise` that nothing reads any more."""
    path = getattr(df, "_llm_path", None)
    if path:
        sc = df.sparkSession.sparkContext
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(names: list[str], taken: list[str]) -> list[str]:
    """`names`, each with underscores before it until no column is called so."""
    low = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in low:
            n = "_" + n
        low.add(n.lower())
        out.append(n)
    return out


def first_by_hash(rows: DataFrame, order: Column, n: int, name: str) -> DataFrame:
    """The `n` of the distinct `rows` that come first by the 64-bit hash `order`, then by value.

    Sorting all and taking n would send n rows of every partition to one place.
    Here the hash is cut first, for about 2n rows over all partitions, and only
    these are written, made distinct and sorted; the cut is widened where too
    few pass. So what arrives in one place follows n and not the partitions.
    """
    hash_ = fresh(["llm_order"], rows.columns)[0]
    hashed = rows.withColumn(hash_, order)
    share = min(1.0, 2 * n / max(1, hashed.agg(F.approx_count_distinct(hash_)).first()[0]))
    while True:
        cut = -(1 << 63) + int(share * (1 << 64)) - 1
        some = materialise((hashed if share >= 1 else hashed.where(F.col(hash_) <= cut)).distinct(), name)
        if share >= 1 or some.count() >= n:
            return some.orderBy(hash_, *rows.columns).limit(n).select(*rows.columns)
        release(some)
        share = min(1.0, 4 * share)


def as_bytes(col: pa.Array) -> list[bytes | None]:
    """A string column's UTF-8 values."""
    return col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary()).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches cut small, so that a task holds few whole texts as Python objects."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def append_columns(df: DataFrame, fields: list[T.StructField],
                   fn: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.RecordBatch, list[pa.Array]]]],
                   ) -> tuple[DataFrame, list[str]]:
    """`df` with the columns that `fn` computes for each Arrow batch, and their names.

    No shuffle: rows pass through. A name that `df` has already gets underscores.
    """
    names = fresh([f.name for f in fields], df.columns)
    schema = T.StructType(df.schema.fields + [T.StructField(n, f.dataType, True) for n, f in zip(names, fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, cols in fn(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, schema), names
