"""A table kept in hash buckets of a key, of which a batch reads and replaces only those it touches.

Each bucket has two slots. Rows carry the id of the batch that wrote them, and
batch N sees, of each bucket, the slot with the greatest id below N. It writes
its version into the other slot, so a batch that is run again reads what it
read before and replaces its own version. Files and the work of a batch follow
the buckets touched, not the batches run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET, SLOT, BATCH = "_bucket", "_slot", "_batch"


class KeyedTable:
    """The table under `path`, its rows dealt by a hash of column `key` (a null key has a bucket too)."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: T.StructType, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets
        self.columns = schema.fieldNames()
        self._schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in schema.fields],
                                     T.StructField(BATCH, T.LongType()), T.StructField(BUCKET, T.IntegerType()),
                                     T.StructField(SLOT, T.IntegerType())])

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.hash(key.cast(self._schema[self.key].dataType)), F.lit(self.buckets)).cast("int")

    def create(self, rows: DataFrame) -> None:
        """The state before batch 0, in place of whatever is there."""
        (self._dealt(rows).withColumn(SLOT, F.lit(0)).withColumn(BATCH, F.lit(-1).cast("long"))
         .write.mode("overwrite").partitionBy(BUCKET, SLOT).parquet(self.path))

    def touched(self, keys: DataFrame) -> list[int]:
        """The buckets of the keys in the first column of `keys`: no more numbers than buckets."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col(keys.columns[0]))).distinct().collect())

    def read(self, batch_id: int, buckets: list[int] | None = None) -> DataFrame:
        """The rows that batch `batch_id` sees, of some buckets or all."""
        slots = self._slots(batch_id, buckets)
        rows = self._files(buckets).where(F.concat(BUCKET, F.lit(":"), SLOT).isin([f"{b}:{s}" for b, s in slots.items()]))
        return rows.select(*self.columns)

    def replace(self, rows: DataFrame, batch_id: int, buckets: list[int]) -> None:
        """`rows` are all rows of `buckets` from batch `batch_id` on. An emptied bucket can't be told: no rows are deleted."""
        slots = self._slots(batch_id, buckets)
        free = self.spark.createDataFrame([(b, 1 - slots.get(b, 1)) for b in buckets], f"{BUCKET} int, {SLOT} int")  # a row for each bucket
        (self._dealt(rows).join(F.broadcast(free), BUCKET).withColumn(BATCH, F.lit(batch_id).cast("long"))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET, SLOT).parquet(self.path))

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.columns).withColumn(BUCKET, self.bucket(F.col(self.key))).hint("rebalance", BUCKET)

    def _files(self, buckets: list[int] | None) -> DataFrame:
        rows = self.spark.read.schema(self._schema).parquet(self.path)
        return rows if buckets is None else rows.where(F.col(BUCKET).isin(buckets))

    def _slots(self, batch_id: int, buckets: list[int] | None) -> dict[int, int]:
        """The slot of each bucket that a batch sees; every row of a slot has one batch's id."""
        seen = (self._files(buckets).where(F.col(BATCH) < batch_id).groupBy(BUCKET)
                .agg(F.max_by(SLOT, BATCH).alias("slot")).collect())
        return {r[BUCKET]: r["slot"] for r in seen}
