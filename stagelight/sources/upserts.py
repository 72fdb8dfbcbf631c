"""A keyed table as Parquet in parts by the hash of its keys: an upsert reads and writes only the parts that its rows touch.

The new rows' parts are read, merged with them, written aside, and then put in place by a dynamic partition overwrite. The batch
that a part last took in is kept with its rows, so a batch that is run again, also after it was put in place in some parts
alone, merges only where it is missing. Parts are bounded in number; within one, rows are dealt over as many tasks as they
need, so a hot part is no single task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagelight.sources.saved import saved

#: Parts of a table; fixed for a table's life, since a key must keep its part.
PARTS = 64

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def part_of(keys: list[str], parts: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")


class KeyedTable:
    """The table in a folder. Its columns are those of the first batch."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], parts: int = PARTS):
        self.spark, self.path, self.keys, self.parts = spark, path, keys, parts

    def exists(self) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def _stored(self, columns: DataFrame) -> DataFrame:
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields)
        return self.spark.read.schema(f"{fields}, _batch long, _part int").parquet(self.path)

    def upsert(self, new: DataFrame, batch: int, merge: Merge) -> None:
        """Merge the rows of a batch: merge(old rows of its parts, new rows) gives the parts' rows. Batches are numbered upwards."""
        new = saved(new)
        touched = [r[0] for r in new.select(part_of(self.keys, self.parts).alias("p")).distinct().collect()]  # PARTS at most
        if not touched:
            return
        if self.exists():
            old = self._stored(new).where(F.col("_part").isin(touched))
            done = [r[0] for r in old.groupBy("_part").agg(F.max("_batch").alias("b")).where(F.col("b") >= batch).collect()]
            left = ~part_of(self.keys, self.parts).isin(done) if done else F.lit(True)
            merged = merge(old.where(~F.col("_part").isin(done) if done else F.lit(True)).select(new.columns), new.where(left))
        else:
            merged = merge(new.limit(0), new)
        rows = saved(merged.select(*new.columns, F.lit(batch).cast("long").alias("_batch"), part_of(self.keys, self.parts).alias("_part")))
        rows.repartitionByRange("_part", *self.keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_part").parquet(self.path)

    def rows(self, columns: DataFrame) -> DataFrame:
        """All rows, with the columns of the given frame."""
        return self._stored(columns).select(columns.columns)
