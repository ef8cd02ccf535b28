"""A table kept as snapshots in the shared folder: each batch writes the buckets it changes, then a list of which batch holds each bucket. The last whole list is the table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64


class Snapshots:
    """A keyed table in `folder`. A batch that is applied twice changes nothing: its list is there, or what it left without a list is written anew."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def batches(self) -> list[int]:
        """Numbers of the batches whose lists are whole."""
        files, lists = self._files(), self._path("lists")
        if not files.exists(lists):
            return []
        names = [s.getPath().getName() for s in files.listStatus(lists)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch=") and files.exists(self._path(f"lists/{n}/_SUCCESS")))

    def holders(self, batch: int) -> dict[int, int]:
        """Of each bucket (`buckets` at most) the batch that wrote it last."""
        return {r.bucket: r.holder for r in self.spark.read.parquet(f"{self.folder}/lists/batch={batch}").collect()}

    def bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def read(self, batch: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The table after a batch, the last one unless told; of some buckets alone. Empty before the first."""
        done = self.batches()
        if batch is None:
            batch = done[-1] if done else None
        held = {b: n for b, n in (self.holders(batch) if batch is not None else {}).items() if only is None or b in only}
        if not held:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/data/batch={n}/bucket={b}" for b, n in sorted(held.items())))

    def apply(self, updates: DataFrame, number: int, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Writes merge(rows of the changed buckets so far, updates) as batch `number`; others stay where they are."""
        done = self.batches()
        if number in done:
            return
        before = max((n for n in done if n < number), default=None)
        changed = {r.b for r in updates.select(self.bucket().alias("b")).distinct().collect()}
        held = self.holders(before) if before is not None else {}
        if changed:
            old = self.read(before, changed) if before is not None else self.spark.createDataFrame([], self.schema)
            rows = merge(old, updates).select(*self.schema.names).withColumn("bucket", self.bucket())
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/batch={number}")
            held |= dict.fromkeys(changed, number)
        listed = self.spark.createDataFrame(sorted(held.items()), "bucket int, holder long")
        listed.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/lists/batch={number}")
