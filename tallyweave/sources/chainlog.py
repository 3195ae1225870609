"""A stored audit chain that grows by batches: each goes on from the heads that the ones before left."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.operators import integrity
from tallyweave.sources.sinks import read_or_empty


@dataclass(frozen=True)
class ChainLog:
    """Chained events below ``root``/log and the heads of every batch below ``root``/head.

    Heads are written after their batch and mark it as complete: a batch that was lost before is built again, a
    complete one is left as it is.
    """

    spark: SparkSession
    root: str
    keys: tuple[str, ...]
    order: str = "id"

    def _schema(self, *names: str) -> T.StructType:
        return T.StructType([*[T.StructField(k, T.StringType()) for k in self.keys], T.StructField(self.order, T.LongType()),
                             *[T.StructField(n, T.StringType()) for n in names]])

    def log(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.root}/log", self._schema("event_key", "previous_hash", "event_hash"))

    def heads(self) -> DataFrame:
        """The head of every entity: the newest that a batch has left."""
        return integrity.chain_heads(read_or_empty(self.spark, f"{self.root}/head", self._schema("event_hash")), self.keys, self.order)

    def append(self, events: DataFrame, batch: int) -> None:
        """Chain new events; ``batch`` numbers ascend. An event that does not come after its entity's head is refused."""
        mark = self._schema("event_hash").add("batch", T.IntegerType())
        done = read_or_empty(self.spark, f"{self.root}/head", mark).filter(F.col("batch") == batch)
        if not done.isEmpty():
            return
        path = f"{self.root}/log/batch={batch}"
        rows = integrity.build_chain(events, self.keys, self.order, self.heads())
        rows.withColumn(self.order, F.col(self.order).cast("long")).write.mode("overwrite").parquet(path)
        chained = self.spark.read.schema(self._schema("event_key", "previous_hash", "event_hash")).parquet(path)
        heads = integrity.chain_heads(chained, self.keys, self.order)
        heads.write.mode("overwrite").parquet(f"{self.root}/head/batch={batch}")
