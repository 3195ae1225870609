"""Session settings for local runs; a cluster keeps its own."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.driver.memory": "12g",
}


def local_session(cores: int = 8, app: str = "tallyweave") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
    )
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: the session's ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary one; on a cluster that is an error.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tallyweave-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """What is executed inside deletes its shuffle files as soon as it ends.

    Otherwise they stay until the driver happens to collect its garbage, so a job of several steps holds the shuffles of
    all of them. Only for executions whose plan is used once: a frame made before is wrapped in a new one.
    """
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


def cut(df: DataFrame) -> DataFrame:
    """Compute once and keep in the shared folder: for small results that several later steps read."""
    shared_dir(df.sparkSession)
    with freeing(df.sparkSession):
        return df.select("*").checkpoint()


def listed(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few rows of fixed values as a table whose size the optimizer knows.

    Rows handed over by the driver count as of unknown size: a join with them would shuffle the large side by the few
    keys that they hold, one task per key.
    """
    fields = T.StructType.fromDDL(schema).fields
    made = [F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields, strict=True)]) for row in rows]
    return spark.range(1, numPartitions=1).select(F.inline(F.array(*made)))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies; one that is not there is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small control file, whole or not at all."""
    jvm = spark._jvm
    final, fresh = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new"))
    files = final.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(fresh, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    files.delete(final, False)
    if not files.rename(fresh, final):
        raise OSError(f"{path} could not be written")


def get_texts(spark: SparkSession, pattern: str) -> dict[str, str]:
    """The control files whose paths fit a pattern, with their texts."""
    jvm = spark._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(pattern)
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {}
    for status in files.globStatus(pattern) or ():
        stream = files.open(status.getPath())
        found[status.getPath().toString()] = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
    return found
