"""What several operators here need: the cluster's shared folder, tables written to it, Arrow slicing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a new local one where that is unset on one machine, an error on a cluster."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tallyloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: computed once, lineage cut, readable after the loss of any executor."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Removes a table that `written` or an operator left in the shared folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def trim() -> None:
    """Gives free memory of this Python worker back to the system: Spark keeps workers, and idle ones count too."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if give_back is not None:
        give_back(0)


def others(df: DataFrame, *used: str):
    """All columns but those used, in one struct `rest` (null if there are none): carried along untouched."""
    names = [f.name for f in df.schema.fields if f.name not in used]
    return (F.struct(*[df[f"`{n}`"] for n in names]) if names else F.lit(None).cast("string")).alias("rest")


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about max_bytes at most (a single longer row comes alone)."""
    col = batch.column(batch.schema.get_field_index(column))
    size = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, s in enumerate(size.tolist()):
        if i > start and total + s > max_bytes:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += s
    if batch.num_rows > start:
        yield batch.slice(start)
