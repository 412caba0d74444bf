"""Small helpers for DataFrames that the operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words are runs of other characters than space and 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: A table of so many bytes at most may be broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Bytes of a row in a broadcast table besides its texts, and of each of its columns, about.
ROW_BYTES, COLUMN_BYTES = 32, 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; only where none is named and the master is local (tests) a new local one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gondola-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """The same rows, written to a table in the shared folder and read again: computed once, without lineage."""
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Within it, Python workers get batches of so many rows at most, for tables with large rows; what was set before is set again."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def forget(df: DataFrame) -> None:
    """Delete the table of cut() once nothing reads it any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(conf).delete(folder, True)


def new_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_folder(spark), f"{name}-{uuid.uuid4().hex}")


def fits(df: DataFrame) -> bool:
    """Whether the measured bytes of the frame (a table of cut(), which is read for it) allow a broadcast."""
    size = F.lit(ROW_BYTES + COLUMN_BYTES * len(df.columns))
    for field in df.schema:
        if isinstance(field.dataType, T.StringType | T.BinaryType):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType | T.MapType | T.StructType):
            size = size + 4 * F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
    measured = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return measured <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """The frame, marked for broadcast if it fits."""
    return F.broadcast(df) if fits(df) else df


def is_word_count(text) -> F.Column:
    """Number of words of the text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
