"""Tables that cut lineage: written once to the folder all machines share, then read back.

A lost executor costs only the tasks that ran on it, because every later job starts from files in
``spark.checkpoint.dir``.  The session names that folder; a folder of our own is made only where the
session names none and runs on one machine (local tests).
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrine.sources.session import ship_package

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Rows of keys that may be sent to every task; more are met by sorting both sides.
SENT_ROWS = 1_000_000
#: Rows and bytes in one Arrow batch handed to Python, so that very long texts stay bounded.
BATCH_ROWS, BATCH_BYTES = 1000, "8m"


def shared_folder(spark: SparkSession) -> str:
    """Folder named by the session; if unset on one machine, a new local one, remembered in the session."""
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all machines share")
        named = "file://" + tempfile.mkdtemp(prefix="papyrine-")
        spark.conf.set(CHECKPOINT_DIR, named)
    return named


def prepare_python(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, and send this package to its executors once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    ship_package(spark)


class Scratch:
    """A run's own folder below the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the written rows."""
        path = self.path(name)
        df.write.parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        read._scratch_path = path
        return read

    def view(self, table: DataFrame, df: DataFrame) -> DataFrame:
        """``df``, known as a view of a written table, so that it can be dropped by it."""
        df._scratch_path = getattr(table, "_scratch_path", None)
        return df

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete written tables that no later plan reads."""
        for table in tables:
            path = None if table is None else getattr(table, "_scratch_path", None)
            if path:
                where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def kept_by(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """``rows`` joined with a written table of distinct keys: sent to every task while it has ``SENT_ROWS`` rows at most, else by sorting both."""
    return rows.join(F.broadcast(keys) if keys.count() <= SENT_ROWS else keys.hint("merge"), on, how)
