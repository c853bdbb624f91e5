"""Tables kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` under ``spark.checkpoint.dir`` and reads it back, so that rounds of a loop neither
    recompute one another nor depend on an executor's disk.  Unset, on one machine, a temporary
    folder takes its place."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="vicinity-")
        spark.sparkContext.setCheckpointDir(folder)
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def evaluated(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with columns that are computed once a row.  A projection is merged into those above it, which
    repeats its expressions for each use; a generator is not."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


#: Rows and bytes that go to a Python worker at once, at most: both sides hold a batch, and texts may be long.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def bounded_batches() -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS`` rows and ``BATCH_BYTES`` if they are larger, so that a
    worker's memory does not follow the texts' length.  The session keeps these settings, as plans are made when they run."""
    spark = SparkSession.getActiveSession()
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, most)


def forget(*tables: DataFrame) -> None:
    """Deletes tables that :func:`keep` has made and that no later step reads."""
    for table in tables:
        for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
            place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
