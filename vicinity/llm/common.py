"""Shared helpers: the folder all executors see, saved intermediate tables, word patterns."""

from __future__ import annotations

import gc
import tempfile
import uuid
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

#: A word is a run of anything but the ASCII white space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors: ``spark.checkpoint.dir`` of the session.

    Where it is unset (tests, one machine) a temporary folder becomes the checkpoint folder; on
    anything but a local master that is an error, since executors could not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="vicinity-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: later steps neither recompute it
    nor depend on blocks of an executor that may be lost."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes what was written below these paths of the shared folder, which no later step reads."""
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def discard_saved(*tables: DataFrame) -> None:
    """Deletes tables that :func:`save` has made and no later step reads."""
    for table in tables:
        discard(table.sparkSession, *{f.rpartition("/")[0] for f in table.inputFiles()})


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names for internal use that clash with none of ``df`` (case aside)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Bytes of keys and values that a table may have to be broadcast.
BROADCAST_BYTES = 16 << 20
#: A key with more than this part of all rows is dealt over several tasks; there can be no more such keys.
HOT = 1000


def look_up(rows: DataFrame, table: DataFrame, key: str, weight: str, salt: list[str]) -> DataFrame:
    """``rows`` with the columns of ``table`` (a saved table with one row a ``key``), null where it has
    none.  ``weight``: a column of ``table`` with the number, or another measure, of the key's rows.

    A table of at most ``BROADCAST_BYTES``, measured, is broadcast.  A larger one is joined by key, and
    keys with over 1/HOT of the weight, of which there are fewer than ``HOT``, are dealt over tasks in
    proportion to it, by a hash of the ``salt`` columns of ``rows``.  Both ways give the same rows."""
    others = [F.coalesce(F.length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in table.columns]
    size, total = table.agg(F.sum(sum(others, F.lit(64))), F.sum(weight)).first()
    if (size or 0) <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), key, "left")
    part, ways, mark = fresh(rows.join(table.limit(0), key), "part", "ways", "mark")
    hot = table.where(F.col(weight) * HOT > total).groupBy(F.xxhash64(key).alias(mark)).agg(F.max(F.ceil(F.col(weight) * HOT / total)).cast("int").alias(ways))
    split = lambda df: df.withColumn(mark, F.xxhash64(key)).join(F.broadcast(hot), mark, "left").drop(mark)  # noqa: E731  fewer than HOT pairs of integers
    left = split(rows).withColumn(part, F.pmod(F.xxhash64(*salt), F.coalesce(ways, F.lit(1)))).drop(ways)
    right = split(table).withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(ways, F.lit(1)).cast("long") - 1))).drop(ways)
    return left.join(right, [key, part], "left").drop(part)


def small(table: DataFrame, bytes_each: int) -> DataFrame:
    """A saved table, marked to be broadcast if its counted rows of ``bytes_each`` are at most ``BROADCAST_BYTES``;
    else it is joined by key.  Both ways give the same rows."""
    return F.broadcast(table) if table.count() * bytes_each <= BROADCAST_BYTES else table


def release(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of finished steps when the driver collects its garbage: asks for that."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def own_names(key: str, *made: str) -> None:
    """Refuses a key column that has the name of a column that is made."""
    if key.lower() in made:
        raise ValueError(f"the key column is named {key}, as a column that is made: rename it first")


#: Rows and bytes that go to a Python worker at once, at most: texts may be long, and both sides hold a batch.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to ``BATCH_ROWS`` rows and ``BATCH_BYTES`` if they are larger.
    Plans are made when they run, so the session keeps these settings."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(name, most)


SHINGLE_SEED = 42


def shingles(text: str | None, words_each: int) -> np.ndarray:
    """The distinct XXH64 values of a text's shingles in rising order; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    each = map(b" ".join, zip(*(words[i:] for i in range(words_each)), strict=False)) if len(words) > words_each else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxh64_intdigest, each, repeat(SHINGLE_SEED)), np.uint64))
