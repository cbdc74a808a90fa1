"""What the corpus operators share: reading tables, durable cuts, hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch that are worked on at a time.
PART = 1 << 21

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; one of our own only where none is set and Spark
    runs on this machine alone."""
    global _own_dir
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="dyadloom-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return _own_dir


def settle(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Lineage ends at the written table, so a lost executor costs a re-read, and
    two consumers do not compute ``df`` twice. The folder goes when the JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def n_words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finisher over uint64, so that every bit depends on every bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def parts(batches: Iterable):
    """The rows of Arrow batches in slices of at most ``PART`` bytes or of one row, so that
    what is made of them does not grow with a batch, which holds 10,000 rows of any length."""
    for batch in batches:
        left = [batch]
        del batch  # not held while the next one is read
        while left:
            part = left.pop()
            half = part.num_rows // 2
            if half and part.nbytes > PART:
                left += part.slice(half), part.slice(0, half)
            else:
                yield part
        del part
        pa.default_memory_pool().release_unused()


def arrow_rows(batches: Iterable, *names: str):
    """The named columns as Python lists, those of a part of a batch at a time."""
    for part in parts(batches):
        columns = [part.column(part.schema.get_field_index(n)).to_pylist() for n in names]
        del part
        yield columns
