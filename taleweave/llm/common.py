"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters, digits and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Runs of anything but ASCII white space.
TOKEN = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only; ``lower`` would change letters outside ASCII and, for some, their number."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, pattern: str = WORD) -> Column:
    """The words of a text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder; one of our own only where none is set, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="taleweave-")
    sc.setCheckpointDir(made)
    return made


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there, and any executor can reread it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/taleweave-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows up to which a list of keys is broadcast.
BROADCAST_ROWS = 1_000_000


def listed(keys: DataFrame) -> DataFrame:
    """Keys of a written table, to be broadcast if they are few enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


#: Bytes of text that a Python worker has in hand at once.
SLICE_BYTES = 1 << 22


def sliced(batch: pa.RecordBatch, *columns: int, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of a batch with about ``limit`` bytes in ``columns`` together, one row at least. Nothing is copied."""
    sizes = [sum(x) for x in zip(*(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_pylist() for c in columns), strict=True)]
    start = held = 0
    for at, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name`` with underscores before it, that no column of ``df`` has (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
