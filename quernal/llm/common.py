"""What the operators share: the shared folder, written tables, and rules for text."""

from __future__ import annotations

import atexit
import ctypes
import functools
import string
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_roots: dict[str, tuple[SparkSession, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder under spark.checkpoint.dir; only where that is unset and Spark runs locally, a folder of our own."""
    app = spark.sparkContext.applicationId
    if app not in _roots:
        top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not top:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            top = "file://" + tempfile.mkdtemp(prefix="quernal-")
            spark.sparkContext.setCheckpointDir(top)
        _roots[app] = (spark, f"{top.rstrip('/')}/quernal-{app}")
        atexit.register(_remove, spark, _roots[app][1])
    return _roots[app][1]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended before the interpreter; the folder is then the cluster's to clear
        return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and any executor can read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quernal_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind a DataFrame that materialize() returned; nothing may read it afterwards."""
    _remove(df.sparkSession, df.quernal_path)


def packed(df: DataFrame, **wanted: str) -> DataFrame:
    """(row, one column for each keyword): df's whole rows as a struct, beside the named columns under names of ours.

    Columns are found by position, so names that clash (with ours, or in letter case only) do no harm; "row.*" gives
    the rows back as they were. What is not used of row is never read.
    """
    bounded_batches(df.sparkSession)
    names = df.columns
    at = {ours: names.index(theirs) for ours, theirs in wanted.items()}
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    row = F.struct(*(F.col(f"c{i}").alias(n) for i, n in enumerate(names)))
    return plain.select(row.alias("row"), *(F.col(f"c{i}").alias(ours) for ours, i in at.items()))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all else as it is; null counts as empty.

    lower() does just that to text of ASCII only, and much faster than translate().
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


#: Rows of ids, and of digests of 32 bytes, that a checked broadcast may hold: some 30 MB.
BROADCAST_ROWS = 200_000


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether a written table has at most so many rows: the check before each broadcast of it."""
    return df.limit(rows + 1).count() <= rows


#: Rows of an Arrow batch: whole texts travel in them, and some are very long.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Limit the session's Arrow batches to BATCH_ROWS, unless it has a lower limit of its own.

    It stays so for the session: the limit is read when a plan runs, which for a lazy result is after its operator returns.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def tidied(mapper):
    """mapper (a generator over batches), after which the worker gives its free memory back: workers idle on between stages."""

    @functools.wraps(mapper)
    def run(*args):
        yield from mapper(*args)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return run
