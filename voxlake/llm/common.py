"""Helpers shared by the corpus operators: table access, staging in the shared folder, word rules."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word rule `[^\x20\x09-\x0D]+`; bytes.split() splits on exactly these bytes.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. One of our own only on one machine, where the session names none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = jdir.get() if jdir.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("steps are written to a folder that all machines share: name it in spark.checkpoint.dir")
        found = tempfile.mkdtemp(prefix="voxlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def _steps(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/voxlake-{spark.sparkContext.applicationId}"


def staged(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df once to the shared folder as Parquet and reads it back."""
    spark = df.sparkSession
    path = f"{_steps(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Deletes every step that this application has written; for after its results are written elsewhere."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_steps(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def docs_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and text, under fixed names, so that no other column can clash; null text counts as empty."""
    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def byte_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a string column, without decoding."""
    return batch.column(name).cast(pa.binary() if pa.types.is_string(batch.column(name).type) else pa.large_binary()).to_pylist()


def pieces(batch: pa.RecordBatch, rows: int = 2000, mb: int = 16, name: str = "text") -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that a slice holds few rows and few bytes (one long text may exceed them)."""
    sizes = batch.column(name)
    at, n = 0, batch.num_rows
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(sizes), 0).to_pylist()
    while at < n:
        end, held = at, 0
        while end < n and end - at < rows and (end == at or held + lengths[end] <= mb << 20):
            held += lengths[end]
            end += 1
        yield batch.slice(at, end - at)
        at = end


#: Rows of an Arrow batch that goes to Python: texts are long, and a batch is held on both sides at once.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batch size to BATCH_ROWS, where it is larger."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: What a Python worker may hold of its own when a task ends.
WORKER_MB = 110


def held_mb() -> float:
    """Memory of this process that no file backs; 0 where the system does not say."""
    try:
        with open("/proc/self/status") as f:
            return next((int(line.split()[1]) / 1024 for line in f if line.startswith("RssAnon")), 0.0)
    except OSError:
        return 0.0


def at_end(batches: Iterator[pa.RecordBatch], most_mb: float | None = None) -> Iterator[pa.RecordBatch]:
    """The batches; after the last one (or when the task is given up) a worker that holds much forgets what it has learned."""
    try:
        yield from batches
    finally:
        if held_mb() > (most_mb or WORKER_MB):
            _CACHE.clear()
            release()


def release() -> None:
    """Gives freed memory of this worker back to the machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


_CACHE: dict = {}


def cached(key: object, make):
    """make(), once for each worker process, so that later tasks find what earlier ones have learned.

    A worker holds one such object: another key drops the one before, which keeps a chain of operators within the memory
    of its largest.
    """
    if key not in _CACHE:
        _CACHE.clear()
        release()
        _CACHE[key] = make()
    return _CACHE[key]


def empty(schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([], f.type) for f in schema], schema=schema)
