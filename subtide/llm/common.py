"""Session settings, shared-folder tables and packed hash helpers used by the operators."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast, col

#: Rows and about bytes in one Arrow batch: bounds what a Python worker holds of very long texts.
ARROW_ROWS, ARROW_BYTES = 256, 8 << 20


def tune(spark: SparkSession) -> SparkSession:
    """Session settings that every operator here relies on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    # the reader's vectors of long texts are arrays of many MB else, which fill an executor's heap
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(ARROW_ROWS))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a temporary one, but only if all runs on one machine."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if found:
        return found
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="subtide-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    context.setCheckpointDir(made)
    return made


#: Tables of written() that are still there; the program's end deletes them.
_LEFT: dict[str, tuple] = {}


@atexit.register
def release(spark: SparkSession | None = None) -> None:
    """Deletes all tables of written(), of one session or of all; results that were not used yet can't be used any more."""
    for path, (session, where, conf) in list(_LEFT.items()):
        if spark in (None, session):
            _LEFT.pop(path)
            with contextlib.suppress(Exception):  # the session's process may be gone
                where.getFileSystem(conf).delete(where, True)


#: Paths of tables written by the stage of a pipeline that runs now; None outside of one.
_STAGE: list[str] | None = None
#: Those of stages before it.
_EARLIER: list[tuple[SparkSession, str]] = []


@contextlib.contextmanager
def stage(spark: SparkSession, docs: DataFrame):
    """Within it, tables of written() belong to a stage of a pipeline over docs; tables of earlier stages that docs does not read go.

    A stage's result is written before the next one begins, so nothing else reads them.
    """
    global _STAGE
    needed = "\n".join(docs.inputFiles()) if _EARLIER else ""
    for session, path in [*_EARLIER]:
        if path.rpartition("/")[2] not in needed:
            _delete(session, path)
            _EARLIER.remove((session, path))
    freed(spark)
    _STAGE = []
    try:
        yield
    finally:
        _EARLIER.extend((spark, path) for path in _STAGE)
        _STAGE = None


def _delete(spark: SparkSession, path: str) -> None:
    _LEFT.pop(path, None)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def once(spark: SparkSession):
    """Within it, a query's shuffle files go as soon as it has ended, without waiting for any garbage collection."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/subtide-{uuid.uuid4().hex}"
    _LEFT[path] = spark, spark._jvm.org.apache.hadoop.fs.Path(path), spark._jsc.hadoopConfiguration()
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    with once(spark):
        writer.parquet(path)
    if _STAGE is not None:
        _STAGE.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._subtide_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes tables of written() that no later plan reads."""
    for df in frames:
        path = getattr(df, "_subtide_path", None)
        if path:
            _delete(df.sparkSession, path)


def freed(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of finished steps: its cleaner waits for the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Gives memory that a Python worker no longer uses back to the system: workers stay for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """run(batches), with a trim at its end."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def partitions(spark: SparkSession) -> int:
    """How many parts a shuffle is dealt into; follows the session's setting, which follows the data."""
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def smallest(hashes: DataFrame, column: str, n: int) -> int | None:
    """The n-th smallest of the distinct hashes in a column of longs (the greatest, if there are fewer); None without any.

    Only the smallest hashes, about four times as many as wanted, are told apart, so a hash that very many rows share
    takes one place and no task holds more.
    """
    rows = hashes.count()
    if not rows:
        return None
    most = -(1 << 63) + int((1 << 64) * min(1.0, 4 * n / rows)) - 1
    low = hashes.filter(col(column) <= most) if 4 * n < rows else hashes
    got = low.select(column).distinct().orderBy(column).limit(n).agg({column: "max"}).first()[0]
    # too few distinct ones lie that low: look at all
    return hashes.select(column).distinct().orderBy(column).limit(n).agg({column: "max"}).first()[0] if got is None else got


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash (splitmix64), elementwise; the input array is overwritten."""
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


#: A list of rows up to this length is broadcast: at 16 bytes a row it takes a few tens of MB.
BROADCAST_ROWS = 500_000


def without(rows: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys (nulls compare equal) are not listed; a short list is broadcast, a longer one shuffled."""
    gone = written(listed.select(*keys).distinct())
    side = gone.select(*[gone[k].alias(f"__gone_{k}") for k in keys])
    if gone.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        side = broadcast(side)
    return rows.join(side, [rows[k].eqNullSafe(side[f"__gone_{k}"]) for k in keys], "left_anti")
