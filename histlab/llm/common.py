"""Helpers shared by the text operators: shared storage, Arrow batches, row keys."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch sent to Python. Texts may be long, so batches stay small.
BATCH_ROWS = 256

#: Tables up to this many bytes on disk, and up to so many in memory, may be broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES, BROADCAST_MEMORY = 16 << 20, 64 << 20
#: What a row takes in memory beside its columns.
ROW_OVERHEAD = 16

#: A table in few files is dealt out to all cores up to so many bytes on disk for each of them.
SPREAD_BYTES = 128 << 20

#: The six ASCII white-space characters that every contract of this package names.
SPACE_CLASS = r"[\x20\x09-\x0D]"

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir).

    Where it is unset, as in tests, a local session has a temporary one; a cluster must set it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        have = spark.sparkContext._jsc.sc().getCheckpointDir()
        if have.isDefined():
            base = have.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            base = tempfile.mkdtemp(prefix="histlab-")
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again.

    This cuts the lineage at a point that survives the loss of any executor, and
    fixes generated columns (partition numbers, row numbers) for all later readers.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/histlab-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._histlab_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by materialize() that nothing will read again."""
    for df in tables:
        path = df._histlab_path
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def resting_on(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """Note that ``df`` reads these stored tables, so that release_under() can delete them."""
    df._histlab_tables = tables
    return df


def release_under(df: DataFrame) -> None:
    """Delete the stored tables that ``df`` reads; call it once its rows are written elsewhere."""
    release(*df._histlab_tables)
    df._histlab_tables = ()


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that have ended.

    They go when the driver collects their garbage, which it may not do for long; in a job of
    many steps they would add up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _release_all() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # the JVM may have ended before
            return


def stored_bytes(df: DataFrame) -> int:
    """Size on disk of a table made by materialize()."""
    spark = df.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(df._histlab_path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def broadcast_if_small(df: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Hint a broadcast of a stored table, or of columns of ``stored``, only after its size has been checked.

    Compressed, it may take BROADCAST_BYTES; in memory its rows, with their width by the schema
    or four times what they take on disk, may take BROADCAST_MEMORY.
    """
    table = df if stored is None else stored
    on_disk = stored_bytes(table)
    if on_disk > BROADCAST_BYTES:
        return df
    width = df._jdf.schema().defaultSize() + ROW_OVERHEAD
    return F.broadcast(df) if max(4 * on_disk, table.count() * width) <= BROADCAST_MEMORY else df


def text_of(name: str = "text") -> Column:
    """The text column with null as the empty string."""
    return F.coalesce(F.col(name), F.lit(""))


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with small batches, so that memory is bounded by BATCH_ROWS texts.

    Sets ``spark.sql.execution.arrow.maxRecordsPerBatch`` of the session to BATCH_ROWS
    where it is larger.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system at the end of a task.

    Workers live on from stage to stage, and what their allocators keep would add up.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table documents, spread over all cores.

    A row group is read by one task, so a small table in fewer files than there are cores would
    keep most of them idle; its rows are dealt out evenly. What is sent is at most SPREAD_BYTES
    for each core. All other tables are read as they lie, without a shuffle.
    """
    path = f"{sf_dir}/documents.parquet"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    held = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target)
    cores = spark.sparkContext.defaultParallelism
    docs = table(spark, sf_dir, "documents")
    return docs.repartition(cores) if held.getFileCount() < cores and held.getLength() <= cores * SPREAD_BYTES else docs
