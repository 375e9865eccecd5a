"""Reading inputs and writing intermediate tables that survive lost executors."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


#: For Python workers: freed arrays go back to the system instead of staying with an idle worker.
MEMORY = {"MALLOC_MMAP_THRESHOLD_": "2097152", "MALLOC_TRIM_THRESHOLD_": "2097152", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}

#: Rows that the Parquet reader decodes at once, bytes of a batch for Python workers, and bytes of a row group, which
#: writers and readers hold whole.  By default they are 4096 rows, 64 MB and 128 MB, for each task, some in several copies.
BATCHES = {"spark.sql.parquet.columnarReaderBatchSize": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "parquet.block.size": str(16 << 20)}


def importable(spark: SparkSession) -> None:
    """Let Python workers of this machine import the package; a cluster gets it by ``--py-files``.

    Also sets how workers return memory, as those of several stages live side by side, and bounds what
    a task holds of long texts at once, where the session's user has not.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    for name, value in MEMORY.items():
        env.setdefault(name, value)
    given, hadoop = spark._jsparkSession.sessionState().conf(), spark._jsc.hadoopConfiguration()
    for name, value in BATCHES.items():
        if not given.contains(name) and hadoop.get(name) is None:
            spark.conf.set(name, value)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return bounded(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Share of a heap that row groups being read may take, and of how many files, the largest, their sizes are looked up:
#: a table's files are mostly written alike.
READ_SHARE, FOOTERS = 0.4, 64


def heap(spark: SparkSession) -> int:
    """Bytes of the heap that tasks share, of one executor."""
    sc = spark.sparkContext
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        return int(spark._jvm.Runtime.getRuntime().maxMemory())
    return int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(sc.getConf().get("spark.executor.memory", "1g")))


def bounded(df: DataFrame) -> DataFrame:
    """A read table, in fewer tasks where those that run at once would fill the heap with their row groups.

    A reader holds the row group that it is at, so of a table in large ones a few tasks can take all
    memory, whatever a batch's size.  The largest decides; files smaller than a task's share can't hold
    one that is too large, so mostly nothing is looked up.
    """
    spark = df.sparkSession
    sc, leaves = spark.sparkContext, df._jdf.queryExecution().analyzed().collectLeaves()
    if leaves.size() != 1 or leaves.apply(0).getClass().getSimpleName() != "LogicalRelation":
        return df
    relation = leaves.apply(0).relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or relation.fileFormat().toString() != "Parquet":
        return df
    location = relation.location()
    executors = max(1, sc._jsc.sc().getExecutorMemoryStatus().size() - (not sc.master.startswith("local") or sc.master.startswith("local-cluster")))
    cores, most = -(-sc.defaultParallelism // executors), int(heap(spark) * READ_SHARE)
    if location.sizeInBytes() <= most // cores:
        return df
    files = location.allFiles()
    large = sorted(((f.getLen(), f.getPath()) for f in map(files.apply, range(files.size())) if f.getLen() > most // cores), key=lambda x: -x[0])
    group = max((_row_group(spark, path) for _, path in large[:FOOTERS]), default=0)
    return df if group <= most // cores else df.coalesce(max(1, most // group) * executors)


def _row_group(spark: SparkSession, path) -> int:
    """Bytes of a file's largest row group, as stored."""
    hadoop = spark._jvm.org.apache.parquet.hadoop
    file = hadoop.ParquetFileReader.open(hadoop.util.HadoopInputFile.fromPath(path, spark._jsc.hadoopConfiguration()))
    try:
        return max((b.getCompressedSize() for b in file.getFooter().getBlocks()), default=0)
    finally:
        file.close()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; one of our own only where driver and executors are one process."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        place = f"file://{tempfile.mkdtemp(prefix='tidewater-')}"
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


class _Written(threading.local):
    """Folders of the tables that a thread has stored."""

    def __init__(self):
        self.paths: list[str] = []


_written = _Written()


def written() -> int:
    """How many tables this thread has stored so far."""
    return len(_written.paths)


def release(spark: SparkSession, since: int) -> None:
    """Delete the tables stored since then, but for the newest, which nothing else depends on any more."""
    for place in _written.paths[since:-1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _written.paths[since:-1]


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.paths.append(path)
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows of the driver as a table, structs as dicts.

    They go by Arrow: as pickled rows they would start a second set of Python workers on each executor.
    """
    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)
    return spark.createDataFrame(pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow), kind)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of two or three numbers up to which a table is broadcast, about 6 MB; a plan has some 24 such joins.
BROADCAST_ROWS = 1 << 18


def narrow(df: DataFrame) -> DataFrame:
    """A stored table of a few numbers a row, marked for broadcast where its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
