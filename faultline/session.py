"""Session settings and the shared folder for cut lineage."""

import errno
import itertools
import operator
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Size of the files of a side that is broadcast; in memory it is a few times that.
BROADCAST_BYTES = 16 << 20

# Tasks for each core that list the folders of a read.
LISTING_TASKS = 16

# Tasks for each core at least, and bytes for a task, where many small files are read.
READING_TASKS, READING_BYTES = 8, 8 << 20

# Folder of rows without a value, and what names of folders do not hold as it is; as Spark's own writer has them.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
NOT_IN_NAMES = r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]"""

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A row costs patterns or model calls here, so few rows are work enough for a task.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # Methods above this size are not compiled by the JVM; smaller pieces per operator are.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Equi-joins here have one side that is unique on the key, so a hot key only
    # swells the other side; adaptive execution splits that side.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keyed state of streams lies on disk, and a batch stores the keys that it has changed.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app: str = "faultline", master: str | None = None, **settings) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        folder = tempfile.mkdtemp(prefix="faultline-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input with fewer splits than cores; larger ones pass as is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_scratch: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/faultline/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def drop_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables this process has written; for use once its results are stored."""
    while _scratch:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Have the driver's JVM collect what is unused, so that Spark's cleaner drops the shuffle files of jobs whose tables are written."""
    spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries that end inside leave no shuffle files; for tables that are written, whose readers need none. ``release`` has them go later."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def listed_in_few_tasks(spark: SparkSession) -> Iterator[None]:
    """Readers made inside list their folders in some tasks for each core; else there is one for each folder, up to 10,000 of them, and
    the driver takes longer to hand them out than they run."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, LISTING_TASKS * spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_files_together(files: DataFrame) -> DataFrame:
    """Files as read, in no more tasks than their bytes or the cores ask for; readers count each file as 4 MB, so small ones come by the
    thirty, and starting a task takes longer than reading them."""
    size = int(files._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return files.coalesce(max(READING_TASKS * files.sparkSession.sparkContext.defaultParallelism, size // READING_BYTES))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Used where later stages would otherwise repeat a costly scan; the files
    outlive lost executors.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_texts(rows: DataFrame, path: str, by: str) -> None:
    """``value`` of each row as text files in a folder for each value of ``by``; ``path`` must not be there yet.

    On a local file system (or one mounted everywhere) tasks write the files themselves, since Hadoop starts a process of the system
    for each file and folder that it makes there, which takes longer than all the rest. On other file systems Spark writes them, and
    each task moves its own files to their place when it is done; else the driver would move all of them, one by one. Either way a
    task that runs again writes the same names again.
    """
    folder = _local_folder(rows.sparkSession, path)
    if folder is None:
        rows.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy(by).text(path)
        return
    os.makedirs(folder)
    named = F.coalesce(F.nullif(F.col(f"`{by}`").cast("string"), F.lit("")), F.lit(NO_VALUE)).alias("name")
    named = rows.select(named, F.col("value").cast("binary").alias("value")).sortWithinPartitions("name")
    named.mapInArrow(_text_files(folder, by), "files long").write.format("noop").mode("overwrite").save()


def _local_folder(spark: SparkSession, path: str) -> str | None:
    """``path`` as the system names it; None if it is not on a local file system."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toUri()
    return folder.getPath() if folder.getScheme() == "file" else None


def _text_files(folder: str, by: str) -> Callable:
    """Writes rows (name, value), sorted by name, as one file for each name; how many there were.

    The files come to their place when the task is done. Until then they are in a folder of the task, which readers pass by for its
    dot; tasks that make folders in the same one wait for one another.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId()
        file, own = f"part-{at:05d}.txt", f"{folder}/.task-{at}-{uuid.uuid4().hex}"
        os.mkdir(own)
        rows = ((name.as_py(), value) for batch in source for name, value in zip(*batch.columns, strict=True))
        places = []
        for name, group in itertools.groupby(rows, operator.itemgetter(0)):
            places.append(f"{by}={re.sub(NOT_IN_NAMES, lambda c: f'%{ord(c[0]):02X}', name)}")
            os.mkdir(f"{own}/{places[-1]}")
            with open(f"{own}/{places[-1]}/{file}", "wb") as out:
                for _, value in group:
                    if value.is_valid:
                        out.write(value.as_buffer())
                    out.write(b"\n")
        for place in places:
            try:
                os.rename(f"{own}/{place}", f"{folder}/{place}")
            except OSError as e:
                if e.errno not in (errno.EEXIST, errno.ENOTEMPTY):
                    raise
                # Another task has files there, or this one when it ran before.
                os.replace(f"{own}/{place}/{file}", f"{folder}/{place}/{file}")
                os.rmdir(f"{own}/{place}")
        os.rmdir(own)
        yield pa.RecordBatch.from_pydict({"files": [len(places)]})

    return run


def written_side(df: DataFrame, label: str, most: int = BROADCAST_BYTES) -> DataFrame:
    """Write a join side once and mark it for broadcast only if its files are small.

    Beyond ``most`` bytes the join shuffles both sides. Deciding before the join
    starts spares the wide other side a shuffle that would turn out needless.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    side = df.sparkSession.read.schema(df.schema).parquet(path)
    return F.broadcast(side) if _size(df.sparkSession, path) <= most else side


def _size(spark: SparkSession, path: str) -> int:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
