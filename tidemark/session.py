"""Session defaults and the shared scratch tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
ROWS_PER_TASK = 50_000  # rows that ``spread`` gives a task


def build_session(app: str = "tidemark", cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Local session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")  # keep all cores busy on small tables
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one the cluster names, or a new local one in local mode only."""
    named = spark.conf.get(CHECKPOINT_KEY, None)
    if named:
        return named
    chosen = getattr(spark, "_tidemark_shared_dir", None)
    if chosen is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder shared by all executors")
        chosen = tempfile.mkdtemp(prefix="tidemark-")
        atexit.register(shutil.rmtree, chosen, ignore_errors=True)  # nothing reads it after the session's process
        spark._tidemark_shared_dir = chosen
    return chosen


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def filesystem(spark: SparkSession, path: str):
    """(file system, path) of a folder, whatever storage it is on."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def drop_materialized(spark: SparkSession) -> None:
    """Remove what ``materialize`` has written in this application; for the end of a job."""
    fs, path = filesystem(spark, _tables(spark))
    fs.delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The files outlive any executor, are columnar (later readers prune) and carry statistics, so the planner sizes the
    joins that follow from real numbers.
    """
    spark = df.sparkSession
    path = f"{_tables(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def widen(scan: DataFrame) -> DataFrame:
    """Spread a scan of fewer splits than cores before heavy per-row work; a scan with enough splits is left alone."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def spread(scan: DataFrame) -> DataFrame:
    """Deal a scan evenly to tasks of at most about ``ROWS_PER_TASK`` rows, before work that makes rows long or keeps them in memory.

    Splits tell nothing about rows: a row group as long as the table gives one full split and many empty ones. The number of
    a row decides and not a key, and nothing is sorted.
    """
    tasks = max(scan.sparkSession.sparkContext.defaultParallelism, -(-scan.count() // ROWS_PER_TASK))
    numbered = scan.withColumn("_row_no", F.monotonically_increasing_id())
    return numbered.repartition(tasks, "_row_no").drop("_row_no")
