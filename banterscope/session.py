"""Session set-up and the shared folder that jobs may write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# What a job sets in its session: a JSON object that repeats a key keeps the last value.
CONF = {"spark.sql.variant.allowDuplicateKeys": "true"}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark. A cluster brings its own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("banterscope")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``.

    Only where that setting is absent, as in local tests, a temporary folder is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="banterscope-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# Rows that a scan decodes and that go to a Python worker at a time. Where texts are long, Spark's own numbers are tens of
# megabytes a column and task, in the JVM's heap, beside it and in the worker.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.parquet.columnarReaderBatchSize": 1024}


def small_batches(spark: SparkSession) -> None:
    """From now on, batches of this session hold no more rows than ``BATCHES`` says; all rows go through, as before."""
    for key, rows in BATCHES.items():
        if not 0 < int(spark.conf.get(key)) <= rows:
            spark.conf.set(key, str(rows))


# Shuffle files go when the query that wrote them ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage durably.

    Nothing reads the shuffles of the writing query again, so their files are removed.
    """
    spark = df.sparkSession
    path, before = shared_folder(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote and that nothing will read again."""
    for table in tables:
        place = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_to)
        place.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(place, True)
