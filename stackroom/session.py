"""Session and scratch-space helpers shared by every layer."""

from __future__ import annotations

import contextlib
import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stackroom")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package where it isn't installed.

    Enough where executors see the same folder (local mode); elsewhere submit it with
    ``--py-files`` or install it.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    # Rows here are whole documents: small Arrow batches bound what a Python worker holds.
    if int(spark.conf.get(BATCH_ROWS, "10000")) == 10_000:
        spark.conf.set(BATCH_ROWS, "1000")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the tables of a data directory, by any path Spark can read."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A table of fewer bytes is one task's scan.
ONE_SCAN = 32 << 20


def dealt(df: DataFrame) -> DataFrame:
    """A table too small for more than one scan task, dealt to all cores; any other as it is.

    For work that costs far more than reading: a single file would leave all but one core idle.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < ONE_SCAN else df


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only a local session that has none (tests, a laptop) gets a folder of its machine; on a
    cluster every executor would write to a disk of its own, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jvm_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = jvm_dir.get() if jvm_dir.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "stackroom-scratch")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; it goes when the driver's JVM ends."""
    path = f"{scratch_root(spark)}/stackroom-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage so that a lost executor costs one re-read, and lets a join see
    plain exchanges on both sides, which adaptive execution can split when a key is hot.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def bloom_joins(spark: SparkSession):
    """While it lasts, joins planned with a small filtered side filter the other side's scan.

    Spark's own runtime Bloom filters, whose size is bounded, with thresholds that let them
    serve inputs of any size; they only drop rows that the join would drop.
    """
    prefix = "spark.sql.optimizer.runtime.bloomFilter."
    want = {prefix + "enabled": "true", prefix + "applicationSideScanSizeThreshold": "1b", prefix + "creationSideThreshold": "64g"}
    before = {k: spark.conf.get(k, None) for k in want}
    try:
        for k, v in want.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def release(spark: SparkSession) -> None:
    """Let the driver notice that finished jobs' shuffle files are garbage, so that the cleaner removes them."""
    for _ in range(2):  # the scheduler drops its own references a moment after a job ends
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def drop_scratch(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by :func:`cut` that nothing needs any more."""
    marker = f"/stackroom-{spark.sparkContext.applicationId}/"
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles() if marker in f}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
