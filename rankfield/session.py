"""Session defaults shared by tests, the bench and interactive use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A join on (series, ...) may reuse a partitioning by series alone.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    # A query's shuffle files go when it has ended; without this they stay until the driver happens to collect garbage.
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def local_session(cpus: int | str = 8, shuffle_partitions: int = 8, name: str = "rankfield") -> SparkSession:
    """A single-machine session. On a cluster, build your own and call ``tune``."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def tune(spark: SparkSession) -> SparkSession:
    """Set the runtime SQL options the package relies on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the checkpoint folder the cluster names; a temporary one only where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if configured:
            sc.setCheckpointDir(configured)
        elif sc.master.startswith("local"):
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="rankfield-", dir=os.environ.get("TMPDIR", "/tmp")))
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, where a plan would otherwise be read several times over."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def kept(df: DataFrame, by: str = "series") -> DataFrame:
    """As ``cut``, in compressed Parquet and in buckets of ``by``: a column that is not read costs nothing, and what starts with
    ``by`` moves no rows. For large frames that are partitioned by it already (else each task writes a file for every bucket)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    table = f"kept_{uuid.uuid4().hex}"
    out = df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).option("compression", "zstd")
    out.option("path", f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{table}").saveAsTable(table)
    stored = spark.table(table)
    stored.schema  # resolved, so the files alone are needed from here on
    spark.sql(f"DROP TABLE {table}")
    return stored
