"""Where operators keep what they read more than once."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import rankfield
from rankfield.session import ensure_checkpoint_dir


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the checkpoint folder of the session, which driver and executors share."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        ensure_checkpoint_dir(spark)
        configured = spark.sparkContext.getCheckpointDir()
    return f"{configured.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: computed once, safe against lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, column: str, name: str) -> DataFrame:
    """As ``stored``, but in as many buckets of ``column`` as a shuffle has partitions: later joins on it don't move the rows."""
    spark = df.sparkSession
    path = folder(spark, name)
    table = path.rpartition('/')[2].replace('-', '_')
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.schema  # resolved, so the files alone are needed from here on
    spark.sql(f"DROP TABLE {table}")
    return out


def row_key(docs: DataFrame) -> Column:
    """A digest of a row's columns, the text by its own digest: rows of one key are equal."""
    others = F.to_json(F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != "text")))
    return F.md5(F.concat_ws("|", F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("-")), others).cast("binary"))


_shipped: set[str] = set()


#: Whole texts are long: fewer rows per Arrow batch than Spark's default of 10,000.
BATCH_ROWS = 2000


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, as ``--py-files`` would.

    The registered queries and the pipeline start with it. It also lowers the session's Arrow batches to BATCH_ROWS.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS or int(spark.conf.get(key)) <= 0:
        spark.conf.set(key, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(rankfield.__file__).parent
        packed = Path(tempfile.mkdtemp(prefix="rankfield-")) / "rankfield_package.zip"
        with zipfile.ZipFile(packed, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(packed))
        _shipped.add(app)
    return spark
