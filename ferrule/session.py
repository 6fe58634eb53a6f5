"""Session helpers: defaults, the shared folder, and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_session(app: str = "ferrule", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and bench use; on a cluster pass your own session instead."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, named by `spark.checkpoint.dir`. Only on one machine may that be unset
    (tests): a temporary folder is made then and recorded in the session. On a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("ferrule.shared.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="ferrule-")
        spark.conf.set("ferrule.shared.dir", found)
    return found.rstrip("/")


def session_dir(spark: SparkSession) -> str:
    """This session's own folder below the shared one."""
    mark = spark.conf.get("ferrule.session", None)
    if not mark:
        mark = f"{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
        spark.conf.set("ferrule.session", mark)
    return f"{shared_dir(spark)}/ferrule/{mark}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts the lineage, keeps Python stages from
    running twice, and survives the loss of executors (the files do not live on them)."""
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int = 200_000, size: int = 32 * 1024 * 1024) -> DataFrame:
    """A join side of a few short columns, written once; broadcast if it has at most `most` rows and `size` bytes in
    its files, else left to a shuffle join. Both are measured, so what is sent to the executors has a proven bound."""
    kept = materialize(df, "side")
    held = int(kept._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())  # of the files just written
    return F.broadcast(kept) if held <= size and kept.limit(most + 1).count() <= most else kept


def spread(df: DataFrame) -> DataFrame:
    """`df` over at least as many partitions as there are cores. A scan of many files or row groups stays as
    it is, without a shuffle; only a table that is one small file is dealt out to all cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def release(spark: SparkSession) -> None:
    """Delete the tables that `materialize` wrote for this session; call it when no result built on them is needed
    any more. Tables of other sessions stay."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
