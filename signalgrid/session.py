"""Session helpers: the shared folder, lineage cuts and table-size bounds."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
#: Folders of local sessions that name none, by application.
_LOCAL_FOLDERS: dict[str, str] = {}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "signalgrid") -> SparkSession:
    """A session for tests and the single-node benchmark; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster.

    Only a local master may fall back to a temporary folder of its own.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not configured:
        # local-cluster is a cluster: its executors have folders of their own.
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder shared by the cluster")
        key = spark.sparkContext.applicationId
        configured = _LOCAL_FOLDERS.get(key) or _LOCAL_FOLDERS.setdefault(key, tempfile.mkdtemp(prefix="spark-"))
    return configured.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    This cuts lineage with data that outlives any executor, and the copy has exact
    footers, so later scans prune columns and know their row counts.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_rows(spark: SparkSession, path: str) -> int:
    """Row count of a Parquet table, answered from its footers."""
    return spark.read.parquet(path).count()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows over all shuffle partitions by key.

    For rows that are few and light but cost much compute: adaptive execution would merge
    their small partitions into a handful of tasks, and leaves a stated number alone.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
