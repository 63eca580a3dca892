"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tapeloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        # Call sites are not recorded per column, which shortens the building of wide plans.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    safe_unions(spark)
    return spark


def safe_unions(spark: SparkSession) -> None:
    """Have unions claim no partitioning of their own.

    Spark 4.1 lets a union of equally partitioned inputs skip the shuffle of a following grouping.
    With adaptive execution the inputs may be coalesced differently, and equal keys then end up in
    different tasks, which leaves duplicates. Seen with 4.1.2; the setting is read when a plan is made.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


SCOPES: list[list[str]] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; a temporary one only on a single machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is not None:
        folder = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    elif spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix=f"tapeloom-{name}-")
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if SCOPES:
        SCOPES[-1].append(folder)
    return folder


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Folders that operators make inside are deleted at the end, and only those; results must be written before.

    Without a scope they stay, since a result may still have to read them.
    """
    SCOPES.append([])
    try:
        yield
    finally:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for folder in SCOPES.pop():
            spark.sql(f"DROP TABLE IF EXISTS {_table_name(folder)}")
            path = hadoop.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that later plans all read one fixed copy.

    For small results (cut points, sketches, lists of tickers); large tables are ``kept``.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        # For the whole session, so no scope may own it.
        held, SCOPES[:] = list(SCOPES), []
        sc.setCheckpointDir(shared_folder(df.sparkSession, "settled"))
        SCOPES[:] = held
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends, and readers prune columns."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _table_name(folder: str) -> str:
    return "tapeloom_" + folder.rpartition("/")[2].replace("-", "_")


def clustered(df: DataFrame, key: str, *order: str) -> DataFrame:
    """As ``kept``, in as many buckets of ``key`` as the session has shuffle partitions, each sorted by key and ``order``."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared_folder(spark, "clustered")
    spread = df.repartition(buckets, key).sortWithinPartitions(key, *order)
    name = _table_name(path)
    spread.write.format("parquet").bucketBy(buckets, key).sortBy(key, *order).option("path", path).saveAsTable(name)
    return spark.table(name)
