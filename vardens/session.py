"""Session helpers: a local session for tests/bench and the checkpoint folder.

Iterative operators (connected components, multi-level clustering) cut their lineage with
``DataFrame.checkpoint()``, which writes to the shared folder named by the cluster in
``spark.checkpoint.dir``.  That setting is read from the session; a folder of our own is
only chosen when it is unset *and* the master is local (tests, bench).
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "vardens") -> SparkSession:
    """A local session configured like the tests and the bench (UI off, AQE on, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder, setting a scratch one only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir is not set: iterative operators need a shared folder "
            "(HDFS/S3/...) to checkpoint to on a cluster"
        )
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="vardens-ckpt-"))
    return sc.getCheckpointDir()


#: Tables that this process has written by ``checkpoint`` and not removed.
_written: list[str] = []


def written(path: str) -> None:
    """Note a table written in the checkpoint folder by other means, for ``remove_checkpoints``."""
    _written.append(path)


def remove_checkpoints(spark: SparkSession) -> int:
    """Delete the tables that ``checkpoint`` has written in this process; their number.

    For the end of a job: frames that still read them fail afterwards.
    """
    n = len(_written)
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n


#: Most bytes of a table that Spark may choose to broadcast.  It goes by the bytes of files and
#: shuffles, which encode ids and cells tightly; the hash table that the driver builds of 10 MB
#: (Spark's default) takes hundreds, and several are built at a time.
BROADCAST_BYTES = 1 << 20
BROADCAST_SETTINGS = {  # with what holds when they are not set; the second follows the first
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


def bound_broadcasts(spark: SparkSession) -> None:
    """Lower the session's bounds of automatic broadcasts to ``BROADCAST_BYTES``; smaller ones,
    off (-1) included, stay as they are."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, unset in BROADCAST_SETTINGS.items():
        now = spark.conf.get(name, unset)
        if not now.startswith("-") and size(now) > BROADCAST_BYTES:
            spark.conf.set(name, str(BROADCAST_BYTES))


#: Files of a query's shuffles are deleted when it has ended.
CLEAN_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """For writes: what is shuffled for a table is not read again once the table stands, and
    without this its files stay until the driver happens to collect garbage."""
    before = spark.conf.get(CLEAN_SETTING, "false")
    spark.conf.set(CLEAN_SETTING, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN_SETTING, before)


def checkpoint(df, row_group_rows: int | None = None):
    """Write ``df`` as Parquet under the reliable checkpoint folder and read it back.

    One job, columnar, and the lineage of the result starts at the written files, so a
    lost executor never forces a re-run of the steps before it; its shuffles' files go when
    it has ended.  ``row_group_rows`` is for tables of few, very large rows: a reader holds a
    row group's rows at once.
    """
    return parquet_table(df, row_group_rows)


def parquet_table(df, row_group_rows: int | None = None, by: str | None = None):
    """``checkpoint``, in a folder for each value of ``by``."""
    spark = df.sparkSession
    bound_broadcasts(spark)
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if row_group_rows:
        writer = writer.option("parquet.block.row.count.limit", str(row_group_rows))
    if by:
        writer = writer.partitionBy(by)
    with shuffles_removed(spark):
        writer.parquet(path)
    _written.append(path)
    return spark.read.parquet(path)


BATCH_BYTES, BATCH_SETTING = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_map(df, fn, schema: str):
    """``mapInArrow`` whose batches hold about ``BATCH_BYTES``, however long the texts are.

    Spark bounds a batch by rows; of long texts 10,000 rows outgrow a worker.  The bound by
    bytes is a setting of the session, which is set here when it is unset or larger.
    """
    conf = df.sparkSession.conf
    now = conf.get(BATCH_SETTING)
    if not now.isdecimal() or int(now) > BATCH_BYTES:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)
