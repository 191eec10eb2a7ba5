"""Session helpers: a configured SparkSession and the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: rows that one task of a training pass holds, about
ROWS_PER_TASK = 250_000
#: times its equal share of the rows that one split may have
UNEVEN = 2

_written: list[str] = []        # scratch folders of this process, oldest first

# Settings a job needs regardless of cluster size.  Everything else
# (executor memory, shuffle partitions on a real cluster) is the caller's.
_BASE_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app_name: str = "incidentlab",
                shuffle_partitions: int | None = None,
                conf: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE and skew-join handling on."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(_BASE_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for k, v in settings.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is a shared folder set by the operator of the cluster and
    is only read here; a cluster session without it is refused, since executors
    could not see each other's files.  Only a local session without the setting
    gets a private folder under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or \
        spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="incidentlab-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for intermediate tables,
    owned by this process until ``release_tables``."""
    base = ensure_checkpoint_dir(spark)
    # checkpoint dirs come back as URIs (file:/..., hdfs://...); keep the scheme
    path = base.rstrip("/") + f"/incidentlab-scratch/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage by a reliable checkpoint in the shared folder (survives the
    loss of executors, unlike a local checkpoint or cache).  Its files live until
    ``release_tables``."""
    ensure_checkpoint_dir(df.sparkSession)
    cut = df.checkpoint(eager=True)
    files = cut._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if files.isDefined():
        _written.append(files.get())
    return cut


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing ``df`` as parquet under the shared checkpoint
    folder and reading it back.  Later passes read only the columns they use
    (compressed, columnar), which matters for iterative training.

    The table lives until ``release_tables`` is called for it."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def tables_written() -> int:
    """A mark for ``release_tables``: what is written from here on."""
    return len(_written)


def release_tables(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete the scratch tables, files and checkpoints this process wrote after the
    mark ``since``, all but the newest ``keep``; returns how many.  Frames that read
    them must not be used afterwards."""
    until = max(since, len(_written) - keep)
    paths = _written[since:until]
    del _written[since:until]
    jvm = spark._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Owns all scratch data written inside and deletes it at the end, also after an
    error: write or collect the result before leaving."""
    since = tables_written()
    try:
        yield
    finally:
        release_tables(spark, since)


def partition_rows(df: DataFrame) -> tuple[int, int]:
    """The rows of ``df`` and of its largest partition, by one count that reads no
    column (of a parquet file only the footer)."""
    each = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"))
    rows, largest = each.agg(F.sum("n"), F.max("n")).first()
    return rows or 0, largest or 0


def bounded_tasks(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df`` with about ``most`` rows (default ``ROWS_PER_TASK``) per partition at most,
    for steps that hold a partition's rows in memory, as tree training does.

    Small columns make short files, of which Spark packs ever more into one task; so
    rows are dealt round-robin when a partition has more, over a multiple of the
    default parallelism (whole waves of tasks).  Otherwise ``df`` stays as it is.
    """
    most = most or ROWS_PER_TASK
    rows, largest = partition_rows(df)
    if largest <= most:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * -(-rows // (cores * most)))


def spread(df: DataFrame, min_partitions: int | None = None, by_rows: bool = False) -> DataFrame:
    """Give CPU-heavy per-row work at least ``min_partitions`` tasks (default:
    the cluster's default parallelism).

    A large input already has far more splits than that and passes through
    untouched (no shuffle); a small or unsplittable one (a single row group,
    one gzip file) is spread round-robin so the per-row work uses every core.
    Apply it to a source right after reading: counting partitions plans the
    frame, which would run any shuffle stage upstream of it.

    ``by_rows`` is for parquet sources: a row group is read whole by one split, so of
    the splits of a file with few row groups most are empty.  The rows are then counted
    too, and also spread when a split has over ``UNEVEN`` times a task's equal share.
    """
    if df.isStreaming:
        return df     # micro-batches are sized by the source's own options
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= target:
        if not by_rows:
            return df
        rows, largest = partition_rows(df)
        if largest * target <= UNEVEN * rows:
            return df
    return df.repartition(target)
