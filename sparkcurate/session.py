"""Session settings and the shared folder used for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast, col, count, lit, octet_length, struct, to_json
from pyspark.sql.functions import sum as spark_sum

#: Settings every job of this package relies on. All of them are ordinary Spark options; a cluster's
#: own defaults win for anything not listed here.
SETTINGS: dict[str, str] = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.optimizer.dynamicPartitionPruning.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    app_name: str = "sparkcurate",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with :data:`SETTINGS`; ``master`` only for local runs."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(SETTINGS)
    if shuffle_partitions is not None:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a fresh temporary folder.
    On a cluster a machine-local folder would lose data with its machine, so that is an error.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="sparkcurate-")
    context.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused path for an intermediate table inside :func:`shared_dir`."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame, packed: bool = False) -> DataFrame:
    """Materialise ``df`` in the shared folder so that later reads neither recompute nor lose it.

    ``packed``: its values are large and compressed already; the writer's buffers for them would lie outside the heap.
    """
    path = fresh_path(df.sparkSession, "table")
    df.write.parquet(path, compression="none" if packed else None)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, max_rows: int = 10_000) -> DataFrame:
    """A join side of checked size: broadcast if it has at most ``max_rows`` rows, else unchanged.

    The check reads at most ``max_rows + 1`` rows. Those rows become a local table, so what led to
    them is not computed again; a larger side stays a distributed join under adaptive execution.
    """
    head = df.limit(max_rows + 1).collect()
    if len(head) > max_rows:
        return df
    return broadcast(df.sparkSession.createDataFrame(head, df.schema))


def broadcast_below(df: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """A stored join side, broadcast if its values take at most ``max_bytes``, else unchanged.

    The size is measured by one pass over all rows, in the form they have as JSON; nothing is collected.
    """
    width = octet_length(to_json(struct(*[col(c) for c in df.columns])))
    size = df.agg(spark_sum(width + lit(16))).first()[0] or 0
    return broadcast(df) if size <= max_bytes else df


def pin(df: DataFrame) -> DataFrame:
    """Mark the computed columns of ``df`` as finished.

    A later filter on a computed column is normally pushed below it by inlining the column's whole
    expression, which then is evaluated once per use. Row metrics are a node no filter passes, and
    they neither shuffle nor copy rows; unused columns are still pruned.
    """
    return df.observe(f"rows-{uuid.uuid4().hex}", count(lit(1)).alias("rows"))


def spread(scan: DataFrame) -> DataFrame:
    """Give CPU-heavy row-local work all cores when a scan has fewer partitions than cores.

    Meant for plain scans. A large input has more splits than cores and is returned unchanged, so
    nothing is shuffled at scale; a small single file would otherwise keep one core busy.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.isStreaming or scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, with batches for Python bounded by bytes in its session, so that long texts cannot add up.

    A session's own smaller bounds stay.
    """
    conf = df.sparkSession.conf
    for key, bound in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 4 << 20)):
        name = f"spark.sql.execution.arrow.{key}"
        now = conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) < bound:
            conf.set(name, str(bound))
    return df
