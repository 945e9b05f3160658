"""Session defaults, checkpoint location and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "recollect", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume; `conf` overrides any of them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a temporary one only on a local master."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="recollect-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan with fewer partitions than there are cores, dealt out to all of them. The
    number is known from the file list. Large tables have more partitions than cores and are
    left as they are, unshuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


# Bytes of an Arrow batch of whole texts. Spark's own bounds (10,000 rows, 64 MB) let a batch of long texts fill the buffers
# outside the heap of the executor and those of each Python worker, which neither gives back.
BATCH_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on batches of this session go to Python in pieces of about `BATCH_BYTES`; plans are run after they are
    returned, so the setting stays."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


# Above this many rows a result is written to the checkpoint folder rather than held.
HELD_ROWS = 1_000


def hold(df: DataFrame, at_most: int) -> DataFrame:
    """A result of at most `at_most` rows, computed once. Small ones, like the hits of a search,
    are kept in the plan as literal rows; the bound is the caller's limit, not a hope."""
    if at_most > HELD_ROWS:
        return cut_lineage(df)
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)


def cut_and_count(df: DataFrame) -> tuple[DataFrame, int]:
    """`cut_lineage` and the number of rows, counted while they are written."""
    rows = Observation()
    return cut_lineage(df.observe(rows, F.count(F.lit(1)).alias("n"))), rows.get["n"]


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write `df` to the checkpoint folder and read it back, so that later steps neither
    recompute it nor see other rows after an executor is lost. As a Parquet table it also
    carries its size, by which Spark chooses joins, and is read by column."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/recollect-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut_and_free(df: DataFrame) -> DataFrame:
    """`cut_lineage`, after which Spark deletes the shuffle files of the write; otherwise they stay until the driver's heap is collected."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        return cut_lineage(df)
    finally:
        conf.set(key, before)
