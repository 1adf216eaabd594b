"""Session settings the library relies on, and the shared folder for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Runtime settings: adaptive execution coalesces small shuffles and splits skewed join partitions.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",  # split a skewed join even if that costs a shuffle
    # the JVM only interprets methods above 8000 bytes; past that limit Spark then splits a wide
    # projection into small methods instead of fusing it with its neighbours
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


SHUFFLE_BYTES = 128 << 20  # shuffled data one task should get


def shuffle_partitions(input_bytes: int) -> int:
    """Shuffle partitions for an input of this size; adaptive execution merges what turns out small."""
    return max(200, -(-input_bytes // SHUFFLE_BYTES))


def build_session(
    master: str | None = None, app: str = "tabulane", input_bytes: int | None = None, **conf: str
) -> SparkSession:
    """A session with the runtime settings, shuffles sized for `input_bytes`.

    `master` and `conf` are for tests and benches.
    """
    builder = SparkSession.builder.appName(app)
    if input_bytes is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions(input_bytes)))
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by `spark.checkpoint.dir`.

    Only a local session (tests) without that setting gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tabulane-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut_lineage(df):
    """Write `df` to the shared checkpoint folder, so later jobs see the very same rows."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
