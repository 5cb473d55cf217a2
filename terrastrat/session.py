"""Session set-up, shared-folder checkpoints and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Above this many rows, or bytes of them, a side is never broadcast by :func:`small_join`.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 32 << 20


def local_session(cores: str = "8", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that results depend on (UTC) and AQE."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("terrastrat")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where it is unset and all runs on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if not current and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = current or "file://" + tempfile.mkdtemp(prefix="terrastrat-")
        if not current:
            spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: *df* as a table in the shared folder, which survives lost executors.

    A table's size estimate is that of its files, whereas a checkpoint keeps the estimate of the plan that
    it replaces; in a loop of joins that one doubles its digits every round until the planner fails.
    """
    return written(df)


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """As :func:`cut`; codec: of the Parquet files, the session's own if not given. The table goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path, compression=codec)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Within it, actions pass rows to Python in Arrow batches of about *size*: long texts come few at a time.

    The session's own setting is put back at the end, so only what is computed inside is affected.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def size_of(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes) of *df*, bytes as unsafe rows take them, by one aggregate. Arrays count as their text does."""
    width = F.lit(16 + 8 * len(df.columns))
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
        elif kind in ("array", "map", "struct"):
            width = width + F.coalesce(F.octet_length(F.col(f"`{field.name}`").cast("string")), F.lit(0))
    rows, total = df.agg(F.count("*"), F.sum(width.cast("long"))).first()
    return rows, total or 0


def small_join(left: DataFrame, right: DataFrame, on, how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join in which *right* is broadcast only if it is measured to hold at most *rows* rows and BROADCAST_BYTES.

    *right* should be materialised (see :func:`cut`) and narrow. Beyond the bound both sides are
    shuffled and AQE may split skewed partitions.
    """
    n, size = size_of(right)
    return left.join(F.broadcast(right) if n <= rows and size <= BROADCAST_BYTES else right.hint("merge"), on, how)
