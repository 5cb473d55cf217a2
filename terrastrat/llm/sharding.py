"""Two-pass external shuffle into shards, in DataFrame operations only.

Pass one scatters records into memory-sized buckets by a seeded hash, Fisher-Yates shuffles each
(Spark's ``shuffle`` of an array) and writes them to the shared folder. Pass two lays the buckets end
to end; position ``p`` of that order goes to shard ``p % n`` at slot ``p div n``, so
shard sizes differ by one at most.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastrat.session import shared_folder, written

SEED = 20_240_611
BUCKET_BYTES = 4 << 20
#: Of buckets and shards, which hold all text twice beside the two shuffles.
CODEC = "zstd"


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text, null counting none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def scatter(records: DataFrame, key: str, buckets: int, seed: int = SEED) -> DataFrame:
    """Adds ``bucket``: a seeded hash of the key and of the row's place in the input.

    The place makes rows with one key (null too) spread like any others, so no bucket outgrows its
    share. Files are cut alike on a retry, so a recomputed task yields the same buckets.
    """
    place = F.monotonically_increasing_id()
    return records.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), F.col(key), place), F.lit(buckets)).cast("int"))


def external_shuffle(
    records: DataFrame, key: str, shards: int, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, row_bytes: int = 64, size: Column | None = None
) -> DataFrame:
    """*records* with ``shard`` (int, 0 to shards-1) and ``slot`` (long, gapless from 0 in each shard).

    size: bytes of a record in memory, summed to set the number of buckets; *row_bytes* each where it is
    not given. A bucket, of about *bucket_bytes*, is what one task holds at once. Null keys and repeated
    rows are rows like any others, each with a place of its own. An empty input gives an empty result.
    Columns named bucket, at, shard or slot must not be in *records*.
    """
    total = records.agg(F.sum(F.lit(row_bytes) if size is None else size)).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    names = records.columns
    # pass one: rows meet in their buckets, are ordered and Fisher-Yates shuffled; written, so both reads below see the same
    scattered = scatter(records, key, buckets, seed).repartition(min(buckets, 4096), "bucket")
    gathered = scattered.groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct(*names))).alias("rows"))
    shuffled = gathered.sortWithinPartitions("bucket").select("bucket", F.shuffle("rows", F.lit(seed)).alias("rows"))
    laid = written(shuffled.select("bucket", F.posexplode("rows").alias("at", "row")).select("bucket", "at", "row.*"), CODEC)
    # pass two: the buckets end to end; block sums keep the prefix sum in small windows
    offsets = prefix_offsets(laid.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "n")
    placed = laid.join(offsets.hint("broadcast") if buckets <= 100_000 else offsets, "bucket")
    position = F.col("before") + F.col("at")
    return placed.select(
        *names,
        F.pmod(position, F.lit(shards)).cast("int").alias("shard"),
        F.floor(position / F.lit(shards)).cast("long").alias("slot"),
    )


def prefix_offsets(sizes: DataFrame, key: str, n: str, block: int = 4096) -> DataFrame:
    """``(key, before)``: the sum of *n* over smaller integer keys, by windows of at most *block* keys.

    The sums of whole blocks are few (keys / block rows) and are summed by a second small window.
    """
    from pyspark.sql import Window as W

    blocked = sizes.select(key, n, F.floor(F.col(key) / F.lit(block)).cast("long").alias("b"))
    tops = blocked.groupBy("b").agg(F.sum(n).alias("t"))
    tops = tops.select("b", (F.sum("t").over(W.partitionBy(F.lit(0)).orderBy("b")) - F.col("t")).alias("base"))
    inner = F.sum(n).over(W.partitionBy("b").orderBy(key)) - F.col(n)
    return blocked.withColumn("inner", inner).join(tops, "b").select(key, (F.col("base") + F.col("inner")).cast("long").alias("before"))


def write_shards(
    records: DataFrame, key: str, shards: int, folder: str, text: str = "text", seed: int = SEED, bucket_bytes: int = 16 << 20
) -> DataFrame:
    """Shuffles whole records and writes them as Parquet, one directory a shard; returns them reread.

    A shard's files hold runs of slots, each in slot order and of about *bucket_bytes*.
    """
    size = text_bytes(F.col(text)) + 64
    total, rows = records.agg(F.sum(size), F.count("*")).first()
    placed = external_shuffle(records, key, shards, seed, bucket_bytes, size=size)
    tasks = max(shards, math.ceil((total or 0) / bucket_bytes))
    run = max(1, math.ceil(rows / tasks))
    ordered = placed.repartition(min(tasks, 4096), "shard", F.floor(F.col("slot") / F.lit(run))).sortWithinPartitions("shard", "slot")
    ordered.write.mode("overwrite").partitionBy("shard").parquet(folder, compression=CODEC)
    return records.sparkSession.read.schema(placed.schema).parquet(folder)


def op2_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written in 24 shards under the law ``rows`` (counts differ by one at most), as read from the shards."""
    folder = f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}.shards"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = write_shards(docs, "doc_id", 24, folder)
    # as in session.written, the shards go when the application ends
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return back.select(
        "doc_id",
        (text_bytes(F.col("text")) + 8).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
