"""Importance resampling towards a target's distribution of hashed word runs.

Identical texts are collapsed by grouping the full text; features are computed and weighed once a text,
counts are multiplied by its rows, and weights are joined back before each document's own noise.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastrat.llm import shingles
from terrastrat.operators.ranking import numbered
from terrastrat.session import cut, small_join, written

BUCKETS, LEAST_WORDS, PERCENT, SEED = 10_000, 20, 25, 7
#: In UTF-8 all bytes of characters beyond ASCII are 0x80 or more, so words can be found in bytes.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def features(text: bytes, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the buckets of all single words and pairs of neighbours, ascending, repeats included."""
    words = WORD.findall(text.lower())  # bytes are lower-cased in ASCII only
    single = [zlib.crc32(w) for w in words]
    double = [zlib.crc32(b" " + w, c) for w, c in zip(words[1:], single, strict=False)]
    return len(words), np.sort(np.array(single + double, np.uint32) % np.uint32(buckets))


def featured(documents: DataFrame, text: str, buckets: int) -> DataFrame:
    """``(digest, rows, n_words, n_features, steps)`` of every distinct text, null as empty, as a table.

    digest: SHA-256 of the text. steps: differences of its ascending buckets, which compress to about a byte each.
    """
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def count(batches):
        for batch in batches:
            sizes, texts = [], batch.column(2).cast(pa.binary())
            for lo, hi in shingles.runs(texts, size=lambda t: t.as_buffer().size):
                found = [features(t.as_py(), buckets) for t in texts[lo:hi]]
                sizes = [len(b) for _, b in found]
                steps = [np.diff(b, prepend=np.uint32(0)).astype(kind).tobytes() for _, b in found]
                part = batch.slice(lo, hi - lo)
                columns = [part.column(0), part.column(1), pa.array([n for n, _ in found], pa.int64()), pa.array(sizes, pa.int64()), pa.array(steps, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "rows", "n_words", "n_features", "steps"])

    distinct = documents.groupBy(F.coalesce(F.col(text), F.lit("")).alias("_t")).agg(F.count("*").alias("rows"))
    rows = distinct.select(F.unhex(F.sha2("_t", 256)).alias("digest"), "rows", "_t")
    return written(rows.mapInArrow(count, "digest binary, rows long, n_words long, n_features long, steps binary"), "zstd")


def buckets_of(steps: pa.Scalar, buckets: int) -> np.ndarray:
    return np.frombuffer(steps.as_buffer(), np.uint16 if buckets <= 1 << 16 else np.uint32).cumsum(dtype=np.int64)


def bucket_counts(featured_texts: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows: one vector a task, summed by bucket; the driver gets *buckets* numbers."""

    def tally(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for rows, steps in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total += rows * np.bincount(buckets_of(steps, buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    summed = featured_texts.select("rows", "steps").mapInArrow(tally, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in summed.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down, of every bucket."""
    buckets, all_source, all_target = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (all_source + buckets) / ((float(s) + 1) * (all_target + buckets)))) for s, t in zip(source, target, strict=True)], np.int64)


def weights(featured_texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """``(digest, n_words, n_features, weight)``: the mean gain of a text's features, rounded down; 0 without features."""
    buckets = len(gain)

    def weigh(batches):
        for batch in batches:
            n = batch.column(2).to_numpy()
            total = np.array([gain[buckets_of(s, buckets)].sum() for s in batch.column(3)], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total // np.maximum(n, 1))], names=["digest", "n_words", "n_features", "weight"])

    rows = featured_texts.select("digest", "n_words", "n_features", "steps")
    return cut(rows.mapInArrow(weigh, "digest binary, n_words long, n_features long, weight long"))


def resample(
    documents: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text",
    buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """``(key, n_features, weight, score, rank)`` of every row of *documents*.

    score: the weight plus Gumbel noise of the key in thousandths, so the highest *percent* hundredths of
    the scores, among documents of at least *least_words* words, are a draw without replacement by
    importance. rank: 1, 2, ... among those drawn, else null. Null texts have no features and weight 0;
    a null key draws noise as an empty one and loses ties; rows that share key and text share a score and
    have neighbouring ranks. An empty target leaves smoothed shares; an empty table gives an empty
    result. One text that a third of all rows repeat is counted once and multiplied.
    """
    texts = featured(documents, text, buckets)
    gain = gains(bucket_counts(texts, buckets), bucket_counts(featured(target, target_text, buckets), buckets))
    named = documents.select(F.col(key).alias("_key"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"))
    rows = small_join(named, weights(texts, gain), "digest")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((drawn + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = rows.select("_key", "digest", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("_fit"))
    placed = numbered(scored, F.desc("_fit"), F.desc("score"), F.asc_nulls_last("_key"), "digest", out="_rn")
    taken = percent * placed.filter("_fit").count() // 100
    rank = F.when(F.col("_rn") <= taken, F.col("_rn")).cast("long")
    return placed.select(F.col("_key").alias(key), "n_features", "weight", "score", rank.alias("rank"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark's distribution."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
