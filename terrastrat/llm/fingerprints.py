"""MinHash fingerprints, and near duplicates by joining signature bands and verifying Jaccard."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastrat.llm import jaccard_join, shingles
from terrastrat.session import cut, small_join

LANES, SEED = 128, 1_009


def lanes(texts: list[bytes], k: int = LANES, seed: int = SEED) -> np.ndarray:
    """Signatures of texts (rows x k, uint16): the low halves of k permutations' least values over five-word shingles.

    Texts of one to four words have one shingle; texts without words have all lanes full, so equal
    texts always have equal lanes.
    """
    out = np.empty((len(texts), k), np.uint16)
    for lo, hi in shingles.runs(texts):
        w = shingles.Words(texts[lo:hi])
        h, begin = shingles.shingles(w.hash, w.first)
        out[lo:hi] = shingles.minhash(h, begin, k, seed).astype(np.uint16)
    return out


def as_text(sig: np.ndarray) -> list[str]:
    """Fingerprints as hexadecimal text, four digits a lane."""
    return [row.tobytes().hex() for row in sig.astype(">u2")]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal lanes: the MinHash estimate of the Jaccard similarity."""
    return (a == b).mean(axis=1)


def ranges_of(documents: DataFrame, key: str, parts: int) -> tuple[list, dict, tuple | None]:
    """Lower bounds of up to *parts* key ranges (keys that occur), the least text digest at each, and the first row.

    The driver gets one number a range.
    """
    keys = documents.select(key)
    accuracy = max(10_000, 20 * parts)
    at = [i / parts for i in range(1, parts)] or [0.5]
    found, low = keys.agg(F.percentile_approx(key, at, accuracy), F.min(key)).first()
    bounds = sorted({b for b in found or [] if b > low}) if parts > 1 else []
    digest = F.xxhash64(F.coalesce("_t", F.lit("")))
    rows = documents.select(F.col(key).alias("_k"), F.col("_t"))
    first = rows.filter(F.col("_k").isNull() | (F.col("_k") == F.lit(low))).agg(F.min(F.struct(F.col("_k").isNotNull().alias("some"), "_k", digest.alias("d")))).first()[0]
    least = {r["_k"]: r["d"] for r in rows.filter(F.col("_k").isin(bounds)).groupBy("_k").agg(F.min(digest).alias("d")).collect()} if bounds else {}
    return bounds, least, None if first is None else (first["_k"], first["d"])


def with_next(documents: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """Rows ``(part, key, digest, role, text)`` laid out in key order, one range of keys a partition.

    role 0: a document; 1: a copy of the document after the partition's last (after the last of all,
    the first), which sorts to the end. So every document is followed by its next in one partition,
    and texts are shuffled once. Keys ascend, nulls first; ties by the text's hash.
    """
    kind = documents.schema[key].dataType.simpleString()
    docs = documents.select(F.col(key), F.col(text).alias("_t"))
    bounds, least, first = ranges_of(docs, key, parts)
    limits = np.array(bounds, np.int64)
    last_part = len(bounds)

    def lay(batches):
        for batch in batches:
            keys, digests = batch.column(0), batch.column(1)
            k = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.where(keys.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(limits, k, side="right")).astype(np.int32)
            d = digests.to_numpy()
            at, to = np.arange(len(k)), part
            own = np.flatnonzero(np.isin(k, limits)) if len(limits) else np.zeros(0, np.int64)
            own = np.array([i for i in own if keys[int(i)].is_valid and least[int(k[i])] == d[i]], np.int64)
            ends = [i for i in np.flatnonzero(d == first[1]) if keys[int(i)].as_py() == first[0]] if first else []
            at = np.concatenate([at, own, np.array(ends, np.int64)])
            to = np.concatenate([to, part[own] - 1, np.full(len(ends), last_part, np.int32)]).astype(np.int32)
            role = np.concatenate([np.zeros(len(k), np.int32), np.ones(len(own) + len(ends), np.int32)])
            rows = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(to), rows.column(0), rows.column(1), pa.array(role), rows.column(2)], names=["part", "key", "digest", "role", "text"])

    rows = docs.select(key, F.xxhash64(F.coalesce("_t", F.lit(""))).alias("digest"), F.coalesce("_t", F.lit("")).alias("text"))
    laid = rows.mapInArrow(lay, f"part int, key {kind}, digest long, role int, text string")
    return laid.repartitionById(last_part + 1, F.col("part")).sortWithinPartitions("role", F.asc_nulls_first("key"), "digest")


def fingerprint(documents: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """``(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)`` of every row.

    The edited text has its last half replaced from the next document's beginning. Null texts are
    empty; rows of one key are each other's next, in the order of their texts' hashes; the only
    document is its own next; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = documents.schema[key].dataType.simpleString()
    names = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def prints(batches):
        waiting: list[tuple] = []  # documents in order; the last has not met its next
        size = 0

        def done(last: bool):
            nonlocal waiting, size
            texts = [t for _, t, _ in waiting]
            sig = lanes([t.encode() for t in texts])
            keys, edited, places = [], [], []
            for i, (k, t, role) in enumerate(waiting[:-1]):
                if role == 0:
                    half = len(t) // 2
                    keys.append(k)
                    places.append(i)
                    edited.append((t[: len(t) - half] + texts[i + 1][:half]).encode())
            waiting = [] if last else waiting[-1:]
            size = sum(len(t) for _, t, _ in waiting)
            if not keys:
                return None
            other, at = lanes(edited), np.array(places)
            columns = [
                pa.array(keys, pa.int64()),
                pa.array([len(texts[i]) for i in places], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
                pa.array(as_text(sig[at])),
                pa.array(as_text(other)),
                pa.array(likeness(sig[at], other)),
                pa.array(likeness(sig[at], sig[at + 1])),
            ]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for k, role, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if role and waiting and waiting[-1][2]:
                    continue  # repeated rows may copy the next document more than once
                t = t.as_py()
                waiting.append((k, t, role))
                size += len(t)
                if size >= shingles.RUN_BYTES and len(waiting) > 1 and (out := done(False)) is not None:
                    yield out
        if waiting and (out := done(True)) is not None:
            yield out

    laid = with_next(documents, key, text, parts).select("key", "role", "text")
    schema = f"key {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return laid.mapInArrow(prints, schema).withColumnRenamed("key", key)


def band_buckets(sets: DataFrame, bands: int = 32) -> DataFrame:
    """``(bucket, id)``: sets ``(id, sig)`` that agree in a whole band of their fingerprint, from bands that two or more share.

    Thirty-two bands of four lanes miss a pair of similarity 0.8 with probability below 1e-7.
    """
    rows = LANES // bands

    def cut_bands(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), np.uint32).astype(np.uint16).reshape(-1, bands, rows).astype(np.uint64)
            name = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), sig.shape[:2])
            for j in range(rows):
                name = shingles.mixed(name * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, j])
            ids = np.repeat(batch.column(0).to_numpy(), bands)
            yield pa.RecordBatch.from_arrays([pa.array(name.reshape(-1).view(np.int64)), pa.array(ids)], names=["bucket", "id"])

    named = cut(sets.select("id", "sig").mapInArrow(cut_bands, "bucket long, id long"))
    shared = cut(named.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1").select("bucket"))
    return small_join(named, shared, "bucket")


def near_duplicates(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Classes of near copies as :func:`terrastrat.llm.jaccard_join.match` gives them, met by joining bands of their fingerprints."""
    return jaccard_join.match(documents, key, text, buckets_of=band_buckets, positions=LANES, seed=SEED)


def op10_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint(spark.read.parquet(f"{sf_dir}/documents.parquet"))
