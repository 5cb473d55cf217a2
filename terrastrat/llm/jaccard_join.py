"""N-gram Jaccard join by chosen paths.

Each distinct shingle set is embedded as the tokens (position, least hash) of POSITIONS permutations,
of which two sets share a part near their Jaccard similarity. A run splits the sets recursively: at
each node tokens are sampled at rate 1 / (threshold * POSITIONS), the same ones for all sets, and a set
follows every sampled token that it holds into the bucket of that token. Buckets of up to LEAF sets are
compared by brute force; larger ones are split again down to MAX_DEPTH and then compared in blocks.
Runs are repeated until a pair at the threshold is met with the target recall. What is met is verified
exactly (see :mod:`terrastrat.llm.linking`).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastrat.llm import linking, shingles
from terrastrat.session import cut, small_batches, small_join

THRESHOLD, RECALL = 0.8, 0.999
POSITIONS, SEED = 64, 4_211
LEAF, MAX_DEPTH = 256, 3
#: Sets whose sketches agree in this share of lanes are verified; four deviations below the threshold.
LIKELY = 0.6


def survival(depth: int, threshold: float = THRESHOLD, positions: int = POSITIONS) -> float:
    """The chance that a pair at the threshold still shares a node *depth* levels down."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - p / positions) ** positions  # each position: sampled 1/(threshold t), shared threshold
    return p


def runs_for(recall: float = RECALL, depth: int = MAX_DEPTH) -> int:
    """Runs after which a pair at the threshold has been met with probability *recall*."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


def distinct_sets(documents: DataFrame, key: str, text: str, positions: int = POSITIONS, seed: int = SEED) -> DataFrame:
    """``(key, h, rid, k1, k2, sig)`` of every row: hash of the text, row number, 128-bit hash of the shingle set, embedding."""
    kind = documents.schema[key].dataType.simpleString()

    def embed(batches):
        for batch in batches:
            sizes = [len(t.as_py()) for t in batch.column(3)]
            for lo, hi in shingles.runs(sizes, size=lambda n: n):
                part = batch.slice(lo, hi - lo)
                w = shingles.Words([t.as_py().encode() for t in part.column(3)])
                h, begin = shingles.shingles(w.hash, w.first)
                sig = shingles.minhash(h, begin, positions, seed)
                k = np.zeros((2, hi - lo), np.uint64)
                for i, (a, b) in enumerate(zip(begin[:-1], begin[1:], strict=True)):
                    u = np.unique(h[a:b])
                    k[0, i] = shingles.mixed(u).sum(dtype=np.uint64) + np.uint64(len(u))
                    k[1, i] = np.bitwise_xor.reduce(shingles.mixed(u + np.uint64(0x5851F42D4C957F2D))) if len(u) else 0
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], *[pa.array(x.view(np.int64)) for x in k], pa.array([r.tobytes() for r in sig], pa.binary())],
                    names=["key", "h", "rid", "k1", "k2", "sig"],
                )

    t = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(key), F.xxhash64(t).alias("h"), F.monotonically_increasing_id().alias("rid"), t.alias("_t"))
    return rows.mapInArrow(embed, f"key {kind}, h long, rid long, k1 long, k2 long, sig binary")


def _paths(sets: DataFrame, path: bool, runs: int, threshold: float) -> DataFrame:
    """``(path, id)``: the children of each set's nodes; without *path*, those of all runs' roots."""
    below = np.uint64(int((1 << 64) / (threshold * POSITIONS)))
    place = shingles.mixed(np.arange(1, POSITIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    roots = shingles.mixed(np.arange(1, runs + 1, dtype=np.uint64) + np.uint64(SEED))

    def children(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), np.uint32).reshape(-1, POSITIONS).astype(np.uint64)
            ids = batch.column(0).to_numpy()
            nodes = [batch.column(2).to_numpy().view(np.uint64)] if path else [np.full(len(ids), r, np.uint64) for r in roots]
            for node in nodes:
                chosen = shingles.mixed(node[:, None] ^ place[None, :]) < below if path else np.broadcast_to(shingles.mixed(node[:1, None] ^ place[None, :]) < below, sig.shape)
                row, col = np.nonzero(chosen)
                child = shingles.mixed(node[row] * np.uint64(0xD1342543DE82EF95) + place[col] + shingles.mixed(sig[row, col]))
                yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), pa.array(ids[row])], names=["path", "id"])

    return sets.select("id", "sig", *(["path"] if path else [])).mapInArrow(children, "path long, id long")


def buckets(sets: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """``(bucket, id)``: the leaves that hold two sets or more, leaves of the same sets once."""
    runs = runs_for(recall)
    nodes, leaves = cut(_paths(sets, False, runs, threshold)), None
    for depth in range(1, MAX_DEPTH + 1):
        mark = F.xxhash64("id")
        sizes = nodes.groupBy("path").agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.min("id").alias("a"), F.max("id").alias("b"))
        crowded = cut(sizes.filter("n > 1"))
        final = F.lit(True) if depth == MAX_DEPTH else F.col("n") <= LEAF
        once = cut(crowded.filter(final).groupBy("n", "x", "a", "b").agg(F.min("path").alias("bucket")).select("bucket"))
        found = small_join(nodes, once, nodes["path"] == once["bucket"]).select("bucket", "id")
        leaves = found if leaves is None else leaves.unionByName(found)
        if depth == MAX_DEPTH:
            break
        large = cut(crowded.filter(F.col("n") > LEAF).select("path"))
        if large.isEmpty():
            break
        deeper = small_join(nodes, large, "path").select("path", "id")
        nodes = cut(_paths(deeper.join(sets.select("id", "sig"), "id"), True, runs, threshold))
    return cut(leaves)


def repeated_rows(rows: DataFrame, key: str) -> bool:
    """Whether some row's key and text occur twice."""
    return not rows.groupBy(key, "h").count().filter("count > 1").isEmpty()


def match(documents: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, recall: float = RECALL, buckets_of=None, positions: int = POSITIONS, seed: int = SEED) -> DataFrame:
    """``(key, h, rid, class_id, copy_of, links, linked_documents, keep)`` of every row.

    Rows with equal sets of five-word shingles (all equal texts; all texts without words) are copies:
    copy_of is their least key. links counts other such sets of Jaccard >= threshold, linked_documents
    their rows and the row's own copies. class_id is the least key that links lead to. keep marks one
    row of each class. Texts of one to four words have one shingle. Keys may be null or repeat: rows
    are told apart by rid, and null keys come last among least ones. An empty table gives an empty one.
    buckets_of: gives candidate buckets ``(bucket, id)`` of ``(id, sig)`` in place of chosen paths, for
    which signatures may have other *positions* and another *seed*.
    """
    with small_batches(documents.sparkSession):
        rows = cut(distinct_sets(documents, key, text, positions, seed))
    sets = rows.groupBy("k1", "k2").agg(
        F.count("*").alias("weight"),
        F.min("rid").alias("id"),
        F.min_by(F.struct("key", "h", "sig"), "rid").alias("row"),
        F.min("key").alias("copy_of"),
    )
    sets = cut(sets.select("k1", "k2", "weight", "id", "copy_of", F.col("row.key").alias("key"), F.col("row.h").alias("h"), F.col("row.sig").alias("sig")))

    def low(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(x.as_py() for x in batch.column(1)), np.uint32).reshape(-1, positions).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in sig], pa.binary())], names=["id", "sketch"])

    sketches = sets.select("id", "sig").mapInArrow(low, "id long, sketch binary")
    likely = linking.likely_links(buckets_of(sets) if buckets_of else buckets(sets, threshold, recall), sketches, positions, LIKELY)
    docs = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("h", F.xxhash64("_t"))
    if repeated_rows(rows, "key"):
        docs = docs.dropDuplicates(["key", "h"])

    def sets_of(clusters: DataFrame) -> DataFrame:
        wanted = cut(clusters.join(sets.select("id", "weight", F.col("key").alias("_k"), F.col("h").alias("_h")), "id"))
        texts = small_join(docs, wanted, (docs["h"] == wanted["_h"]) & docs["key"].eqNullSafe(wanted["_k"]))
        return linking.with_sets(texts, ["cluster", "id", "weight"], "_t")

    counts, components = linking.groups(likely, sets_of, threshold)
    linked = cut(components.join(counts, "id").join(sets.select("id", "k1", "k2", "weight", "copy_of"), "id"))
    heads = cut(linked.groupBy("component").agg(F.min("copy_of").alias("class_id"), F.min("id").alias("head")))
    linked = small_join(linked, heads, "component").select("k1", "k2", "class_id", "head", "copy_of", "links", (F.col("linked_rows") + F.col("weight") - 1).alias("linked_documents"))
    copies = sets.filter("weight > 1").select("k1", "k2", F.col("copy_of").alias("class_id"), F.col("id").alias("head"), "copy_of", F.lit(0).cast("long").alias("links"), (F.col("weight") - 1).alias("linked_documents"))
    known = cut(linked.unionByName(copies.join(linked.select("k1", "k2"), ["k1", "k2"], "left_anti")))
    out = small_join(rows.drop("sig"), known, ["k1", "k2"], "left")
    return out.select(
        F.col("key").alias(key),
        "h",
        "rid",
        F.coalesce("class_id", "key").alias("class_id"),
        F.coalesce("copy_of", "key").alias("copy_of"),
        F.coalesce("links", F.lit(0)).cast("long").alias("links"),
        F.coalesce("linked_documents", F.lit(0)).cast("long").alias("linked_documents"),
        (F.coalesce("head", "rid") == F.col("rid")).alias("keep"),
    )


def one_of_each(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """*documents* with one row of each class of near copies."""
    matched = cut(match(documents, key, text))
    columns = documents.columns
    h = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    docs = documents.withColumn("_h", h)
    if repeated_rows(matched, key):
        docs = docs.dropDuplicates([key, "_h"])
    gone = matched.filter("not keep").select(F.col(key).alias("_k"), F.col("h").alias("_g"))
    kept = matched.filter("keep").select(F.col(key).alias("_k2"), F.col("h").alias("_g2"))
    gone = cut(gone.join(kept, F.col("_k").eqNullSafe(F.col("_k2")) & (F.col("_g") == F.col("_g2")), "left_anti"))
    return small_join(docs, gone, (F.col("_h") == F.col("_g")) & F.col(key).eqNullSafe(F.col("_k")), "left_anti").select(*columns)


def op3_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents: class, exact copies and number of links of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return match(docs).select("doc_id", "class_id", "copy_of", "links", "linked_documents")
