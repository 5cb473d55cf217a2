"""From candidate buckets to verified links: brute force in blocks, exact Jaccard, components.

Three steps, none of which emits a row for each pair of a group:

1. Buckets (sets of ids that may be alike) are compared by sketches. A bucket of more than a tile's ids is
   cut into tiles and every pair of tiles is a block of its own, so no task holds a large bucket. A
   block emits a spanning forest of its likely links, fewer rows than it has members.
2. The forests' connected components are clusters: all likely links lie inside.
3. In each cluster, again in blocks of pairs of tiles, the exact Jaccard of every pair's shingle sets
   is computed; blocks emit each member's number of links and a spanning forest of exact links, whose
   components are the final groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrastrat.llm import shingles
from terrastrat.operators.graph import connected_components
from terrastrat.session import cut, small_batches, small_join

#: Ids of a tile: where sketches are compared, and where whole shingle sets are.
SKETCH_TILE, TILE = 1024, 512
#: Pairs compared by one numpy step at most.
PAIRS = 1 << 17


def blocks(members: DataFrame, group: str, tile: int = TILE) -> DataFrame:
    """Members with ``block`` and ``side``: each group's pairs of tiles, or the group itself if it fits one.

    side 0: on the left of the block, 1: on the right, 2: the block is a tile against itself. A group
    of n members gives each of them about n / tile rows.
    """
    sizes = members.groupBy(group).agg(F.count("*").alias("n"))
    large = cut(sizes.filter(F.col("n") > tile).select(F.col(group).alias("_g"), F.ceil(F.col("n") / tile).cast("int").alias("_t")))
    joined = small_join(members, large, members[group] == large["_g"], "left").drop("_g")
    tiles = F.coalesce("_t", F.lit(1))
    own = F.pmod(F.xxhash64("id", F.lit(17)), tiles).cast("int")
    name = lambda a, b: F.xxhash64(group, a, b)
    spots = F.transform(
        F.sequence(F.lit(0), tiles - 1),
        lambda t: F.when(t == own, F.struct(name(t, t).alias("block"), F.lit(2).alias("side")))
        .when(t > own, F.struct(name(own, t).alias("block"), F.lit(0).alias("side")))
        .otherwise(F.struct(name(t, own).alias("block"), F.lit(1).alias("side"))),
    )
    single = F.array(F.struct(F.xxhash64(group, F.lit(0), F.lit(0)).alias("block"), F.lit(2).alias("side")))
    spread = F.when(F.col("_t").isNull(), single).otherwise(spots)
    return joined.withColumn("_own", own).withColumn("_spot", F.explode(spread)).select("*", "_spot.block", "_spot.side").drop("_spot", "_own", "_t")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) for the graph of pairs a-b over n nodes."""
    label = np.arange(n)
    while len(a):
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def pairs_of(begin: np.ndarray, side: np.ndarray):
    """All pairs of the blocks' members (positions in order of block): i<j within side 2, side 0 with side 1.

    Yields arrays of positions of about PAIRS pairs at a time, never more than a few rows over.
    """
    held_a, held_b, held = [], [], 0
    for lo, hi in zip(begin[:-1], begin[1:], strict=True):
        s = side[lo:hi]
        if s[0] == 2:
            n = hi - lo
            i, j = np.triu_indices(n, 1)
            i, j = i + lo, j + lo
        else:
            left, right = np.flatnonzero(s == 0) + lo, np.flatnonzero(s == 1) + lo
            i, j = np.repeat(left, len(right)), np.tile(right, len(left))
        held_a.append(i)
        held_b.append(j)
        held += len(i)
        if held >= PAIRS:
            yield np.concatenate(held_a), np.concatenate(held_b)
            held_a, held_b, held = [], [], 0
    if held:
        yield np.concatenate(held_a), np.concatenate(held_b)


def by_block(batches, weigh, limit: int = 8 << 20):
    """Whole blocks of rows sorted by their first column, gathered to about *limit* bytes of *weigh*."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held.append(table)
        size += weigh(batch)
        if size < limit:
            continue
        joined = pa.concat_tables(held).combine_chunks()
        key = joined.column(0).to_numpy()
        split = int(np.searchsorted(np.flip(key != key[-1]).astype(np.int8).cumsum(), 1))  # rows of the last block
        whole = len(key) - split
        if whole:
            yield joined.slice(0, whole)
            joined = joined.slice(whole)
        held, size = [joined], sum(weigh(b) for b in joined.to_batches())
    if held:
        yield pa.concat_tables(held).combine_chunks()


def starts(key: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])


def likely_links(members: DataFrame, sketches: DataFrame, lanes: int, least: float, tile: int = SKETCH_TILE) -> DataFrame:
    """Step 1: ``(src, dst)`` forests from ``members (bucket, id)`` and ``sketches (id, sketch)``."""
    spread = blocks(members, "bucket", tile).select("block", "side", "id")
    rows = spread.join(sketches.select("id", "sketch"), "id").select("block", "side", "id", "sketch")
    rows = rows.repartition("block").sortWithinPartitions("block", "side", "id")
    need = int(np.ceil(least * lanes))

    def compare(batches):
        for table in by_block(batches, lambda b: b.num_rows * (lanes + 24)):
            key, side, ids = (table.column(i).to_numpy() for i in range(3))
            data = b"".join(x.as_py() for x in table.column(3))
            sketch = np.frombuffer(data, np.uint8).reshape(len(key), lanes)
            # positions of one id in several blocks are one node
            names, node = np.unique(ids, return_inverse=True)
            x = y = np.zeros(0, np.int64)
            for a, b in pairs_of(starts(key), side):
                found = np.concatenate([(sketch[a[k : k + 8192]] == sketch[b[k : k + 8192]]).sum(axis=1) >= need for k in range(0, len(a), 8192)])
                # links are kept as a forest from step to step, never all at once
                x, y = forest(len(names), np.concatenate([x, node[a[found]]]), np.concatenate([y, node[b[found]]]))
            yield pa.RecordBatch.from_arrays([pa.array(names[x]), pa.array(names[y])], names=["src", "dst"])

    return rows.mapInArrow(compare, "src long, dst long")


def exact_links(sets: DataFrame, threshold: float, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Step 3: from ``sets (cluster, id, shingles: binary of sorted uint64, weight)``.

    Gives (counts, forest): ``(id, links, linked_rows)`` partly summed, and ``(src, dst)``. links counts
    other ids of Jaccard >= threshold, linked_rows their weights.
    """
    rows = blocks(sets, "cluster", tile).select("block", "side", "id", "weight", "shingles")
    rows = rows.repartition("block").sortWithinPartitions("block", "side", "id")

    def verify(batches):
        for table in by_block(batches, lambda b: b.nbytes):
            key, side, ids, weight = (table.column(i).to_numpy() for i in range(4))
            data = [np.frombuffer(x.as_py(), np.uint64) for x in table.column(4)]
            links, linked, x, y = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), [], []
            at = starts(key)
            for lo, hi in zip(at[:-1], at[1:], strict=True):
                if hi - lo < 2:
                    continue
                a, b = verified(data[lo:hi], side[lo:hi], threshold)
                links[lo:hi] += np.bincount(a, minlength=hi - lo) + np.bincount(b, minlength=hi - lo)
                linked[lo:hi] += np.bincount(a, weight[lo:hi][b], hi - lo).astype(np.int64) + np.bincount(b, weight[lo:hi][a], hi - lo).astype(np.int64)
                node, root = forest(hi - lo, a, b)
                x.append(ids[lo:hi][node])
                y.append(ids[lo:hi][root])
            some = np.flatnonzero(links)
            x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (x, y))
            none = np.full(len(x), None)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([ids[some], x])),
                    pa.array([*links[some], *none], pa.int64()),
                    pa.array([*linked[some], *none], pa.int64()),
                    pa.array([*np.full(len(some), None), *y], pa.int64()),
                ],
                names=["id", "links", "linked_rows", "dst"],
            )

    found = cut(rows.mapInArrow(verify, "id long, links long, linked_rows long, dst long"))
    return found.filter("dst is null").select("id", "links", "linked_rows"), found.filter("dst is not null").select(F.col("id").alias("src"), "dst")


def verified(sets: list[np.ndarray], side: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one block whose exact Jaccard reaches the threshold; two empty sets count as equal.

    Shared shingles are counted by a product of 0/1 matrices over the block's own shingles, a slice of
    columns at a time.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    order = np.argsort(flat, kind="stable")
    column = np.cumsum(np.concatenate([[0], np.diff(flat[order]) != 0])) if len(flat) else np.zeros(0, np.int64)
    owner = owner[order]
    repeats = np.bincount(column) if len(column) else np.zeros(0, np.int64)
    shared = np.zeros((n, n), np.float32)
    useful = repeats[column] > 1 if len(column) else np.zeros(0, bool)
    owner, column = owner[useful], column[useful]
    cuts = starts(column // 2048) if len(column) else [0]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        used, col = np.unique(column[lo:hi], return_inverse=True)
        m = np.zeros((n, len(used)), np.float32)
        m[owner[lo:hi], col] = 1
        shared += m @ m.T
    union = size[:, None] + size[None, :] - shared
    ok = (shared >= threshold * union - 1e-9) if n else shared > 0
    if side[0] == 2:
        ok &= np.triu(np.ones((n, n), bool), 1)
    else:
        ok &= (side == 0)[:, None] & (side == 1)[None, :]
    return np.nonzero(ok)


def shingle_sets(texts: list[bytes]) -> list[bytes]:
    """Sorted distinct five-word shingle hashes of each text, as bytes."""
    out = []
    for lo, hi in shingles.runs(texts):
        w = shingles.Words(texts[lo:hi])
        h, begin = shingles.shingles(w.hash, w.first)
        out.extend(np.unique(h[a:b]).tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True))
    return out


def with_sets(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """*keep* (long columns) and ``shingles`` of each row's text."""

    def sets(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                texts = [(t.as_py() or "").encode() for t in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(shingle_sets(texts), pa.binary())], names=[*keep, "shingles"])

    return rows.select(*keep, text).mapInArrow(sets, ", ".join(f"{k} long" for k in keep) + ", shingles binary")


def groups(likely: DataFrame, sets_of, threshold: float, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Steps 2 and 3: (counts ``(id, links, linked_rows)``, components ``(id, component)``) of all exact links.

    sets_of: takes clusters ``(id, cluster)`` and gives them with ``weight`` and ``shingles``.
    """
    with small_batches(likely.sparkSession):
        clusters = connected_components(likely).select(F.col("node").alias("id"), F.col("component").alias("cluster"))
        counts, forest_edges = exact_links(sets_of(clusters), threshold, tile)
        counts = cut(counts.groupBy("id").agg(F.sum("links").alias("links"), F.sum("linked_rows").alias("linked_rows")))
        return counts, connected_components(forest_edges).select(F.col("node").alias("id"), "component")
