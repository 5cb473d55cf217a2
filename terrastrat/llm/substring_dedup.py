"""Repeated passages by paragraph MinHash banding.

A text is cut into pieces, each ended by a sentence of at least six words; longer stretches without a
sentence's end are cut before words whose hash is the least around them. Either way a passage is cut
alike wherever it stands. Pieces with equal words are one node. Pieces of more than PART_STRETCH words are
cut once more, and their parts, which are met by equal words only, stand in where a passage begins or ends inside a piece. Bands of MinHash values are joined in
Spark; colliding nodes are verified by exact Jaccard (see :mod:`terrastrat.llm.linking`) and clustered
by components. All but the first occurrence of a cluster are removals; adjoining pieces are reported
as one passage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrastrat.llm import linking, shingles
from terrastrat.session import cut, small_batches, written

THRESHOLD, SEED = 0.8, 90_001
#: A sentence of so many words ends a piece; repeated passages of fewer than MIN_PASSAGE words are let be.
SENTENCE, MIN_PASSAGE = 6, 25
#: Lanes of the sketches that colliding pieces are compared by, and the share that must agree.
LANES, LIKELY = 64, 0.6
#: Stretches of more than STRETCH words are cut, before words of the least hash among REACH words on either side.
STRETCH, REACH = 64, 8
#: The same for the parts that longer pieces are cut into.
PART_STRETCH, PART_REACH = 10, 5
#: Words that a passage shows less than it has, as it begins and ends inside a part: about half a part at either end, less one in three.
LOST = 7
#: Code points of an edited piece that a passage may go across, and how far its ends may have moved by the edit.
BRIDGE, MOVED = 400, 40
#: Places (a power of two of them) in which a task remembers pieces whose bands it has given; a forgotten one costs rows and changes nothing.
SEEN_BITS = 20


def tune(recall: float = 0.999, pieces: int = 1, threshold: float = THRESHOLD, largest: int = 32) -> tuple[int, int]:
    """(bands, rows): the fewest values to join by which one of *pieces* pieces, each at the threshold, is met.

    Fewest bands first, as each is a row to shuffle for every piece; then the most rows.
    """
    for bands in range(1, largest + 1):
        for rows in range(4, 0, -1):
            if 1 - (1 - threshold**rows) ** (bands * pieces) >= recall:
                return bands, rows
    raise ValueError("no banding reaches the recall")


#: Only pieces that meet are marked, so every single one has to.
BANDS, ROWS = tune()
_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
#: Full-width sentence marks, three bytes each.
_WIDE = [np.frombuffer(c.encode(), np.uint8) for c in "\u3002\uff01\uff1f"]


def cut_text(w: shingles.Words) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of the texts' words begin (and one past the last), and the text of each."""
    n = len(w.hash)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    lines = np.cumsum(w.buffer == 10)
    last = np.concatenate([w.text[1:] != w.text[:-1], [True]])
    newline = np.concatenate([lines[w.start[1:] - 1] > lines[w.end[:-1] - 1], [True]])
    mark = _ENDS[w.buffer[w.end - 1]]
    for wide in _WIDE:
        mark |= (w.end - w.start >= 3) & (w.buffer[w.end - 3] == wide[0]) & (w.buffer[w.end - 2] == wide[1]) & (w.buffer[w.end - 1] == wide[2])
    sentence = np.flatnonzero(mark | newline | last)
    length = np.diff(np.concatenate([[-1], sentence]))
    ends = sentence[(length >= SENTENCE) | last[sentence]]
    ends = np.union1d(ends, inner_ends(w.hash, ends))
    return np.concatenate([[0], ends + 1]), w.text[ends]


def inner_ends(word: np.ndarray, ends: np.ndarray, stretch: int = STRETCH, reach: int = REACH) -> np.ndarray:
    """Last words of pieces inside stretches (each up to one of *ends*) of more than *stretch* words.

    A piece begins at a word whose hash is below those of *reach* words before it and not above those of
    *reach* words after it in its stretch, so what stands farther away doesn't move the cut.
    """
    size = np.diff(np.concatenate([[-1], ends]))
    long = np.flatnonzero(size > stretch)
    if not len(long):
        return np.zeros(0, np.int64)
    size = size[long]
    begin = np.cumsum(np.concatenate([[0], size + reach]))  # stretches apart, with the largest value between them
    at = np.arange(begin[-1]) - np.repeat(begin[:-1], size + reach)
    inside = at < np.repeat(size, size + reach)
    where = at + np.repeat(ends[long] + 1 - size, size + reach)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    row = np.full(begin[-1] + 2 * reach, top, np.uint64)
    row[reach:-reach][inside] = word[where[inside]]
    mid = row[reach:-reach]
    least = inside & (at >= reach)
    for k in range(1, reach + 1):
        least &= (mid < row[reach - k : len(row) - reach - k]) & (mid <= row[reach + k : len(row) - reach + k])
    return where[least] - 1


def pieces(documents: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, h, rid, at, stop, w, words, u, up, part, b0, ...)``: every piece of at least five words, and the parts of long ones.

    at, stop: code points of the text, end exclusive; w: words of the text before it. u: a hash of the piece's words in order.
    up: where the piece begins that it is, or is a part of. Parts have no bands. Bands are
    null where the task has given those of an equal piece before, so a piece that is very common gives
    them about once a task.
    """
    kind = documents.schema[key].dataType.simpleString()
    bands = [f"b{i}" for i in range(BANDS)]

    def found(batches):
        seen = np.zeros(1 << SEEN_BITS, np.uint64)
        for batch in batches:
            sizes = [len(t.as_py()) for t in batch.column(3)]
            for lo, hi in shingles.runs(sizes, size=lambda n: n):
                part = batch.slice(lo, hi - lo)
                w = shingles.Words([t.as_py().encode() for t in part.column(3)])
                first, owner = cut_text(w)
                if not len(owner):
                    continue
                points = np.concatenate([[0], np.cumsum((w.buffer & 0xC0) != 0x80)])

                def rows(first, owner, up, part, keep, band, batch=part, w=w, points=points):
                    base = points[w.bounds[:-1]][owner]
                    at, stop = points[w.start[first[:-1]]] - base, points[w.end[first[1:] - 1]] - base
                    up = (points[w.start[up]] - base)[keep]
                    long = [at[keep], stop[keep], (first[:-1] - w.first[owner])[keep], np.diff(first)[keep]]
                    head = batch.select([0, 1, 2]).take(pa.array(owner[keep])).columns
                    columns = [*head, *[pa.array(v.astype(np.int32)) for v in long], pa.array(names_of(w, first)[keep].view(np.int64)), pa.array(up.astype(np.int32)), pa.array(np.full(len(keep), part)), *band]
                    return pa.RecordBatch.from_arrays(columns, names=["key", "h", "rid", "at", "stop", "w", "words", "u", "up", "part", *bands])

                words, u = np.diff(first), names_of(w, first)
                h, begin = shingles.shingles(w.hash, first)
                least = least64(h, begin, BANDS * ROWS)
                names, at = np.unique(u, return_index=True)
                place = names >> np.uint64(64 - SEEN_BITS)
                stale = np.ones(len(u), bool)
                stale[at[seen[place] != names]] = False
                seen[place] = names
                keep = np.flatnonzero(words >= shingles.WIDTH)
                band = [_joined(least[keep, i * ROWS : (i + 1) * ROWS], i) for i in range(BANDS)]
                yield rows(first, owner, first[:-1], False, keep, [pa.array(b, mask=stale[keep]) for b in band])
                # parts of pieces that fall into two or more
                finer = np.concatenate([[0], np.union1d(first[1:] - 1, inner_ends(w.hash, first[1:] - 1, PART_STRETCH, PART_REACH)) + 1])
                parent = np.searchsorted(first, finer[:-1], side="right") - 1
                keep = np.flatnonzero((np.diff(finer) >= shingles.WIDTH) & (np.bincount(parent, minlength=len(owner))[parent] > 1))
                yield rows(finer, owner[parent], first[parent], True, keep, [pa.nulls(len(keep), pa.int64())] * BANDS)

    t = F.coalesce(F.col(text), F.lit(""))
    rows = documents.select(F.col(key), F.xxhash64(t).alias("h"), F.monotonically_increasing_id().alias("rid"), t.alias("_t"))
    return rows.mapInArrow(found, f"key {kind}, h long, rid long, at int, stop int, w int, words int, u long, up int, part boolean, " + ", ".join(f"{b} long" for b in bands))


def names_of(w: shingles.Words, first: np.ndarray) -> np.ndarray:
    """A hash of the words in order of each of the pieces that begin at *first*."""
    words = np.diff(first)
    place = np.arange(len(w.hash)) - np.repeat(first[:-1], words)
    return shingles.mixed(np.add.reduceat(w.hash * shingles.powers(int(words.max()))[0][place], first[:-1]) + words.astype(np.uint64))


def least64(h: np.ndarray, begin: np.ndarray, k: int) -> np.ndarray:
    """Least values of k permutations in 64 bits, so that unrelated pieces of a large corpus don't collide."""
    a, b = shingles.permutations(k, SEED)
    out = np.empty((len(begin) - 1, k), np.uint64)
    for i in range(k):
        out[:, i] = np.minimum.reduceat(shingles.mixed(h * a[i] + b[i]), begin[:-1])
    return out


def _joined(values: np.ndarray, band: int) -> np.ndarray:
    out = np.full(len(values), band, np.uint64)
    for j in range(values.shape[1]):
        out = shingles.mixed(out * np.uint64(0x9E3779B97F4A7C15) + values[:, j])
    return out.view(np.int64)


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join that shuffles both sides at every size: what grows with the corpus is never broadcast, and small inputs run the plan of large ones."""
    return left.join(right.hint("merge"), on, how)


def near_nodes(documents: DataFrame, table: DataFrame, near: DataFrame, key: str, text: str) -> DataFrame:
    """``(id, component)`` of nodes with a verified link to another node. near: ``(bucket, u)``; table: the pieces of these nodes at least."""
    wanted = near.select("u").distinct()
    spot = F.min_by(F.struct("key", "h", "at", "stop"), F.struct("rid", "at"))
    spots = merged(table.select("u", "key", "h", "rid", "at", "stop"), wanted, "u").groupBy("u").agg(spot.alias("s"))
    spots = cut(spots.groupBy(F.col("s.key").alias("_k"), F.col("s.h").alias("_h")).agg(F.collect_list(F.struct("u", "s.at", "s.stop")).alias("spots")))
    docs = documents.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("_t")).withColumn("h", F.xxhash64("_t"))
    texts = merged(docs, spots, (docs["h"] == spots["_h"]) & docs["key"].eqNullSafe(spots["_k"]))
    parts = texts.select(F.explode(F.transform("spots", lambda s: F.struct(s["u"].alias("id"), F.substring(F.col("_t"), s["at"] + 1, s["stop"] - s["at"]).alias("piece")))).alias("p"))

    def sketched(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                w = shingles.Words([(t.as_py() or "").encode() for t in part.column(1)])
                h, begin = shingles.shingles(w.hash, w.first)
                sig = shingles.minhash(h, begin, LANES, SEED).astype(np.uint8)
                sets = [np.unique(h[a:b]).tobytes() for a, b in zip(begin[:-1], begin[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in sig], pa.binary()), pa.array(sets, pa.binary())], names=["id", "sketch", "shingles"])

    # repeated rows give a piece more than once; any of them will do
    known = written(parts.select("p.id", "p.piece").dropDuplicates(["id"]).mapInArrow(sketched, "id long, sketch binary, shingles binary"))
    likely = linking.likely_links(near.select("bucket", F.col("u").alias("id")), known, LANES, LIKELY)
    sets_of = lambda clusters: clusters.join(known.select("id", "shingles"), "id").withColumn("weight", F.lit(1).cast("long"))
    return linking.groups(likely, sets_of, THRESHOLD)[1]


def repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = MIN_PASSAGE) -> DataFrame:
    """``(key, h, rid, start, end, n_words, cluster_id, first_key, removed)``: every occurrence of a repeated passage.

    start, end: code points, end exclusive. The first occurrence (in the order of the input) of each
    piece is kept, removed false; adjoining pieces with one verdict are one row, left out if its whole
    pieces have under *min_words* - LOST words; an edited piece between two of one removed passage counts as part of it. cluster_id names a component, the same for all occurrences of a passage: the least
    one among the row's pieces that occur as often as most of its words; first_key is the key of the row
    that keeps it. Documents without repeats have no rows; null or empty texts have none.
    Repeated rows are occurrences like any others. An empty table gives an empty result.
    """
    bands = [f"b{i}" for i in range(BANDS)]
    with small_batches(documents.sparkSession):
        table = written(pieces(documents, key, text))
    # rows of one bucket meet once: the aggregate and the rows read one and the same exchange
    keyed = table.filter("b0 is not null").select("u", F.explode(F.array(*bands)).alias("bucket")).repartition("bucket")
    mixed = keyed.groupBy("bucket").agg(F.min("u").alias("low"), F.max("u").alias("high")).filter("low <> high")
    near = written(keyed.join(mixed.select("bucket").hint("merge"), "bucket").distinct())
    equal = table.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
    nodes = cut(equal.unionByName(near.select("u")).distinct())
    # the one join that all pieces take part in; its other side is a single number a row
    spots = written(merged(table.select("u", "key", "h", "rid", "at", "stop", "w", "words", "up", "part"), nodes, "u"))
    components = near_nodes(documents, spots, near, key, text).withColumnRenamed("id", "u")
    spots = written(merged(spots, components, "u", "left").withColumn("label", F.coalesce("component", "u")).drop("u", "component"))
    labels = spots.groupBy("label").agg(F.count("*").alias("n"), F.min(F.struct("rid", "at", "key")).alias("first"))
    labels = written(labels.filter("n > 1").select(F.col("label").alias("_label"), "n", "first"))
    spots = merged(spots, labels, F.col("label") == F.col("_label"))
    spots = spots.withColumn("removed", (F.col("rid") != F.col("first.rid")) | (F.col("at") != F.col("first.at")))
    # windows over the pieces of one document; parts of a piece that is met itself say nothing more
    whole = F.max(F.when(F.col("part"), 0).otherwise(1)).over(W.partitionBy("rid", "up"))
    spots = spots.repartition("rid").withColumn("_whole", whole).filter("not part or _whole = 0").drop("_whole", "part", "up")
    order = W.partitionBy("rid").orderBy("at")
    before = lambda c: F.lag(c).over(order)
    gap = F.col("at") - before("stop")
    # an edited piece inside a passage: what stands around it stands alike around the first occurrence
    moved = F.abs(F.col("at") - before("at") - F.col("first.at") + before("first.at"))
    alike = (F.col("first.rid") == before("first.rid")) & (F.col("n") == before("n")) & (moved <= MOVED)
    apart = (gap > F.when(alike, BRIDGE).otherwise(3)) | (before("removed") != F.col("removed"))
    bridged = F.when(F.col("removed") & ~apart, F.col("w") - before("w") - before("words")).otherwise(0)
    runs = spots.withColumn("words", F.col("words") + F.coalesce(bridged, F.lit(0))).withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(order))
    # pieces as frequent as most of the row's words; frequent lines and chance neighbours don't name it
    alike = runs.groupBy("rid", "_run", "n").agg(
        F.first("key").alias("key"),
        F.first("h").alias("h"),
        F.min("at").alias("at"),
        F.max("stop").alias("stop"),
        F.sum("words").alias("words"),
        F.min(F.struct("label", "first")).alias("least"),
        F.first("removed").alias("removed"),
    )
    rows = alike.groupBy("rid", "_run").agg(
        F.first("key").alias(key),
        F.first("h").alias("h"),
        F.min("at").alias("start"),
        F.max("stop").alias("end"),
        F.sum("words").alias("n_words"),
        F.max_by("least", F.struct("words", "n")).alias("_name"),
        F.first("removed").alias("removed"),
    )
    rows = rows.filter(F.col("n_words") >= min_words - LOST)
    return rows.select(key, "h", "rid", "start", "end", "n_words", F.col("_name.label").alias("cluster_id"), F.col("_name.first.key").alias("first_key"), "removed")


def remove(documents: DataFrame, found: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """*documents* without the removed passages of :func:`repeats`; key and text must tell rows apart here."""
    spans = found.filter("removed").groupBy(F.col(key).alias("_k"), F.col("h").alias("_h")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_s"))
    docs = documents.withColumn("_g", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = docs.join(spans, (F.col("_g") == F.col("_h")) & F.col(key).eqNullSafe(F.col("_k")), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, s["start"] - a["at"])).alias("out"))
    rest = F.aggregate("_s", start, step, lambda a: F.concat(a["out"], F.substring(F.col(text), a["at"] + 1, F.char_length(F.col(text)))))
    return joined.withColumn(text, F.when(F.col("_s").isNull(), F.col(text)).otherwise(rest)).select(*documents.columns)


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every occurrence of a passage that repeats among all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeats(docs).select("doc_id", F.col("start").cast("long"), F.col("end").cast("long"), F.col("n_words").cast("long"), "cluster_id", F.col("first_key").alias("first_doc_id"), "removed")
