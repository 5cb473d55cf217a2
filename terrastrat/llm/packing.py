"""Packing token sequences into windows by minimum bin slack.

Documents are cut at multiples of the window, so only remainders need packing. How many remainders
there are of each length (at most *window* numbers) decides a plan: again and again the longest
remaining length is taken and a bitset subset-sum picks, among the others, the multiset that comes
closest to filling the window; its counts are found by going back through the stages, and the pattern
is used as often as the lengths left allow. Pieces then take their places in the plan by their rank
among pieces of their length.
"""

from __future__ import annotations

import zlib
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrastrat.llm.tokencount import vocabulary_path
from terrastrat.session import cut, small_batches, small_join

WINDOW, END = 2048, 1
#: Pieces of one length are ranked in lots of about LOT_ROWS, at most LOTS of them.
LOT_ROWS, LOTS = 512, 4096


class Encoder:
    """Ids by a vocabulary file: a fast encoder, and the file's own library for texts with very long runs.

    The fast one recurses over runs of white space, until its stack ends, and takes quadratic time on
    words; below RUN characters neither matters. Both give the same ids (tested).
    """

    RUN = 1000

    def __init__(self, path: str):
        import tiktoken

        from terrastrat.llm.bytebpe import Vocabulary

        v = Vocabulary.__new__(Vocabulary)
        v.read(path)
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.path, self.fast = path, tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=v.ids, special_tokens=v.special)

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def long_runs(self, text: str) -> bool:
        """Whether some RUN characters on end are all white space or all not; false beyond doubt if half of that never are."""
        half = self.RUN // 2
        for at in range(0, len(text) - half + 1, half):
            part = text[at : at + half]
            first = part.split(None, 1)
            if not first or len(first[0]) == half:
                return True
        return False

    def ids(self, text: str) -> list[int]:
        """Ids of the whole text; special strings in it count as such."""
        if len(text) >= self.RUN and self.long_runs(text):
            return self.library.encode(text, add_special_tokens=False).ids
        if any(s in text for s in self.fast.special_tokens_set):
            return self.fast.encode(text, allowed_special="all")
        return self.fast.encode_ordinary(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One a worker and file."""
    return Encoder(path)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, within *counts*, of the largest sum up to *capacity*.

    Bit ``s`` of a stage's set says that sum ``s`` can be reached with the lengths seen so far, longer
    ones first; the stages end as soon as the capacity itself can be reached.
    """
    mask = (1 << capacity + 1) - 1
    stages, reach = [], 1
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        before, n, step = reach, min(counts[length], capacity // length), 1
        while n > 0:  # copies in powers of two
            step = min(step, n)
            reach |= reach << step * length & mask
            n -= step
            step *= 2
        if reach != before:
            stages.append((length, before))
        if reach >> capacity & 1:
            break
    left, used = reach.bit_length() - 1, {}
    for length, before in reversed(stages):
        while not before >> left & 1:
            left -= length
            used[length] = used.get(length, 0) + 1
    return used


def plan_windows(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[dict[int, int], int]]:
    """Patterns (lengths with their counts) and how many windows use each, until every length is placed."""
    left = {k: n for k, n in histogram.items() if n}
    patterns = []
    while left:
        longest = max(left)
        left[longest] -= 1
        used = fill({k: n for k, n in left.items() if n}, window - longest) if longest < window else {}
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        patterns.append((used, times))
    return patterns


def places(patterns) -> dict[str, np.ndarray]:
    """The plan by (length, first rank): where pieces of these ranks go. A few rows a pattern."""
    rows, ranks, first = [], {}, 0
    for used, times in patterns:
        at = 0
        for length in sorted(used, reverse=True):
            start, n = ranks.get(length, 0), used[length]
            rows.append((length << 40 | start, start, n, first, at, length))
            ranks[length] = start + n * times
            at += length * n
        first += times
    rows.sort()
    names = ("key", "start", "each", "first", "offset", "length")
    return dict(zip(names, np.array(rows, np.int64).reshape(-1, 6).T, strict=True))


def cut_pieces(documents: DataFrame, key: str, text: str, window: int, name: str) -> DataFrame:
    """``(key, start, length, ids_crc32, doc_tokens, lot)``: every document's pieces, ids not kept."""
    kind = documents.schema[key].dataType.simpleString()

    def pieces(batches):
        enc = encoder(vocabulary_path(name))
        lot = 0
        for batch in batches:
            keys, rows = [], []
            for at, t in enumerate(batch.column(1)):
                ids = np.array([*enc.ids(t.as_py() or ""), END], "<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    keys.append(at)
                    rows.append((start, len(piece), zlib.crc32(piece), len(ids), lot % LOTS))
                    lot += 1
            if rows:
                columns = np.array(rows, np.int64).T
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(keys, pa.int64())), *[pa.array(c) for c in columns]],
                    names=["key", "start", "length", "ids_crc32", "doc_tokens", "lot"],
                )

    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, lot long"
    return documents.select(key, text).mapInArrow(pieces, schema).withColumnRenamed("key", key)


def pack(documents: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, name: str = "byte_bpe_50k.json") -> DataFrame:
    """``(key, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` of every piece.

    Null texts are empty: the end id alone. Null keys and repeated rows are packed like any others. An
    empty table gives an empty result. The pieces (some 60 bytes each, no ids) are written to the
    shared folder before ranking. The driver sees one count for each length, at most *window* numbers.
    """
    with small_batches(documents.sparkSession):
        cutted = cut(cut_pieces(documents, key, text, window, name))
    histogram = {r["length"]: r["count"] for r in cutted.groupBy("length").count().collect()}
    lots = max(1, min(LOTS, -(-max(histogram.values(), default=0) // LOT_ROWS)))
    plan = places(plan_windows(histogram, window))
    rows = cutted.withColumn("lot", F.col("lot") % lots)
    sizes = rows.groupBy("length", "lot").agg(F.count("*").alias("n"))
    base = F.sum("n").over(W.partitionBy("length").orderBy("lot")) - F.col("n")
    bases = cut(sizes.select("length", "lot", base.alias("base")))
    inside = F.row_number().over(W.partitionBy("length", "lot").orderBy(key, "start", "ids_crc32"))
    rows = small_join(rows.withColumn("inside", inside), bases, ["length", "lot"])
    rows = rows.select(key, "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("inside") - 1).alias("rank"))
    kind = documents.schema[key].dataType.simpleString()

    def place(batches):
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(plan["key"], length << 40 | rank, side="right") - 1
            k = rank - plan["start"][at]
            each = plan["each"][at]
            sequence, offset = plan["first"][at] + k // each, plan["offset"][at] + k % each * length
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence), pa.array(offset)],
                names=["key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    schema = f"key {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(place, schema).withColumnRenamed("key", key)


def sequences(documents: DataFrame, packed: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k.json") -> DataFrame:
    """``(sequence_id, ids)`` of :func:`pack`'s result; *key* must be unique here. At most one window of ids a row."""
    spots = packed.groupBy(key).agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("spots"))
    joined = documents.select(key, text).join(spots, documents[key].eqNullSafe(spots[key])).select(text, "spots")

    def ids_of(batches):
        enc = encoder(vocabulary_path(name))
        for batch in batches:
            for t, spots in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.array([*enc.ids(t.as_py() or ""), END], np.int32)
                s = spots.as_py()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x["sequence_id"] for x in s], pa.int64()),
                        pa.array([x["offset"] for x in s], pa.int64()),
                        pa.array([ids[x["start"] : x["start"] + x["length"]] for x in s], pa.list_(pa.int32())),
                    ],
                    names=["sequence_id", "offset", "ids"],
                )

    parts = joined.mapInArrow(ids_of, "sequence_id long, offset long, ids array<int>")
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["ids"])).alias("ids"))


def op9_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
