"""SimHash near copies by an index of byte positions with count filtering.

Fingerprints of 64 bits that differ in three bits at most share at least five of their eight bytes. A
posting list for each single byte would hold every 256th fingerprint, and tallying lists would touch a fixed
share of all pairs, so lists are kept for sets of four positions: the fourteen planes of the affine space
of eight points. Any three positions lie in one plane, and its complement is a plane too, so a pair
with three spoilt bytes or fewer meets in at least one list. In a list shared bytes are tallied
for each pair, pairs with five or more are retained, and their bits are compared.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastrat.llm import linking, shingles
from terrastrat.operators.graph import connected_components
from terrastrat.session import cut, small_join

WIDTH, SEED, DISTANCE = 3, 42, 3
#: Positions of the planes: four of eight whose exclusive or is zero.
PLANES = [p for p in combinations(range(8), 4) if p[0] ^ p[1] ^ p[2] ^ p[3] == 0]
#: A list with more fingerprints is split again by half bytes; this many are compared in about a second.
DENSE = 16_384
#: Bits counted by one step.
RUN = 1 << 16


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """Majority bits of the hashes of all word runs of *width*; fewer words make one run, none make zero."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate((len(w) + 1 for w in words), initial=-1))[1:]
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[min(width, len(words)) - 1 :], strict=False)], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), RUN):
        ones += np.unpackbits(hashes[i : i + RUN].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fp)``: the fingerprint of every row's whole text as a long; null texts are empty."""
    kind = documents.schema[key].dataType.simpleString()

    def prints(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            found = [fingerprint(t.as_py() or b"") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["key", "fp"])

    return documents.select(key, text).mapInArrow(prints, f"key {kind}, fp long")


def mask(positions: tuple, bits: int = 8) -> int:
    """The bits of some positions of *bits* bits each."""
    return sum(((1 << bits) - 1) << bits * p for p in positions)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


#: Masks of the planes, and for each of them those that add four of the eight half bytes left free.
MASKS = [mask(p) for p in PLANES]
FINER = [[m | mask(tuple([h for h in range(16) if h // 2 not in p][i] for i in q), 4) for q in PLANES] for m, p in zip(MASKS, PLANES, strict=True)]


def postings(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """``(block, fp)``: the lists in which distinct fingerprints ``(fp)`` lie, named by position set and bytes.

    A list of over *dense* fingerprints is replaced by fourteen finer ones, which hold all its pairs of three
    different bits or fewer by the same argument, and at most 65,536 fingerprints each.
    """
    held = lambda masks, base: F.array(*[F.struct(F.lit(base + i).alias("place"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("held")) for i, m in enumerate(masks)])
    rows = prints.select("fp", F.explode(held(MASKS, 0)).alias("l")).select("fp", "l.*")
    large = cut(rows.groupBy("place", "held").agg(F.count("*").alias("_n")).filter(F.col("_n") > dense))
    if not large.isEmpty():
        finer = F.element_at(F.array(*[held(m, 14 + 14 * i) for i, m in enumerate(FINER)]), F.col("place") + 1)
        own = F.array(F.struct("place", "held"))
        rows = small_join(rows, large, ["place", "held"], "left").select("fp", F.explode(F.when(F.col("_n").isNull(), own).otherwise(finer)).alias("l")).select("fp", "l.*")
    return rows.select(F.xxhash64("place", "held").alias("block"), "fp")


def shared_bytes(x: np.ndarray) -> np.ndarray:
    """How many of the eight bytes are zero in each of *x*, the exclusive or of two fingerprints."""
    x = x | (x >> np.uint64(4))
    x |= x >> np.uint64(2)
    x |= x >> np.uint64(1)
    return 8 - np.bitwise_count(x & np.uint64(0x0101010101010101))


def linked(a: np.ndarray, b: np.ndarray, distance: int) -> np.ndarray:
    """Which pairs link: those whose shared bytes reach the least that *distance* bits leave, and then whose bits do."""
    x = a ^ b
    kept = np.flatnonzero(shared_bytes(x) >= 8 - distance)
    return kept[np.bitwise_count(x[kept]) <= distance]


def pairs_of(begin: np.ndarray):
    """Positions of all pairs inside lists, about a million at a time: lists of two together, larger ones by rows."""
    size = np.diff(begin)
    two = begin[:-1][size == 2]
    for i in range(0, len(two), RUN):
        yield two[i : i + RUN], two[i : i + RUN] + 1
    for lo, n in zip(begin[:-1][size > 2], size[size > 2], strict=True):
        rows = max(1, (1 << 20) // n)
        for i in range(0, n - 1, rows):
            a, b = np.triu_indices(min(rows, n - i), 1, n - i)
            yield lo + i + a, lo + i + b


def links(prints: DataFrame, distance: int = DISTANCE, dense: int = DENSE) -> DataFrame:
    """``(src, dst)``: forests over distinct fingerprints ``(fp)`` that connect whatever links of *distance* bits or fewer connect."""
    if not 0 <= distance <= 3:
        raise ValueError("lists of four positions hold all pairs up to three bits only")
    rows = postings(prints, dense).repartition("block").sortWithinPartitions("block", "fp")

    def compare(batches):
        for table in linking.by_block(batches, lambda b: b.nbytes):
            block, fp = table.column(0).to_numpy(), table.column(1).to_numpy()
            names, node = np.unique(fp, return_inverse=True)
            bits = fp.view(np.uint64)
            x = y = np.zeros(0, np.int64)
            held, size = [], 0
            for a, b in pairs_of(linking.starts(block)):
                found = linked(bits[a], bits[b], distance)
                held.append((node[a[found]], node[b[found]]))
                size += len(found)
                if size > RUN:
                    x, y = linking.forest(len(names), *(np.concatenate([v, *(h[i] for h in held)]) for i, v in enumerate((x, y))))
                    held, size = [], 0
            x, y = linking.forest(len(names), *(np.concatenate([v, *(h[i] for h in held)]) for i, v in enumerate((x, y))))
            yield pa.RecordBatch.from_arrays([pa.array(names[x]), pa.array(names[y])], names=["src", "dst"])

    return rows.mapInArrow(compare, "src long, dst long")


def near_copies(documents: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE, dense: int = DENSE) -> DataFrame:
    """``(key, fingerprint, component_id)`` of every row: 16 hexadecimal digits, and the least key that links reach.

    Equal fingerprints are one node, so copies are never expanded into pairs. Texts without words have
    the fingerprint zero and link like any other. Null keys never name a component (null if there is no
    other key); repeated rows give a row each; an empty table gives an empty result.
    """
    rows = cut(fingerprints(documents, key, text))
    nodes = cut(rows.groupBy("fp").agg(F.min("key").alias("least")))
    found = cut(connected_components(cut(links(nodes.select("fp"), distance, dense))).select(F.col("node").alias("fp"), "component"))
    rooted = small_join(nodes, found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = cut(rooted)
    heads = cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = cut(small_join(rooted, heads, "root").select("fp", "component_id"))
    out = small_join(rows, named, "fp")
    return out.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    return near_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"))
