"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Within a source every document expects target / source size copies. Documents are laid out by size
and their expected copies prefix-summed; with one random offset a source, a document is emitted once
for each integer boundary that its interval crosses. Laying them out by size keeps the words taken
within the largest document's size of the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from terrastrat.operators.ranking import numbered
from terrastrat.session import cut, small_join

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
SEED = 7


def n_words(text) -> F.Column:
    """Number of runs of non-space characters; null counts none."""
    # a run is tried from its first character only, so a million blanks inside a text are passed once
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]++|(?<![\x20\x09-\x0D])[\x20\x09-\x0D]++$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``(source, source_size, target)`` from ``(source, source_size)``.

    Sources by code point, null last, weigh *weights* in turn and split *share* times the total; a
    target stops at *cap* times its source and the excess goes to the others by weight. The level is
    found by sums over all sources, one pass for each round in which further sources reach their cap.
    """
    ranked = numbered(sources.withColumn("_last", F.col("source").isNull()), "_last", "source", out="_rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    rows = cut(ranked.select("source", "source_size", weight.alias("weight")))
    limit = F.col("source_size") * F.lit(cap)
    budget = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        full = limit <= F.col("weight") * F.lit(level)
        spent, weight_left = rows.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        if not weight_left:
            break
        raised = max(0.0, budget - (spent or 0.0)) / weight_left
        if raised <= level:
            break
        level = raised
    return rows.select("source", "source_size", F.least(limit, F.col("weight") * F.lit(level)).cast("double").alias("target"))


def mix(documents: DataFrame, source: str = "source", size: str = "size", key: str = "doc_id", seed: int = SEED, **rule) -> DataFrame:
    """*documents* with ``source_size``, ``target`` and ``copies`` (long), every row kept.

    Rows should be narrow: they are sorted once over the cluster (see :func:`emit` for the texts). A
    null source is a source like any other and comes last. Documents of size 0 have as many copies as
    the boundaries that they cross, which take no words. Rows of one source, size and key are told
    apart by the order that the sort leaves them in, so they may swap their copies. An empty input
    gives an empty result. Columns of *documents* may have any other names than those added.
    """
    rows = numbered(cut(documents), F.asc_nulls_last(source), F.desc(size), F.asc_nulls_last(key), out="_rn")
    sums = rows.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"), (F.min("_rn") - 1).alias("_before"))
    sums = cut(sums)
    targets = source_targets(sums.select("source", "source_size"), **rule).select(F.col("source").alias("_s"), "target")
    plan = small_join(sums, targets, F.col("source").eqNullSafe(F.col("_s"))).select("_s", "source_size", "target", "_before")
    rows = small_join(rows, cut(plan), F.col(source).eqNullSafe(F.col("_s")))
    place = F.col("_rn") - F.col("_before")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("_s", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    copies = (F.floor(place * each + offset) - F.floor((place - 1) * each + offset)).cast("long")
    return rows.withColumn("copies", copies).drop("_rn", "_s", "_before")


def emit(documents: DataFrame, mixed: DataFrame, identity: str) -> DataFrame:
    """Each of *documents* as often as *mixed*, the result of :func:`mix` on its narrow columns, takes it.

    identity: a column of both that tells rows apart, such as a hash of all columns; rows that share
    it are taken to be equal, and one of them is emitted as often as all together.
    """
    taken = cut(mixed.groupBy(identity).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_n")))
    if not taken.filter("_n > 1").isEmpty():
        documents = documents.dropDuplicates([identity])
    wanted = cut(taken.filter("_copies > 0").select(identity, "_copies"))
    rows = small_join(documents, wanted, identity)
    return rows.withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)"))).select(*documents.columns)


def op4_systematic_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    mixed = mix(docs)
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
        "copies",
    )


OP4_SQL = """
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    CASE (row_number() OVER (ORDER BY (source IS NULL), source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spent,
    sum(w) OVER (ORDER BY 2.0::DOUBLE * source_size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
    1.5::DOUBLE * sum(source_size) OVER () AS budget
  FROM s),
l AS (SELECT max((budget - coalesce(spent, 0)) / w_left) AS level FROM r WHERE (budget - coalesce(spent, 0)) / w_left <= cap / w),
t AS (SELECT source, source_size, least(cap, w * coalesce((SELECT level FROM l), 1e300)) AS target FROM r),
p AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id) AS place,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS each,
    ('0x' || substr(md5('7:' || coalesce(d.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, floor(place * each + u) - floor((place - 1) * each + u) AS copies FROM p)
SELECT doc_id, size, source_size, target, copies::BIGINT * size AS taken, copies::BIGINT AS copies
FROM c
"""
