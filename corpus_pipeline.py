"""Corpus pipeline over ``documents``: quality rules, near copies, personal data, source mix, packing.

Each stage takes all rows that its predecessor kept, written as Parquet and read again, and all but the
last return the columns of ``documents``. Other columns travel in a struct, so their names clash with
none that the operators add.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastrat.llm import jaccard_join, mixing, packing, pii, quality
from terrastrat.session import written


def _boxed(docs: DataFrame, own: list[str]) -> list:
    """The columns *own*, and all others as one struct."""
    return [*map(F.col, own), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in own]).alias("_box")]


def _opened(rows: DataFrame, docs: DataFrame, own: list[str], text: str | None = None) -> DataFrame:
    """The columns of *docs* again; *text* and its length are taken anew where given."""
    new = {"text": F.col(text), "n_chars": F.char_length(text).cast("long")} if text else {}
    old = lambda c: F.col(c) if c in own else F.col(f"_box.`{c}`")
    return rows.select(*[new.get(c, old(c)).alias(c) for c in docs.columns])


def line_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go; documents that the rules reject go."""
    judged = quality.judge(docs.select(*_boxed(docs, ["text"])))
    return _opened(quality.keep(judged), docs, ["text"], "clean_text")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return jaccard_join.one_of_each(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind."""
    found = pii.redact(pii.find(docs.select(*_boxed(docs, ["text"]))))
    return _opened(found, docs, ["text"], "text")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; copies are worked out on narrow rows, texts joined once."""
    # a digest of the whole row, so that no two rows of any corpus are taken for one; JSON, as maps have no hash
    rows = docs.withColumn("_id", F.unhex(F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns])), 256)))
    mixed = mixing.mix(rows.select("doc_id", "source", "_id", mixing.n_words(F.col("text")).alias("size")))
    return mixing.emit(rows, mixed, "_id").select(*docs.columns)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mix in windows of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality", line_quality),
    ("near_copies", one_of_near_copies),
    ("personal_data", without_personal_data),
    ("mixing", source_mix),
    ("packing", windows),
]
#: Verified links between shingle sets and token ids are beyond SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
