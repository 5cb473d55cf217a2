"""Token counts by prefix dynamic programming (see :mod:`terrastrat.llm.bytebpe`)."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from terrastrat.llm import shingles
from terrastrat.llm.bytebpe import vocabulary

LIMIT = 1024


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the public vocabulary file lies on this machine; every executor has it at its own place."""
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT, name: str = "byte_bpe_50k.json") -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit, limit_chars)`` of every row's whole text, null as empty.

    n_tokens includes special strings, one token each, but no begin or end token. limit_chars: the
    most code points whose prefix takes at most *limit* tokens, read from the prefix counts. Rows are
    handled one by one: nothing is shuffled and a lost task is just run again. Null keys and repeated
    rows give a row each; an empty table gives an empty one.
    """
    kind = documents.schema[key].dataType.simpleString()

    def count(batches):
        v = vocabulary(vocabulary_path(name))
        for batch in batches:
            sizes, totals, limits = [], [], []
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
            for lo, hi in shingles.runs(lengths, size=lambda n: n):
                texts = [t.as_py() or "" for t in batch.column(1)[lo:hi]]
                for t, (n, words, each) in zip(texts, v.totals_of(texts), strict=True):
                    totals.append(n)
                    limits.append(len(t) if n <= limit else truncation(v, t, limit, words, each))
                sizes.extend(lengths[lo:hi])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > limit for n in totals]), pa.array(limits, pa.int64())],
                names=["key", "n_bytes", "n_tokens", "over_limit", "limit_chars"],
            )

    rows = documents.select(key, text).mapInArrow(count, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean, limit_chars long")
    return rows.withColumnRenamed("key", key)


def truncation(v, text: str, limit: int, words: list[str] | None, each) -> int:
    """As ``v.within`` but reads the prefix counts only around the word that crosses the limit."""
    if words is None:
        return v.within(text, limit)
    sums = each.cumsum()
    last = int(sums.searchsorted(limit, side="right"))
    # prefixes are exact from the start of the white space run before this word
    first = last
    while first and v.blank(words[first - 1]) == len(words[first - 1]):
        first -= 1
    start, base = sum(map(len, words[:first])), int(sums[first - 1]) if first else 0
    end = start + sum(map(len, words[first : last + 1]))
    tail = v.table(text[start : end + 1])[: end - start + 1]
    return start + int((tail + base <= limit).nonzero()[0][-1])


def op7_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
