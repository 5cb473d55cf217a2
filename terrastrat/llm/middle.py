"""Fill-in-the-middle examples: a text is cut at two seeded unit borders and its middle is moved to the end."""

from __future__ import annotations

import hashlib
import re
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 42
#: Shares in hundredths: of texts that are transformed, and among those of the form that begins with the suffix.
SHARE, SUFFIX_FIRST = 50, 80
MARKS = ("<P>", "<S>", "<M>")
#: A unit: a word with the white space before it, or white space that ends the text. Runs are never given back, so long ones are passed once.
UNIT = regex.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")


def unit_ends(text: str) -> array:
    """Where each unit ends, in code points, as a compact array."""
    return array("Q", (m.end() for m in UNIT.finditer(text)))


def example(key: str, text: str, seed: int, share: int, suffix_first: int, marks: tuple) -> tuple:
    """(units, form, prefix's and middle's code points, output, digest of the output) of one text."""
    ends = unit_ends(text)
    drawn = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    first, second, chance, order = (int(drawn[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or chance % 100 >= share or any(m in text for m in marks):
        return len(ends), "plain", None, None, text, hashlib.sha256(text.encode()).hexdigest()
    low, high = sorted((first % (len(ends) + 1), second % (len(ends) + 1)))
    start, stop = (ends[i - 1] if i else 0 for i in (low, high))
    prefix, middle, suffix = text[:start], text[start:stop], text[stop:]
    p, s, m = marks
    form = "spm" if order % 100 < suffix_first else "psm"
    output = "".join((s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle))
    return len(ends), form, start, stop - start, output, hashlib.sha256(output.encode()).hexdigest()


def fill_in_middle(
    documents: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, share: int = SHARE, suffix_first: int = SUFFIX_FIRST, marks: tuple = MARKS
) -> DataFrame:
    """``(key, n, form, prefix_chars, middle_chars, output, output_sha256)`` of every row's whole text.

    form: ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix,
    middle), each part behind its mark of *marks* (prefix, suffix, middle). A text that is empty or holds a
    mark stays plain, so :func:`restored` is exact. Null texts are empty; a null key draws as an empty
    one; rows of one key and text give equal rows, as many as there are; an empty table gives an empty
    one. Rows are handled one by one: nothing is shuffled and a lost task is just run again.
    Raises if a mark's first character stands elsewhere in the marks, as a part and a mark could then be taken for another mark.
    """
    if len({m[:1] for m in marks}) > 1 or any(not m or marks[0][0] in m[1:] for m in marks) or len(set(marks)) < 3:
        raise ValueError("marks must be distinct, begin with one character and hold it nowhere else")

    @F.pandas_udf("n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string")
    def cut(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [example(k if isinstance(k, str) else "", t if isinstance(t, str) else "", seed, share, suffix_first, marks) for k, t in zip(keys, texts, strict=True)]
        found = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])
        return found.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    made = documents.select(F.col(key).alias("_key"), cut(F.col(key).cast("string"), F.col(text)).alias("_made"))
    return made.select(F.col("_key").alias(key), "_made.*")


def restored(output: Column, form: Column, marks: tuple = MARKS) -> Column:
    """The text that an example was made of, from its output and form."""
    parts = F.split(output, "|".join(map(re.escape, marks)), -1)
    prefix, suffix = (F.when(form == "spm", parts[a]).otherwise(parts[b]) for a, b in ((2, 1), (1, 2)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, parts[3], suffix))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of all documents by their digests; every one is rebuilt from its output."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rebuilt = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", rebuilt.alias("restored_sha256"))


OP11_SQL = r"""
WITH u AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS d
  FROM documents),
h AS (
  SELECT *, len(units)::BIGINT AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4
  FROM u),
f AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
p AS (
  SELECT doc_id, n, form, text, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
    coalesce(array_to_string(units[b + 1:], ''), '') AS suffix
  FROM f),
o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output
  FROM p),
r AS (SELECT *, CASE WHEN form <> 'plain' THEN string_split_regex(output, '<P>|<S>|<M>') END AS parts FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(output) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN parts[2] || parts[4] || parts[3] ELSE parts[3] || parts[4] || parts[2] END) AS restored_sha256
FROM r
"""
