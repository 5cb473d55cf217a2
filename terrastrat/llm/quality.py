"""Line-first quality rules, in DataFrame operations only.

Every line of a text is judged by punctuation, navigation and boilerplate rules; failing lines are
removed, and a document that loses too much of its text, or fails the base rules, is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document may lose at most this share of its characters to line rules.
MAX_LOSS = 0.4
#: A line needs a sentence mark somewhere.
SENTENCE = "[.!?:;。！？]"
#: Signs that call for a closer look at a line, and how many of them a word may carry on average.
ODD = r"[#*$%&|<>{}»•]|!!"
ODD_PER_WORD = 0.34
#: Separators between the entries of a navigation line: at least two of them, and at most so many words each.
NAVIGATION, WORDS_PER_ENTRY = r"[\x20\x09](?:[|»›•·>/]|::|->)[\x20\x09]", 4
#: A line is boilerplate if these phrases make up enough of it: one in at most so many words, however long it is.
WORDS_PER_PHRASE = 32
BOILERPLATE = (
    r"(?i)(?:^|[^a-z])(?:licen[sc]ed under|released under the|this work is licen[sc]ed|all rights reserved|copyright \(c\)|terms of (?:use|service)"
    r"|privacy policy|cookie policy|use cookies|enable javascript|click here|sign up|log in|subscribe to|share (?:this|on)|powered by)"
)


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def line_fails(line: Column) -> Column:
    """Whether a line holding a word is to be removed; lines without words stay."""
    count = lambda pattern: F.regexp_count(line, F.lit(pattern))
    words = count(r"[^\x20\x09-\x0D]+")
    # an interpreted lambda evaluates the arms in turn, so most lines meet cheap searches only
    return (
        F.when(~line.rlike(SENTENCE), line.rlike(r"[^\x20\x09-\x0D]"))
        .when(line.rlike(ODD) & (count(ODD) > F.lit(ODD_PER_WORD) * words), F.lit(True))
        .when(line.rlike(NAVIGATION) & (count(NAVIGATION) >= 2) & (count(NAVIGATION) * WORDS_PER_ENTRY >= words), F.lit(True))
        .when(line.rlike(BOILERPLATE), count(BOILERPLATE) * WORDS_PER_PHRASE >= words)
        .otherwise(F.lit(False))
    )


def repeat_words(words: Column, windows: Column) -> Column:
    """Words inside three-word windows that occur twice or more, from the windows' hashes in order."""

    def covered(s: Column) -> Column:
        pairs = F.zip_with(
            F.slice(s, F.lit(1), F.size(s) - 1),
            F.slice(s, F.lit(2), F.size(s) - 1),
            lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
        )
        return F.sort_array(F.array_distinct(F.flatten(pairs)))

    def length(p: Column) -> Column:
        gaps = F.zip_with(F.slice(p, F.lit(1), F.size(p) - 1), F.slice(p, F.lit(2), F.size(p) - 1), lambda a, b: F.least(F.lit(3), b - a))
        return F.aggregate(gaps, F.lit(0), lambda acc, x: acc + x) + 3

    marked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # one-element arrays bind a value so that the lambdas don't compute it again
    places = F.transform(F.array(marked), covered)[0]
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), F.transform(F.array(places), length)[0]).otherwise(F.lit(0))


def judge(documents: DataFrame, text: str = "text") -> DataFrame:
    """*documents* with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines,
    n_removed_lines, clean_text, kept``.

    A null or empty text has no words, fails the base rules and has an empty clean_text. Nothing is
    shuffled; every figure is of the whole text. Repeated rows are judged alike; an empty table gives
    an empty table. *documents* must not have columns of the names added.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = documents.withColumn("_t", t)
    rows = rows.withColumn("_words", word_list(F.col("_t"))).withColumn("_lines", F.split("_t", "\n"))
    n = F.size("_words")
    windows = F.transform(
        F.slice("_words", F.lit(1), F.greatest(n - 2, F.lit(0))),
        lambda w, i: F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)),
    )
    rows = rows.withColumns(
        {
            "_windows": windows,
            "_worded": F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "_passing": F.filter("_lines", lambda x: ~line_fails(x)),
        }
    )
    rows = rows.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.char_length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(F.col("_t"), F.lit(SYMBOLS)).cast("long"),
            "n_dup_lines": (F.size("_worded") - F.size(F.array_distinct("_worded"))).cast("long"),
            "n_repeat_words": repeat_words(F.col("_words"), F.col("_windows")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_removed_lines": (F.size("_lines") - F.size("_passing")).cast("long"),
            "clean_text": F.array_join("_passing", "\n"),
        }
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    enough = F.char_length("clean_text") >= F.lit(1 - MAX_LOSS) * F.char_length("_t")
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & enough).drop("_t", "_words", "_lines", "_windows", "_worded", "_passing")


def keep(judged: DataFrame) -> DataFrame:
    """The rows of :func:`judge` that are kept.

    The verdict passes a column that the optimiser may not move, else the filter would be pushed below
    the projections and every rule would be computed several times over.
    """
    fence = F.when(F.monotonically_increasing_id() >= 0, F.col("kept"))
    return judged.withColumn("_fence", fence).filter("_fence").drop("_fence")


def op6_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality figures and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        "n_lines",
        "n_removed_lines",
    )


OP6_SQL = rf"""
WITH d AS (
  SELECT doc_id, t, ln, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') AS w,
    list_filter(ln, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS worded,
    list_filter(ln, lambda x: NOT CASE
      WHEN NOT regexp_matches(x, '{SENTENCE}') THEN regexp_matches(x, '[^\x20\x09-\x0D]')
      WHEN len(regexp_extract_all(x, '{ODD}')) > {ODD_PER_WORD} * len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) THEN true
      WHEN len(regexp_extract_all(x, '{NAVIGATION}')) >= 2
        AND len(regexp_extract_all(x, '{NAVIGATION}')) * {WORDS_PER_ENTRY} >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) THEN true
      ELSE regexp_matches(x, '{BOILERPLATE}')
        AND len(regexp_extract_all(x, '{BOILERPLATE}')) * {WORDS_PER_PHRASE} >= len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) END) AS passing
  FROM (SELECT doc_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS ln FROM documents)),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM hit) GROUP BY doc_id),
f AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '{SYMBOLS}'))::BIGINT AS n_symbols,
    (len(worded) - len(list_distinct(worded)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ln)::BIGINT AS n_lines, (len(ln) - len(passing))::BIGINT AS n_removed_lines,
    length(array_to_string(passing, chr(10))) >= {1 - MAX_LOSS}::DOUBLE * length(t) AS enough
  FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND enough AS kept, n_lines, n_removed_lines
FROM f
"""
