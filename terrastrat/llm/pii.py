"""Personal data: patterns propose spans, check digits confirm them and nearby words adjust the score.

DataFrame operations only. A pattern's matches are framed with a private-use character by one
``regexp_replace``; splitting at it gives the matches and, by the lengths of the parts, their places
in code points.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME, STAND_IN = "\ue000", "\ue001"
#: Fixed patterns of the base kinds, in order of rank; possessive, so that no long run is scanned twice.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that a text with a match passes.
HINT = {"email": "@", "ip": ".", "phone": "+"}
#: Kinds that this method adds.
ADDED = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: Score before context, and the words within CONTEXT characters before a span that raise or lower it.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.3}
NEAR = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|debit|pay",
    "phone": "phone|tel|call|fax|mobile",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "national_id": "ssn|social security|national id|tax id",
}
AGAINST = r"version|order|invoice|isbn|part no|serial|build"
CONTEXT, STEP, THRESHOLD = 40, 0.35, 0.5
#: Elements of an array that are summed at once, and code points of a text that lie together.
BLOCK, CHUNK = 256, 256
KINDS = [*BASE, *ADDED]
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn check, 0 modulo 10 for valid numbers."""

    def value(d: Column, i: Column) -> Column:
        v = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)

    each = F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), value)
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def _mod97(code: Column) -> Column:
    """The remainder of a rearranged account code with letters as 10 to 35; 1 for valid ones."""
    plain = F.replace(code, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    each = F.transform(
        F.split(turned, "(?!^)(?!$)"),
        lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55),
    )
    return F.aggregate(each, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\.|$)){4}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits) % 10 == 0).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return _mod97(match) == 1
    if kind == "national_id":
        return ~match.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """*body* of *value*, which is worked out once, also where a lambda uses it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Running results of *op* (from 0) over an array of ints, in blocks, so that no long array is copied for each element."""

    def short(array: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda a, v: F.struct(op(a["at"], v).alias("at"), F.concat(a["out"], F.array(op(a["at"], v))).alias("out"))
        return F.aggregate(array, start, step, lambda a: a["out"])

    def whole(array: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(array) - 1) / BLOCK).cast("int")), lambda j: F.slice(array, j * BLOCK + 1, F.lit(BLOCK)))
        return _let(blocks, joined)

    def joined(blocks: Column) -> Column:
        tops = short(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), op)))
        before = F.concat(F.array(F.lit(0)), F.slice(tops, 1, F.size(blocks) - 1))
        return F.flatten(F.zip_with(blocks, before, lambda b, o: F.transform(short(b), lambda v: op(v, o))))

    return _let(values, lambda array: F.when(F.size(array) <= BLOCK, short(array)).otherwise(whole(array)))


def _chunks(text: Column) -> Column:
    """The text in runs of CHUNK code points: places far inside are reached without counting from the beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(.{{1,{CHUNK}}})"), F.lit(1))


def _between(chunks: Column, start: Column, stop: Column) -> Column:
    """Code points start to stop of a text in chunks."""
    first = F.floor(start / CHUNK).cast("int")
    part = F.array_join(F.slice(chunks, first + 1, F.floor((stop - 1) / CHUNK).cast("int") - first + 1), "")
    return F.when(stop > start, F.substring(part, start - first * CHUNK + 1, stop - start)).otherwise("")


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """Spans of the pattern's leftmost, non-overlapping matches that the kind's check confirms, in time linear in their number."""
    rank = KINDS.index(kind)

    def spans(parts: Column) -> Column:
        ends = _running(F.transform(parts, F.char_length), lambda a, b: a + b)
        span = lambda p, e: F.struct((e - F.char_length(p)).alias("start"), F.lit(rank).alias("rank"), e.alias("end"), F.lit(kind).alias("kind"), F.lit(PRIOR[kind]).alias("score"), p.alias("part"))
        found = F.filter(F.zip_with(parts, ends, span), lambda s, i: (i % 2 == 1) & _valid(kind, s["part"]))
        return F.transform(found, lambda s: s.dropFields("part")).cast(SPAN)

    found = _let(F.split(F.regexp_replace(text, f"({pattern})", f"{FRAME}$1{FRAME}"), FRAME), spans)
    possible = text.rlike(pattern)
    if kind in HINT:
        possible = F.contains(text, F.lit(HINT[kind])) & possible
    return F.when(possible, found).otherwise(F.array().cast(SPAN))


def find(documents: DataFrame, text: str = "text") -> DataFrame:
    """*documents* with ``spans``: array of (start, rank, end, kind, score) by start, then kind.

    Places count code points of the whole text, end exclusive. Base kinds stay whatever their score;
    added kinds need a valid check digit and a score of 0.5 after context. A null text has none.
    Nothing is shuffled; equal texts have equal spans; an empty table gives an empty table.
    *documents* must not have a column spans.
    """
    rows = documents.withColumn("_t", F.translate(F.coalesce(F.col(text), F.lit("")), FRAME, STAND_IN))
    each = {f"_{k}": _matches(F.col("_t"), k, p) for k, p in (BASE | ADDED).items()}
    rows = rows.withColumns(each).withColumn("_all", F.concat(*each))

    def scored(s: Column, chunks: Column) -> Column:
        before = F.lower(_between(chunks, F.greatest(s["start"] - CONTEXT, F.lit(0)), s["start"]))
        near = reduce(lambda c, k: c.when(s["kind"] == k, before.rlike(rf"\b(?:{NEAR[k]})")), KINDS[1:], F.when(s["kind"] == KINDS[0], before.rlike(rf"\b(?:{NEAR[KINDS[0]]})")))
        score = s["score"] + F.when(near, STEP).otherwise(0.0) - F.when(before.rlike(rf"\b(?:{AGAINST})"), STEP).otherwise(0.0)
        return s.withField("score", F.least(F.greatest(F.round(score, 2), F.lit(0.0)), F.lit(1.0)))

    with_scores = _let(_chunks(F.col("_t")), lambda chunks: F.transform("_all", lambda s: scored(s, chunks)))
    some = F.sort_array(F.filter(with_scores, lambda s: (s["rank"] < len(BASE)) | (s["score"] >= THRESHOLD)))
    spans = F.when(F.size("_all") > 0, some).otherwise(F.array().cast(SPAN))
    return rows.withColumn("spans", spans).drop("_t", "_all", *each)


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replaces every span of :func:`find` in the text by its kind in angle brackets; overlapping spans as one.

    The text is joined from slices between spans, in time linear in its length and in their number.
    """

    def whole(chunks: Column) -> Column:
        past = _running(F.transform("spans", lambda s: s["end"]), lambda a, b: F.greatest(a, b))
        part = lambda s, e: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), e.alias("past"))
        return _let(F.zip_with("spans", past, part), lambda parts: joined(chunks, parts))

    def joined(chunks: Column, parts: Column) -> Column:
        def piece(s: Column, i: Column) -> Column:
            at = F.when(i > 0, F.get(parts, i - 1)["past"]).otherwise(0)
            return F.when(s["start"] >= at, F.concat(_between(chunks, at, s["start"]), F.lit("<"), s["kind"], F.lit(">"))).otherwise("")

        last = F.element_at(parts, -1)["past"]
        first = F.floor(last / CHUNK).cast("int")
        tail = F.substring(F.array_join(F.slice(chunks, first + 1, F.greatest(F.size(chunks) - first, F.lit(0))), ""), last - first * CHUNK + 1, F.lit(1 << 30))
        return F.concat(F.array_join(F.transform(parts, piece), ""), tail)

    return found.withColumn(text, F.when(F.size("spans") > 0, _let(_chunks(F.col(text)), whole)).otherwise(F.col(text)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    found = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(_joined(F.filter("spans", lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
