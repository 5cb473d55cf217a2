"""Fill-in-the-middle, importance resampling and SimHash against plain re-computations."""

import hashlib
import math
import random
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from conftest import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from terrastrat.llm import middle, queries, resample, simhash

sys.path.append(str(Path(__file__).parents[1]))
from oracle import connect, rows_of, rows_of_sql  # noqa: E402

SMALL = "/root/testdata/sf0.001"
UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def documents_of(spark, folder):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


# fill in the middle


def plain_example(key, text) -> tuple:
    t = text or ""
    units = UNITS.findall(t)
    d = sha(f"42:{'' if key is None else key}")
    h1, h2, h3, h4 = (int(d[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(units)
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return key, n, "plain", None, None, sha(t), sha(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return key, n, form, len(p), len(m), sha(out), sha(t)


def test_examples_equal_plain_python_and_sql(spark):
    got = middle.op11_fill_in_middle(spark, SMALL)
    rows = got.collect()
    assert Counter(map(tuple, rows)) == Counter(plain_example(*r) for r in documents_of(spark, SMALL))
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert rows_of(got) == rows_of_sql(connect(SMALL), middle.OP11_SQL)


def test_examples_of_odd_rows(spark, odd_folder, none_folder):
    got = middle.op11_fill_in_middle(spark, odd_folder)
    assert Counter(map(tuple, got.collect())) == Counter(plain_example(*r) for r in documents_of(spark, odd_folder))
    assert rows_of(got) == rows_of_sql(connect(odd_folder), middle.OP11_SQL)
    assert middle.op11_fill_in_middle(spark, none_folder).count() == 0


def test_marks_and_ends_of_marks_inside_texts(spark):
    texts = ["a <P> b", "x<S>", "<M>", "ends with <S", "a <S b<", "<<< <P <M > >", "é ü 漢字  \n", "  x \x1c y", " ", "\n\n", "a" * 1000]
    rows = [(i * 100 + j, t) for i, t in enumerate(texts) for j in range(40)]
    got = middle.fill_in_middle(spark.createDataFrame(rows, "id long, body string"), "id", "body")
    text = dict(rows)
    back = got.withColumn("back", middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(back) == len(rows) and all(r.back == text[r.id] and sha(r.output) == r.output_sha256 for r in back)
    assert all(r.form == "plain" for r in back if r.id < 300) and any(r.form != "plain" for r in back)
    with pytest.raises(ValueError):
        middle.fill_in_middle(spark.createDataFrame(rows, "id long, body string"), "id", "body", marks=("<P>", "<S<>", "<M>"))


@settings(max_examples=200, deadline=None)
@given(st.text("ab é\n\t\x1c ", max_size=60))
def test_units_are_those_of_the_pattern(text):
    assert list(middle.unit_ends(text)) == [m.end() for m in UNITS.finditer(text)]


def test_the_document_s_own_columns_do_not_matter(spark, odd):
    clash = odd.select(F.col("doc_id").alias("key"), "text").withColumns({c: F.lit("x") for c in ("n", "form", "output", "_key", "fp", "digest", "rows", "weight", "score", "rank")})
    assert middle.fill_in_middle(clash, "key").count() == odd.count()
    assert simhash.near_copies(clash, "key").count() == odd.count()
    assert resample.resample(clash, clash, "key").count() == odd.count()


# importance resampling


def plain_features(text) -> tuple:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def plain_draw(rows, target, percent=25) -> Counter:
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    found = [(k, *plain_features(x)) for k, x in rows]
    for _, _, f in found:
        s.update(map(bucket, f))
    for x in target:
        t.update(map(bucket, plain_features(x)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000))))
    out = []
    for k, n, f in found:
        weight = sum(gain(bucket(x)) for x in f) // len(f) if f else 0
        h = int(sha(f"7:{'' if k is None else k}")[:8], 16)
        out.append([k, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}
    return Counter((k, f, w, score, ranks.get(id(r))) for r in out for k, _, f, w, score in [r])


def test_draws_equal_plain_python(spark):
    benchmark = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = Counter(map(tuple, resample.op12_importance_resampling(spark, SMALL).collect()))
    assert got == plain_draw(documents_of(spark, SMALL), benchmark)


def test_draws_of_odd_rows(spark, odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    target = [prose(200, 8), None, "", prose(200, 8)]
    texts = spark.createDataFrame([(t,) for t in target], "body string")
    got = Counter(map(tuple, resample.resample(odd, texts, target_text="body", percent=60).collect()))
    assert got == plain_draw(rows, target, 60)
    assert Counter(map(tuple, resample.resample(odd, texts.limit(0), target_text="body").collect())) == plain_draw(rows, [])
    assert resample.resample(none, texts, target_text="body").count() == 0


def test_repeated_texts_are_featured_once(spark):
    text = prose(100, 3)
    df = spark.createDataFrame([(i, text if i % 3 else prose(60, i)) for i in range(90)], "doc_id long, text string")
    once = resample.featured(df, "text", 10_000)
    assert once.count() == 31 and once.agg(F.max("rows")).first()[0] == 60
    assert int(resample.bucket_counts(once, 10_000).sum()) == sum(len(plain_features(r.text)[1]) for r in df.collect())


@settings(max_examples=150, deadline=None)
@given(st.text("aZ09 é-_漢\n\x7f", max_size=60))
def test_features_are_those_of_the_pattern(text):
    n, found = plain_features(text)
    assert resample.features(text.encode(), 977)[0] == n
    assert list(resample.features(text.encode(), 977)[1]) == sorted(zlib.crc32(f.encode()) % 977 for f in found)


# SimHash


def plain_print(text) -> int:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints: list[int], distance: int = 3) -> list[int]:
    """The first place of each fingerprint's component, by comparing all."""
    a = np.array(prints, np.uint64)
    part = np.arange(len(a))
    while True:
        new = np.array([part[np.bitwise_count(a ^ x) <= distance].min() for x in a])
        if (new == part).all():
            return list(part)
        part = new


def check_simhash(rows, documents):
    prints = [plain_print(t) for _, t in documents]
    where = components(prints)
    least = {w: min((k for (k, _), v in zip(documents, where, strict=True) if v == w and k is not None), default=None) for w in set(where)}
    want = Counter((k, f"{p:016x}", least[w]) for (k, _), p, w in zip(documents, prints, where, strict=True))
    assert Counter(map(tuple, rows)) == want


def test_components_of_all_documents(spark):
    check_simhash(simhash.op13_simhash_near_dedup(spark, SMALL).collect(), documents_of(spark, SMALL))


def test_components_of_odd_rows(spark, odd_folder, none_folder):
    check_simhash(simhash.op13_simhash_near_dedup(spark, odd_folder).collect(), documents_of(spark, odd_folder))
    assert simhash.op13_simhash_near_dedup(spark, none_folder).count() == 0


def test_planes_leave_one_free_of_any_three_positions():
    assert len(simhash.PLANES) == 14
    triples = [(a, b, c) for a in range(8) for b in range(a) for c in range(b)]
    assert all(any(not set(t) & set(p) for p in simhash.PLANES) for t in triples)
    assert all(bin(m).count("1") == 32 for m in simhash.MASKS) and {bin(m).count("1") for f in simhash.FINER for m in f} == {48}


@pytest.mark.parametrize("dense", [simhash.DENSE, 3])
def test_links_connect_what_brute_force_connects(spark, dense):
    """Clusters, chains of three-bit steps and pairs at four bits; with dense lists every list is split by half bytes."""
    r = random.Random(4)
    flip = lambda x, n: x ^ sum(1 << b for b in r.sample(range(64), n))
    prints = set()
    for _ in range(150):
        x = r.getrandbits(64)
        prints |= {x, flip(x, r.randint(1, 4)), flip(x, 4), flip(x, 3)}
    x = r.getrandbits(64)
    for _ in range(40):
        prints.add(x)
        x = flip(x, 3)
    base = r.getrandbits(64)
    prints |= {base ^ (v << 20) for v in range(256)} | {0, 7, 15, (1 << 64) - 1}
    prints = sorted(prints)
    signed = [simhash.signed(p) for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), dense=dense).collect()
    at = {p: i for i, p in enumerate(signed)}
    part = list(range(len(prints)))
    assert all(bin(prints[at[e.src]] ^ prints[at[e.dst]]).count("1") for e in edges)

    def find(i):
        while part[i] != i:
            i = part[i]
        return i

    for e in edges:
        a, b = sorted((find(at[e.src]), find(at[e.dst])))
        part[b] = a
    assert [find(i) for i in range(len(prints))] == components(prints)


def test_new_queries_are_registered():
    assert {"op11_fill_in_middle", "op12_importance_resampling", "op13_simhash_near_dedup"} <= set(queries.queries())
