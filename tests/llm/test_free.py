"""Near copies, archives, token counts, passages, packing and fingerprints."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import plainly as plain
import pytest
from conftest import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrastrat.llm import bytebpe, fingerprints, jaccard_join, linking, packing, shingles, substring_dedup, tokencount, warc

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokencount.vocabulary_path())


@pytest.fixture(scope="module")
def vocabulary():
    return bytebpe.vocabulary(tokencount.vocabulary_path())


def small_docs(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


# words, shingles, MinHash


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab é\n\t\x1c.", max_size=40), max_size=12))
def test_words_are_those_of_the_pattern(texts):
    w = shingles.Words([t.encode() for t in texts])
    got = [w.buffer[a:b].tobytes().decode() for a, b in zip(w.start, w.end, strict=True)]
    assert got == [x for t in texts for x in plain.WORD.findall(t)]
    assert list(np.diff(w.first)) == [len(plain.WORD.findall(t)) for t in texts]
    same = defaultdict(set)
    for word, h in zip(got, w.hash, strict=True):
        same[word].add(int(h))
    assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


def test_shingle_hashes_stand_for_their_words():
    texts = [prose(40, i) for i in range(5)] + ["", "a", "a b c d", "a b c d e"]
    w = shingles.Words([t.encode() for t in texts])
    h, begin = shingles.shingles(w.hash, w.first)
    for i, t in enumerate(texts):
        assert len(set(h[begin[i] : begin[i + 1]])) == len(plain.shingle_set(t))


def test_signatures_do_not_depend_on_the_batch():
    texts = [prose(30 + i, i).encode() for i in range(20)] + [b""]
    whole = fingerprints.lanes(texts)
    assert (whole == np.concatenate([fingerprints.lanes([t]) for t in texts])).all()
    assert (whole[-1] == 0xFFFF).all()


# n-gram Jaccard join


def test_runs_reach_the_recall():
    assert (1 - jaccard_join.survival(jaccard_join.MAX_DEPTH)) ** jaccard_join.runs_for() <= 1 - jaccard_join.RECALL


def check_near(rows, documents):
    assert Counter(map(tuple, rows)) == Counter(plain.near_classes(documents))


def test_near_copies_of_all_documents(spark):
    check_near(jaccard_join.op3_chosen_path_join(spark, SMALL).collect(), list(small_docs(spark).items()))


def test_near_copies_of_odd_rows(spark, odd_folder, odd_rows, none_folder):
    check_near(jaccard_join.op3_chosen_path_join(spark, odd_folder).collect(), [(r[0], r[1]) for r in odd_rows])
    assert jaccard_join.op3_chosen_path_join(spark, none_folder).count() == 0


def test_large_groups_are_split_and_compared_in_blocks(spark, monkeypatch):
    """A group of near copies beyond every leaf and tile, beside exact copies of its members."""
    monkeypatch.setattr(jaccard_join, "LEAF", 8)
    monkeypatch.setattr(linking.likely_links, "__defaults__", (8,))
    monkeypatch.setattr(linking.exact_links, "__defaults__", (8,))
    monkeypatch.setattr(linking.groups, "__defaults__", (8,))
    words = prose(150, 9).split()
    rows = []
    for i in range(45):
        w = list(words)
        w[(i * 7) % 150] = f"new{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, rows[i % 3][1]) for i in range(30)] + [(200 + i, prose(90, 200 + i)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.match(df).select("doc_id", "class_id", "copy_of", "links", "linked_documents").collect()
    check_near(got, rows)


def test_one_row_of_each_class_stays(spark, odd, odd_rows):
    kept = jaccard_join.one_of_each(odd)
    assert kept.columns == odd.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    sets = [plain.shingle_set(t) for _, t in rows]
    assert all(plain.jaccard(a, b) < 0.8 for i, a in enumerate(sets) for b in sets[:i])
    classes = {(c[1], c[2] is None) for c in plain.near_classes([(r[0], r[1]) for r in odd_rows])}
    assert len(rows) == len(classes)


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 12), st.data())
def test_forest_has_the_graph_s_components(n, data):
    pairs = data.draw(st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=20))
    a, b = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
    node, root = linking.forest(n, a, b)
    part = list(range(n))

    def find(x):
        while part[x] != x:
            x = part[x]
        return x

    for x, y in pairs:
        part[find(x)] = find(y)
    label = np.arange(n)
    label[node] = root
    assert all((label[x] == label[y]) == (find(x) == find(y)) for x in range(n) for y in range(n)) and len(node) < n


# archives


def test_archives_of_all_pages(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = warc.op5_warc_transactions(spark, SMALL).collect()
    assert len(rows) == len(pages)
    first = defaultdict(list)
    for k, p in pages.items():
        first[p].append(k)
    for r in rows:
        p = pages[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(p), base64.b32encode(hashlib.sha1(p).digest()).decode())
        top = max(first[p])
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == top else ("revisit", top))


PAGES = [(1, "u", None), (2, "u\r\nx", "same"), (5, None, "same"), (3, "v", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"), (None, "n", "same"), (5, None, "same"), (7, "z", ""), (9, "w", "é🙂\r\n" * 20_000)]


@pytest.mark.parametrize(("least", "codec"), [(0, "gzip"), (1000, "none")])
def test_archives_of_odd_pages(spark, tmp_path, least, codec):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"), least=least, codec=codec)
    rows = warc.captures(spark, str(tmp_path / "w")).collect()
    assert Counter(r.metadata.page_id for r in rows) == Counter(None if p[0] is None else str(p[0]) for p in PAGES)
    for r in rows:
        assert r.request.type == "request" and r.request.record_id == r.capture_id == r.response.concurrent_to == r.metadata.concurrent_to
        assert r.request.uri == r.response.uri and "\n" not in r.response.uri
    kinds = Counter(r.response.type for r in rows)
    assert kinds == (Counter(response=5, revisit=3) if least == 0 else Counter(response=8))


def test_records_of_gzip_members_and_broken_archives():
    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    got = list(warc.records(gzip.compress(one) + gzip.compress(one)))
    assert len(got) == 2 and got[0][1] == b"abcd" and got[0][0]["warc-type"] == "response"
    with pytest.raises(ValueError, match="cut short"):
        list(warc.records(one[:-7]))
    with pytest.raises(ValueError, match="no record"):
        list(warc.records(b"<html>"))


def test_transactions_join_on_the_concurrent_identifier(spark):
    row = lambda i, kind, to: (i, kind, "u", "d", to, None, 1, "x", None)
    df = spark.createDataFrame([row("q", "request", None), row("a", "response", "q"), row("m", "metadata", "q"), row("lone", "response", None), row("m2", "metadata", "zz")], warc.RECORD)
    got = {r.capture_id: (r.request is not None, r.response.record_id, r.metadata and r.metadata.record_id) for r in warc.transactions(df).collect()}
    assert got == {"q": (True, "a", "m"), "lone": (False, "lone", None)}


# token counts


PIECES = ["a", "the", " ", "  ", "\n", "'s", "'re", "'ll", "'", "1", "é", "漢", "!", "<|endoftext|>", "<|end", "ing", "\t", "🙂", "\xa0", "\x85", "\x1c"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_every_prefix_count_equals_the_library_s(library, vocabulary, text):
    want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    assert vocabulary.table(text).tolist() == want and vocabulary.total(text) == want[-1]
    for limit in (0, 1, 3):
        if want[-1] > limit:
            _, words, each = vocabulary.totals_of([text])[0]
            assert tokencount.truncation(vocabulary, text, limit, words, each) == vocabulary.within(text, limit) == max(k for k, n in enumerate(want) if n <= limit)


def test_counts_do_not_depend_on_what_is_remembered(vocabulary, monkeypatch):
    text = prose(300, 4)
    want = vocabulary.total(text)
    monkeypatch.setattr(bytebpe, "MEMO_WORDS", 5)
    monkeypatch.setattr(bytebpe, "MEMO_PAIRS", 5)
    assert vocabulary.total(text) == want and vocabulary.table(text)[-1] == want


LONG_RUNS = [" " * 10**6 + "x", "x" * 10**6, "ab" * 10**5 + " " * 3000 + "é", " \n" * 10**5, "word " * 300 + "漢" * 20_000 + " \t" * 700 + "<|endoftext|>" + "1" * 1500]


@pytest.mark.parametrize("at", range(len(LONG_RUNS)))
def test_long_runs_are_counted_and_encoded_as_the_library_does(library, vocabulary, at):
    text = LONG_RUNS[at]
    want = library.encode(text, add_special_tokens=False).ids
    assert vocabulary.total(text) == len(want)
    assert packing.encoder(tokencount.vocabulary_path()).ids(text) == want


def test_prefixes_that_end_inside_long_blank_runs(library, vocabulary):
    text = "a" + " " * 400 + "\n" * 90 + " b" + " " * 30
    want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
    assert vocabulary.table(text).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(PIECES), st.sampled_from([1, 2, 600, 1100])), max_size=5).map(lambda p: "".join(x * n for x, n in p)))
def test_ids_equal_the_library_s_on_either_path(library, text):
    assert packing.encoder(tokencount.vocabulary_path()).ids(text) == library.encode(text, add_special_tokens=False).ids


def test_token_counts_of_all_documents(spark, library):
    docs = small_docs(spark)
    for r in tokencount.op7_prefix_token_counts(spark, SMALL).collect():
        t = docs[r.doc_id]
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 1024)
        if n > 1024:
            assert len(library.encode(t[: r.limit_chars], add_special_tokens=False).ids) <= 1024 < len(library.encode(t[: r.limit_chars + 1], add_special_tokens=False).ids)
        else:
            assert r.limit_chars == len(t)


# passages


def test_bands_are_tuned_for_every_single_piece():
    bands, rows = substring_dedup.tune()
    assert 1 - (1 - 0.8**rows) ** bands >= 0.999 and all(1 - (1 - 0.8**r) ** (bands - 1) < 0.999 for r in range(1, 5))


def test_passages_without_sentence_marks_are_found(spark):
    """Eighty words planted in documents of 380 words with no mark or newline, between marks, and edited in one word."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows, planted = [], {}
    for p in range(40):
        passage = [word() for _ in range(80)]
        for i in range(4):
            own, at = [word() for _ in range(300)], r.randint(30, 270)
            copy = list(passage)
            if i == 3:
                copy[40] = word()
            if i == 2:
                own[at - 1] += "."
                copy[-1] += "."
            rows.append((len(rows), " ".join([*own[:at], *copy, *own[at:]])))
            start = len(" ".join(own[:at])) + 1
            planted[rows[-1][0]] = (start, start + len(" ".join(copy)))
    rows += [(1000 + i, " ".join(word() for _ in range(400))) for i in range(100)]
    found = defaultdict(list)
    for x in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        found[x.doc_id].append((x.start, x.end))
    assert set(found) <= set(planted)
    share = {k: sum(max(0, min(e, b) - max(s, a)) for s, e in found[k]) / (b - a) for k, (a, b) in planted.items()}
    exact, edited = [x for k, x in share.items() if k % 4 != 3], [x for k, x in share.items() if k % 4 == 3]
    assert sum(x > 0.5 for x in exact) >= 0.98 * len(exact), sorted(exact)[:20]
    # a middle word was changed: what is left on both sides must reach the least length
    assert sum(x > 0.5 for x in edited) >= 0.6 * len(edited), sorted(edited)


def recall_at(found, rows, n):
    return plain.recall(plain.repeated_runs(rows, n), [(x.doc_id, x.start, x.end) for x in found])


def test_nothing_verbatim_is_lost_in_the_documents(spark):
    """Every run of words that stands in two documents, found by comparing all windows of words."""
    rows = list(small_docs(spark).items())
    found = substring_dedup.op8_repeated_passages(spark, SMALL).collect()
    assert recall_at(found, rows, 30) >= 0.97 and recall_at(found, rows, 51) >= 0.995


@pytest.mark.parametrize("marks", [True, False])
def test_verbatim_and_edited_passages_by_brute_force(spark, marks):
    """Passages of 30 to 90 words planted anywhere, verbatim or with one word changed, in texts with and without marks."""
    r = random.Random(21 + marks)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) + ("." if marks and r.random() < 0.07 else "")
    rows, edited = [], {}
    for p in range(60):
        passage = [word() for _ in range(r.randint(30, 90) if p % 2 else r.randint(60, 90))]
        for i in range(2):
            own, at, copy = [word() for _ in range(200)], r.randint(10, 190), list(passage)
            if p % 2 == 0 and i == 1:
                copy[r.randrange(5, len(copy) - 5)] = "edited"
            start = len(" ".join(own[:at])) + 1
            rows.append((len(rows), " ".join([*own[:at], *copy, *own[at:]])))
            if p % 2 == 0 and i == 1:
                edited[rows[-1][0]] = (start, start + len(" ".join(copy)))
    found = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert recall_at(found, rows, 30) >= 0.95
    spans = [(x.doc_id, x.start, x.end) for x in found]
    assert plain.recall([(k, a, b) for k, (a, b) in edited.items()], spans) >= 0.9


def test_cuts_of_a_stretch_depend_on_words_near_by():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    core = [word() for _ in range(300)]
    cuts = []
    for n in (40, 77):
        w = shingles.Words([" ".join([*(word() for _ in range(n)), *core, *(word() for _ in range(50))]).encode()])
        first, _ = substring_dedup.cut_text(w)
        assert (np.diff(first)[1:-1] > substring_dedup.REACH).all()
        cuts.append({int(x) - n for x in first if n + substring_dedup.REACH <= x <= n + 300 - substring_dedup.REACH})
    assert cuts[0] == cuts[1] and len(cuts[0]) > 8


def test_planted_passages_are_found_and_clean_documents_are_not(spark):
    r = random.Random(12)
    passage, other = prose(60, 77), prose(55, 78)
    rows = []
    for i in range(40):
        words = prose(150, 1000 + i).split()
        if i < 6:
            at = r.randint(10, 140)
            words[at:at] = passage.split()
        elif i < 9:
            words = [*other.split(), *words]
        elif i == 9:
            words = [*words, *other.replace("river", "brook", 1).split()]
        rows.append((i, " ".join(words)))
    rows += [(50, None), (51, ""), (52, "short. text.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.repeats(df).collect()
    assert {x.doc_id for x in found} == set(range(10))
    text = dict(rows)
    for ids, planted in ((range(6), passage), (range(6, 9), other)):
        mine = [x for x in found if x.doc_id in ids]
        assert len({x.cluster_id for x in mine}) == 1 and sum(not x.removed for x in mine) == 1
        for x in mine:
            # a first or last piece may carry a word of its neighbours and still be a verified near copy
            words = text[x.doc_id][x.start : x.end].split()
            assert " ".join(words[4:-4]) in planted and x.n_words == len(words) >= 25
    left = {x.doc_id: x.text or "" for x in substring_dedup.remove(df, substring_dedup.repeats(df)).collect()}
    assert len(left) == len(rows) and left[20] == text[20] and len(left[0]) == len(text[0])
    gone = Counter(x.doc_id for x in found if x.removed)
    assert all(len(left[k]) < len(text[k]) for k in gone)


def test_near_passages_are_met_piece_by_piece(spark):
    """Edited copies of one sentence and of three, all at the threshold by brute force, are found whole."""
    r = random.Random(5)
    rows, passages = [], 0
    for sentences in (1, 3):
        for _ in range(200):
            words = [f"w{r.randrange(10**9)}" for _ in range(50 * sentences)]
            edited = list(words)
            for i in range(sentences):
                edited[50 * i + r.randrange(5, 45)] = f"e{r.randrange(10**9)}"
                words[50 * i + 49] = edited[50 * i + 49] = f"end{r.randrange(10**9)}."
                assert plain.jaccard(*(plain.shingle_set(" ".join(x[50 * i : 50 * i + 50])) for x in (words, edited))) >= 0.8
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(edited))]
            passages += 1
    spans = {(x.doc_id, x.start, x.end) for x in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = sum((k, 0, len(t)) in spans for k, t in rows if k % 2)
    assert whole >= 0.995 * passages, f"{whole} of {passages}"


def test_passages_of_odd_rows(spark, odd_folder, none_folder):
    assert substring_dedup.op8_repeated_passages(spark, odd_folder).count() > 0
    assert substring_dedup.op8_repeated_passages(spark, none_folder).count() == 0


# packing


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=7), st.integers(0, 120))
def test_fill_is_the_best_multiset(counts, capacity):
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= capacity}
    used = packing.fill(counts, capacity)
    assert all(used[k] <= counts[k] for k in used) and sum(k * n for k, n in used.items()) == max(sums)


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), max_size=12))
def test_plan_places_every_length(histogram):
    total = Counter()
    for used, times in packing.plan_windows(histogram, 64):
        assert sum(k * n for k, n in used.items()) <= 64
        for k, n in used.items():
            total[k] += n * times
    assert total == Counter(histogram)


def check_packed(pieces, rows, library, window=2048):
    """rows: (key, text); pieces of equal keys are matched by their document's tokens."""
    want = Counter()
    for k, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for s in range(0, len(ids), window):
            want[k, s, len(ids[s : s + window]), zlib.crc32(ids[s : s + window].tobytes()), len(ids)] += 1
    assert Counter(tuple(p)[:5] for p in pieces) == want
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for s in by.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= window
    tokens = sum(p.length for p in pieces)
    assert len(by) <= tokens / window * 1.02 + 2


def test_packing_of_all_documents(spark, library):
    check_packed(packing.op9_bin_slack_packing(spark, SMALL).collect(), list(small_docs(spark).items()), library)


def test_packing_of_odd_rows(spark, odd_folder, odd_rows, none_folder, library):
    check_packed(packing.op9_bin_slack_packing(spark, odd_folder).collect(), [(r[0], r[1]) for r in odd_rows], library)
    assert packing.op9_bin_slack_packing(spark, none_folder).count() == 0


def test_sequences_hold_the_ids(spark, library):
    rows = [(i, prose(40 + 9 * i, i)) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    packed = packing.pack(df, window=64)
    pieces = packed.collect()
    ids = {r.sequence_id: r.ids for r in packing.sequences(df, packed).collect()}
    for p in pieces:
        own = np.array(ids[p.sequence_id][p.offset : p.offset + p.length], "<u4")
        assert zlib.crc32(own.tobytes()) == p.ids_crc32


# fingerprints


def check_prints(rows, documents):
    """documents: (key, text) in order; keys must be unique."""
    sets = [plain.shingle_set(t) for _, t in documents]
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(documents)
    for i, (k, t) in enumerate(documents):
        t, following = t or "", documents[(i + 1) % len(documents)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[k]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - plain.jaccard(sets[i], plain.shingle_set(edited))) < 0.2
        assert abs(r.near_next - plain.jaccard(sets[i], sets[(i + 1) % len(documents)])) < 0.2


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_fingerprints_of_all_documents(spark, parts):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    check_prints(fingerprints.fingerprint(df, parts=parts).collect(), sorted(small_docs(spark).items()))


def test_fingerprints_of_odd_rows(spark, odd, none, odd_rows):
    rows = fingerprints.fingerprint(odd, parts=4).collect()
    assert Counter((r.doc_id, r.n_chars) for r in rows) == Counter((x[0], len(x[1] or "")) for x in odd_rows)
    prints = defaultdict(set)
    for r in rows:
        prints[r.doc_id].add(r.fingerprint)
    assert len(prints[1]) == 1 and prints[1] <= prints[0]
    assert fingerprints.fingerprint(none).count() == 0
    one = fingerprints.fingerprint(odd.filter("doc_id = 2"), parts=4).first()
    assert one.near_next == 1.0


def test_near_duplicates_by_bands(spark, odd, odd_rows):
    got = fingerprints.near_duplicates(odd.select("doc_id", "text")).collect()
    check_near([(r.doc_id, r.class_id, r.copy_of, r.links, r.linked_documents) for r in got], [(r[0], r[1]) for r in odd_rows])


def test_pipeline_stages_return_the_columns_of_documents(spark, odd, odd_rows, none):
    import corpus_pipeline

    docs = odd
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert name
        out = stage(spark, docs, SMALL)
        if i < 4:
            assert out.columns == odd.columns and dict(out.dtypes) == dict(odd.dtypes)
            docs = spark.createDataFrame(out.collect(), odd.schema)
        assert stage(spark, none, SMALL).count() == 0


def test_pipeline_equals_plain_steps(spark, library):
    """Each stage against its rule on what the stage before it kept."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = corpus_pipeline.line_quality(spark, docs, SMALL).collect()
    assert 0 < len(kept) < docs.count() and not any(plain.quality(t)[5] for t in [r.text for r in docs.collect() if r.doc_id in {k.doc_id for k in kept}])
    rows = [(r.doc_id, r.text) for r in kept]
    single = corpus_pipeline.one_of_near_copies(spark, spark.createDataFrame(kept, docs.schema), SMALL).collect()
    classes = {c[0]: c[1] for c in plain.near_classes(rows)}
    assert len(single) == len(set(classes.values())) and len({classes[r.doc_id] for r in single}) == len(single)
    clean = corpus_pipeline.without_personal_data(spark, spark.createDataFrame(single, docs.schema), SMALL).collect()
    assert len(clean) == len(single) and not any(plain.personal_spans(r.text) for r in clean) and all(r.n_chars == len(r.text) for r in clean)
    mixed = corpus_pipeline.source_mix(spark, spark.createDataFrame(clean, docs.schema), SMALL).collect()
    taken, size = Counter(), Counter()
    for rows_, c in ((mixed, taken), (clean, size)):
        for r in rows_:
            c[r.source] += len(plain.WORD.findall(r.text))
    want = plain.targets(size)
    largest = max(len(plain.WORD.findall(r.text)) for r in clean)
    assert all(abs(taken[s] - want[s]) <= largest + 1 for s in want)
    check_packed(corpus_pipeline.windows(spark, spark.createDataFrame(mixed, docs.schema), SMALL).collect(), [(r.doc_id, r.text) for r in mixed], library)
    assert corpus_pipeline.run(spark, SMALL).count() == len(corpus_pipeline.windows(spark, spark.createDataFrame(mixed, docs.schema), SMALL).collect())
