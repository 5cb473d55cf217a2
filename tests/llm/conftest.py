import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, h string, spans string"


def prose(n: int, seed: int) -> str:
    import random

    r = random.Random(seed)
    words = ["ab", "the", "river", "stone", "of", "a", "light", "from", "old", "garden", "seven", "walks", "über", "naïve", "time"]
    out = []
    for i in range(n):
        out.append(r.choice(words) + (str(r.randint(0, 99)) if r.random() < 0.4 else ""))
        if i % 11 == 10:
            out[-1] += "."
    return " ".join(out) + "."


@pytest.fixture(scope="session")
def odd_rows():
    """Documents with nulls, empty and long texts, repeats, ties and near copies."""
    base = prose(120, 1)
    near = base.replace("garden", "gardens", 1)
    long = prose(6000, 2)
    texts = [base, base, near, "", None, " \n\t ", "one two", long, "x" * 5000, prose(80, 3) + "\n" + base, "call +1 (555) 123-4567 or a.b@c.de 4111 1111 1111 1111 10.0.0.1"]
    rows = [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, base, None, None, None), (None, None, None, None, None), (3, "", "en", "s0", 0), (0, base, "en", "s0", len(base)), (0, base, "en", "s0", len(base))]
    marks = prose(1500, 4).replace(".", "")
    rows += [(200 + i, t, "en", "hot", None) for i, t in enumerate(["a " + " " * 150_000 + " b", "x" * 60_000 + " y", marks, prose(30, 5) + " \n" * 40_000, "1 " * 20_000])]
    rows.append((300, "a7@b.co " * 12_500, "en", "hot", None))
    rows += [(100 + i, prose(60 + i, 100 + i), "en", "hot", None) for i in range(30)]
    return [(*r, "clash", 1, "clash", "clash") for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """Those documents, with extra columns whose names operators use themselves."""
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_folder(odd, tmp_path_factory):
    """A folder with these documents as a table."""
    folder = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture(scope="session")
def none_folder(none, spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("none"))
    none.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder
