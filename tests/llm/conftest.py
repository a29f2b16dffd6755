import random

import pytest

LONG = " ".join(f"w{i % 97}x{i % 31}" for i in range(30_000))


def base_rows():
    """(doc_id, text, lang, source, n_chars) with nulls, empty and long texts, copies, near copies, shared passages and ties."""
    rnd = random.Random(7)
    vocab = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    fresh = lambda n: [rnd.choice(vocab) for _ in range(n)]
    passage, line = fresh(60), " ".join(fresh(12))
    rows = []
    for i in range(60):
        w = fresh(rnd.randint(25, 160))
        if i % 5 == 0:
            w[10:10] = passage
        text = " ".join(w[:20]) + "\n" + " ".join(w[20:])
        if i % 4 == 0:
            text += "\n  " + line.upper() + "\t\n" + line
        rows.append(text)
    near = fresh(120)
    for _ in range(25):  # near copies of a base that only some of them link with
        w = list(near)
        for _ in range(rnd.randint(0, 2)):
            w[rnd.randrange(len(w))] = rnd.choice(vocab)
        rows.append(" ".join(w))
    rows += [rows[3]] * 6 + ["", None, " \t\n", "one", "One", "two words", "a b c", "A B C", "é ñ\x0bß", "123 456 !!", LONG, LONG + " end"]
    ids = list(range(len(rows)))
    rnd.shuffle(ids)
    return [(d, t, ["en", "de", None][d % 3], [None, "b", "a", "", "Z", "é"][d % 6], len(t or "")) for d, t in zip(ids, rows, strict=True)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(base_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def sf_dir(spark, tmp_path_factory):
    """The fixture as tables on disk, for queries."""
    at = tmp_path_factory.mktemp("llm") / "tables"
    spark.createDataFrame(base_rows(), SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    text = {d: t for d, t, *_ in base_rows()}
    items = [(1, " ".join((next(t for t in text.values() if t and len(t.split()) > 80)).split()[12:52])), (2, "no such item is found in any of these texts"), (3, None), (4, "too short"), (1, "")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    urls = ["http://A.example.org/es/1", "https://example.org/en/12?x", "ftp://x.com/fr/", "http://b.com/de/x", "http://c.net", "nothing", None, "http://c.net/p#q", "x://", "http://evil.org"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{at}/pages.parquet")
    return str(at)


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("llm") / "empty"
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "page_id long, url string").write.parquet(f"{at}/pages.parquet")
    return str(at)
