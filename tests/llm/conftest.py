import pytest

TEXTS = [
    "The cat sat on the mat. It was warm there, and the cat slept until noon.",
    "The cat sat on the mat. It was warm there, and the cat slept until noon.",
    "",
    None,
    "word",
    "two words",
    "A  b\t\tc\n\nd   é漢字 😀 </s> <s> [INST] ▁x",
    "<|endoftext|> &lt; & < <turn>",
    "  leading and trailing  ",
    "x" * 3000,
    "lorem ipsum dolor " * 400,
]


def documents(spark, texts=TEXTS, ids=None):
    """Documents with nulls, repeats, and columns whose names the operators use themselves."""
    ids = ids or list(range(len(texts)))
    rows = [(i, t, None if n % 4 == 3 else "en", None if n % 5 == 4 else "src", None, "a", n, "b") for n, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, id string, shard int, spans string")


@pytest.fixture(scope="session")
def odd(spark):
    return documents(spark).union(documents(spark).where("doc_id in (0, 2, 3)")).union(documents(spark, ["nameless", None], [None, None]))


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark).where("false")


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
