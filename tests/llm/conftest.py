import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, ids string, body string, row_id string, digest string, kept boolean"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, and columns whose names operators use themselves."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghiklmnoprstuvwyz") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n)) + "."
    texts = [None, "", " \n\t ", "one", "two words", "***", "été là-bas ß ǅ İ", "a" * 5000, prose(9000), "same line\n" * 400, prose(120), "日本語 のテキスト 😀 👨‍👩‍👧", "x\u00a0y\u2028z", prose(80)]
    rows = [(i, t, ["en", "fr", None][i % 3], ["s1", None][i % 2]) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (None, None, None, None), (None, texts[10], "en", "s1"), (100, texts[10], "en", "s1")]
    return spark.createDataFrame([(*r, "i", "b", "r", "d", True) for r in rows], COLUMNS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def scratch_dir(tmp_path_factory):
    return f"file://{tmp_path_factory.mktemp('scratch')}"
