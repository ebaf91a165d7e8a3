import random

import pytest

WORDS = "alpha beta gamma delta omega river stone cloud forest window garden silver copper morning evening letter number simple quiet bright".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, row string, key string, kept boolean, rank int"


def odd_rows() -> list[tuple]:
    """Nulls in every column, empty and very long texts, ties and repeated rows, and columns that clash with the operators' own."""
    texts = [None, "", " \n\t ", "one", "a b c d", prose(1, 60), prose(1, 60), prose(2, 300), prose(2, 299) + " changed", prose(3, 20000), "x" * 50000, "na " * 400,
             "\n".join(["same line of words here"] * 30), "É́ ok wide ▁ under 語 😀 \x00 \x1c end\r\n", prose(4, 80)]
    rows = []
    for i, t in enumerate(texts):
        rows.append((i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, len(t) if t else None, i, "r", None, None, 1))
    rows += [rows[7], rows[7], (None, prose(5, 70), None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None),
             (3, prose(6, 55), "en", "s1", 1, 1, "r", "k", True, 2)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
