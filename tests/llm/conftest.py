import re

import pytest

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
VISIBLE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(60_000))
PROSE = "The quick brown fox jumps over the lazy dog while seven small birds watch from an old wooden fence nearby. " * 3
#: Id, text, source: nulls, empty and blank texts, no words, a long text, repeated rows, a repeated id, equal texts.
ODD = [
    (1, None, "a"),
    (2, "", None),
    (3, " \t\n ", "a"),
    (4, "--- !!! ...", "b"),
    (5, LONG, "b"),
    (6, "one", "a"),
    (6, "one", "a"),
    (6, "Two words", None),
    (None, "no id here at all", "c"),
    (None, "no id here at all", "c"),
    (8, PROSE, "a"),
    (9, PROSE.upper(), "a"),
    (10, PROSE + " and a little more", "b"),
    (11, "Line one of it.\nLine two of it.\nLine one of it.\n\n" + "x " * 80, "b"),
    (12, "ümläut ÉCOLE 数字 \U0001f600 ok\r\nnext\x0bline", "d"),
]


def words(text):
    return ALNUM.findall((text or "").translate(LOWER))


@pytest.fixture(scope="session")
def odd(spark):
    """The odd documents, with columns named like those that operators add."""
    rows = [(i, t, s, "en", len(t or ""), 7, "x", 0.5, True) for i, t, s in ODD]
    schema = (
        "doc_id bigint, text string, source string, lang string, n_chars bigint, n_words int, labels string, score double, kept boolean"
    )
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")
