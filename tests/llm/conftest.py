"""Small tables that hold every awkward case at once."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use names of, or have used, and must leave alone.
EXTRA = {"score": "1.5D", "key": "'mine'", "size": "7L", "rank": "1", "target": "2D", "kept": "false", "digest": "'d'", "base": "'b'", "near": "0", "n_words": "3L", "doc": "9L", "node": "8L", "predicted": "4", "items": "'i'", "parts": "'p'", "chunk": "5",
         "row": "'w'", "spans": "'s'", "found": "true", "sid": "6L", "rid": "3L", "block": "2L", "nth": "1", "words": "'x'", "_key": "'k'", "_source": "'s'", "_text_digest": "'t'", "_found_spans": "'f'", "_taken": "1L", "_first": "2L", "_nth": "3", "_keep": "'k'", "_score": "1.0D", "hit": "1"}


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}x{'.' if i % 9 == 8 else ''}{chr(10) if i % 27 == 26 else ''}" for i in range(n))


def awkward_rows() -> list[tuple]:
    rng = random.Random(5)
    base = prose(rng, 120)
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "b", 1),
        (3, base.replace("w1", "w2", 1), "en", None, None),
        (4, None, None, "a", None),
        (5, "", "en", "a", 0),
        (6, " \t\n\x0b\f\r ", "de", "", 6),
        (None, base, "en", "a", 3),
        (None, None, None, None, None),
        (7, "é ü 日本語 😀 " * 30, "de", "é", 9),
        (8, "password = hunter22x AKIA" + "A1" * 12 + " token: 'abc' " + "0123456789abcdef" * 3, "en", "a", 2),
        (9, prose(rng, 30_000), "en", "hot", 5),
        (10, "one", "en", "hot", 3),
        (11, "same line\n" * 60, "fr", "hot", 4),
        (-12, base + " " + prose(rng, 3), "en", "a", 3),
        (13, base, "en", "a", 1),
        (13, base, "en", "a", 1),
        (14, "copy", "en", "a", 1),
        (14, prose(rng, 40), "en", "a", 1),
    ]
    return rows + [(100 + i, prose(rng, rng.randrange(5, 90)), ["en", "de"][i % 2], f"s{i % 4}", i) for i in range(25)]


@pytest.fixture(scope="session")
def awkward(spark):
    df = spark.createDataFrame(awkward_rows(), SCHEMA)
    return df.selectExpr("*", *[f"{v} AS `{k}`" for k, v in EXTRA.items()]).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in [*range(1, 15), *range(100, 125)]] + [(3, 1, 1), (None, 1, 0), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def by_id(df, *columns):
    """Rows as sorted tuples of text, so that nulls and repeats compare."""
    return sorted(map(str, (tuple(r[c] for c in columns) for r in df.select(*columns).collect())))
