"""Fill-in-the-middle against a plain version by patterns, and back again."""

import hashlib
import re

from pyspark.sql import functions as F

from emberfold.llm import fill_middle
from tests.llm.conftest import SCHEMA, awkward_rows

MARKS = ("<P>", "<S>", "<M>")


def plain_fim(doc_id, text, rate=90, spm=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    if not text or any(m in text for m in MARKS) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (tokens[:a], tokens[a:b], tokens[b:]))
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


TEXTS = ["a", "1", "ab cd", "<P>", "x<S>y", "<M", "P> <", "<<P", "S>S>M>", "ÀÉ[a`b{c@d", "😀a😀bc", "a\r\n\tb\x00c", "é" * 7, "Zz" * 9, "<P" * 20, "<S", "<M<M<", None, ""]


def test_against_patterns(spark, awkward):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS * 40)]
    for df, want in ((spark.createDataFrame(rows, SCHEMA), [(r[0], *plain_fim(r[0], r[1])) for r in rows]), (awkward, [(r[0], *plain_fim(r[0], r[1])) for r in awkward_rows()])):
        got = fill_middle.transform(df).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r[2] for r in [(i, *plain_fim(i, t)) for i, t in enumerate(TEXTS * 40)]} == {"plain", "psm", "spm"}


def test_comes_back(spark, awkward):
    rows = [(i, t, None, None, None) for i, t in enumerate(TEXTS * 40)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for df in (docs, awkward.select(*docs.columns)):
        back = fill_middle.transform(df, keep=("doc_id", "text")).where(~fill_middle.restore(F.col("output"), F.col("form")).eqNullSafe(F.coalesce("text", F.lit(""))))
        assert back.count() == 0


def test_shares_and_empty(spark, nothing):
    forms = {r["form"]: r["count"] for r in fill_middle.transform(spark.range(4000).selectExpr("id AS doc_id", "'one two three' AS text")).groupBy("form").count().collect()}
    assert abs(forms["plain"] - 400) < 80 and abs(forms["spm"] - 720) < 100
    assert fill_middle.transform(nothing).count() == 0
    every = fill_middle.transform(spark.range(50).selectExpr("id AS doc_id", "'one two' AS text"), rate=100, spm=100)
    assert {r["form"] for r in every.collect()} == {"spm"}
