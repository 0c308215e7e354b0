"""Fill-in-the-middle: a text is cut into prefix, middle and suffix at token borders, and the parts are laid out anew.

A text becomes an array of code points. Neighbouring code points of one class (ASCII letters) belong to one token, all
others are tokens of their own, so that the borders are where two neighbours are not both letters. Two borders are chosen
by a digest of the document's id; the parts are slices of the array.

psm is ``<P>`` prefix ``<S>`` suffix ``<M>`` middle, spm is ``<S>`` suffix ``<P>`` prefix ``<M>`` middle, plain is the text as it is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P, S, M = "<P>", "<S>", "<M>"
#: Per cent of the documents that are laid out anew, and of these, that are spm.
RATE, SPM = 90, 20
CUT = "n long, prefix_chars long, middle_chars long, output string"


def borders(points: np.ndarray) -> np.ndarray:
    """Where tokens begin, in ``points`` (uint32 code points), and the end of the last one."""
    letter = ((points | 32) - 97) < 26
    inner = np.flatnonzero(~(letter[1:] & letter[:-1])) + 1
    return np.concatenate([[0], inner, [len(points)]]) if len(points) else np.zeros(1, np.int64)


def _decode(points: np.ndarray) -> str:
    return points.tobytes().decode("utf-32-le")


def cut(text: str, h1: int, h2: int, form: str) -> tuple[int, int | None, int | None, str]:
    """Number of tokens, code points of prefix and middle (None if plain) and the output of one text."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    at = borders(points)
    n = len(at) - 1
    if form == "plain":
        return n, None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = int(at[a]), int(at[b])
    prefix, middle, suffix = _decode(points[:a]), _decode(points[a:b]), _decode(points[b:])
    return n, a, b - a, f"{P}{prefix}{S}{suffix}{M}{middle}" if form == "psm" else f"{S}{suffix}{P}{prefix}{M}{middle}"


def _cut(texts: pd.Series, h1: pd.Series, h2: pd.Series, form: pd.Series) -> pd.DataFrame:
    rows = [cut(*x) for x in zip(texts, h1, h2, form, strict=True)]
    out = pd.DataFrame(rows, columns=["n", "prefix_chars", "middle_chars", "output"])
    return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})


def digests(doc_id: str = "doc_id", seed: int = 1) -> list[Column]:
    """h1 to h4: groups of eight hex digits of the SHA-256 of ``<seed>:<doc_id>`` (a null id is written ``null``), as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def transform(docs: DataFrame, rate: int = RATE, spm: int = SPM, keep: tuple[str, ...] = ("doc_id",), seed: int = 1) -> DataFrame:
    """``keep``, n (tokens), form, prefix_chars, middle_chars (null if plain) and output for each row of ``docs``.

    A null text is empty; empty texts, and texts that hold a mark already, are plain, whatever the digest says. Whole texts
    are cut, however long. Rows of one id and text have one result, each has its own row; columns beside ``keep``, doc_id
    and text change nothing; an empty table gives an empty table.
    """
    h1, h2, h3, h4 = digests(seed=seed)
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = text.contains(P) | text.contains(S) | text.contains(M)
    form = F.when((text == "") | marked | (h3 % 100 >= rate), F.lit("plain")).when(h4 % 100 < spm, F.lit("spm")).otherwise(F.lit("psm"))
    made = docs.select(*keep, form.alias("_form"), F.pandas_udf(_cut, CUT)(text, h1, h2, form).alias("_cut"))
    return made.select(*keep, "_cut.n", F.col("_form").alias("form"), "_cut.prefix_chars", "_cut.middle_chars", "_cut.output")


def restore(output: Column, form: Column) -> Column:
    """The text that was laid out as ``output``: a mark is only where ``transform`` put it, so that its first place is the place."""
    first = lambda x, mark: F.split_part(x, F.lit(mark), F.lit(1))
    rest = lambda x, mark: F.split_part(x, F.lit(mark), F.lit(2))
    middle = rest(output, M)
    psm = F.concat(rest(first(output, S), P), middle, first(rest(output, S), M))
    spm = F.concat(first(rest(output, P), M), middle, rest(first(output, P), S))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def oracle() -> str:
    """DuckDB SQL of the query's columns: tokens are found by pattern, and the text is rebuilt from the output (nullable numbers are doubles, as pandas has them)."""
    h = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
    k AS (SELECT doc_id, t, h, CAST(len(w) AS BIGINT) AS n, w, {h(0)} % (len(w) + 1) AS a, {h(1)} % (len(w) + 1) AS b,
      CASE WHEN t = '' OR contains(t, '{P}') OR contains(t, '{S}') OR contains(t, '{M}') OR {h(2)} % 100 >= {RATE} THEN 'plain' WHEN {h(3)} % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM (SELECT *, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w FROM d)),
    p AS (SELECT doc_id, t, n, form, array_to_string(w[:least(a, b)], '') AS p, array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(w[greatest(a, b) + 1:], '') AS s FROM k),
    o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{P}' || p || '{S}' || s || '{M}' || m ELSE '{S}' || s || '{P}' || p || '{M}' || m END AS o FROM p),
    r AS (SELECT *, CASE form WHEN 'plain' THEN [o, '', ''] WHEN 'psm' THEN regexp_extract_all(o, '(?s)^{P}(.*){S}(.*){M}(.*)$', 1) || regexp_extract_all(o, '(?s)^{P}(.*){S}(.*){M}(.*)$', 3) || regexp_extract_all(o, '(?s)^{P}(.*){S}(.*){M}(.*)$', 2)
      ELSE regexp_extract_all(o, '(?s)^{S}(.*){P}(.*){M}(.*)$', 2) || regexp_extract_all(o, '(?s)^{S}(.*){P}(.*){M}(.*)$', 3) || regexp_extract_all(o, '(?s)^{S}(.*){P}(.*){M}(.*)$', 1) END AS parts FROM o)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS DOUBLE) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS DOUBLE) END AS middle_chars, sha256(o) AS output_sha256, sha256(array_to_string(parts, '')) AS restored_sha256 FROM r"""
