"""Quality rules as weak supervision.

Each rule votes good (1) or bad (-1) or abstains (0). There are few patterns of votes (three to the number of rules at
most), so that the votes of all documents are counted by pattern, and expectation-maximisation over the patterns
estimates how often each rule is right on good and on bad documents. A document is kept if its posterior probability of
being good is at least one half and it passes the two rules that always hold (enough words, not mostly repeats); the
model is learnt from all documents that pass these.
"""

from __future__ import annotations

from functools import reduce
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.llm.columns import BLANKS, let, shingle_hashes, split_words, total
from emberfold.llm.common import settle

WINDOW = 8
SYMBOLS = "#*$%&|<>"
#: ASCII characters of words that are neither letters nor the symbols above.
OTHER = "0123456789!\"'()+,-./:;=?@[\\]^_`{}~"
ROUNDS = 15
#: Weight of a bad vote before anything is learnt; a good one weighs 1. Most documents are good, and most rules vote good
#: on most bad documents, so that equal weights would never find these.
BAD = 10
#: Pseudo-counts of a rule's right and wrong votes.
RIGHT, WRONG = 8.0, 2.0

#: Of each rule, when it votes bad and when good (in this order); SQL that Spark and DuckDB read alike.
RULES: dict[str, tuple[str, str]] = {
    "length": ("n_words < 20", "n_words >= 50"),
    "word_length": ("n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 12 * n_words)", "word_chars BETWEEN 3 * n_words AND 9 * n_words AND n_words > 0"),
    "symbols": ("4 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "letters": ("10 * n_letters < 6 * word_chars", "10 * n_letters >= 8 * word_chars"),
    "lines": ("2 * n_dup_lines > n_lines", "n_dup_lines = 0 AND n_lines > 1"),
    "repeats": ("100 * n_repeat_words > 30 * n_words", "20 * n_repeat_words <= n_words AND n_words >= 20"),
    "endings": ("n_lines > 1 AND 10 * n_closed < n_lines", "2 * n_closed >= n_lines"),
}


#: The rules that always hold.
FAILED = "(n_words < 20 OR 100 * n_repeat_words > 30 * n_words)"


def repeated_words(words: Column) -> Column:
    """How many words lie in runs of WINDOW words that are found twice or more."""

    def found(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = lambda s: F.transform(F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])), lambda x: x["i"])
        reach = lambda r: total(F.transform(r, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(r, i + 1) - x, F.lit(WINDOW)))))
        some = let(pairs, lambda s: let(F.sort_array(again(s)), reach))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(some)

    return let(shingle_hashes(words, WINDOW), found)


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the counts that the rules read, for each row of ``docs``; a null text has no words."""
    text = F.coalesce(docs["text"], F.lit(""))
    without = lambda chars: F.translate(text, chars, "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.trim(x, F.lit(BLANKS)) != "")
    closed = lambda ls: F.size(F.filter(ls, lambda x: F.rtrim(x, F.lit(BLANKS)).substr(-1, 1).isin(".", "!", "?", ":", '"')))
    rows = docs.select(
        *keep,
        let(split_words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), F.size(F.array_distinct(x)).alias("n_own"), closed(x).cast("long").alias("n_closed"))).alias("l"),
        F.length(text).cast("long").alias("n_chars_all"),
        F.length(without(BLANKS)).cast("long").alias("word_chars"),
        F.length(without(SYMBOLS)).cast("long").alias("n_plain"),
        F.length(without(BLANKS + SYMBOLS + OTHER)).cast("long").alias("n_letters"),
    )
    return rows.select(
        *keep,
        "w.n_words",
        "word_chars",
        (F.col("n_chars_all") - F.col("n_plain")).alias("n_symbols"),
        (F.col("l.n_lines") - F.col("l.n_own")).alias("n_dup_lines"),
        "w.n_repeat_words",
        "n_letters",
        "l.n_lines",
        "l.n_closed",
    )


def _log_odds(rules: list[str], prior: float, right: dict[str, tuple[float, float]]) -> str:
    """SQL of the log odds of good, given the votes; ``right`` has each rule's accuracy on good and on bad documents."""
    terms = [repr(log(prior / (1 - prior)))]
    for r in rules:
        good, bad = right[r]
        terms.append(f"CASE {r} WHEN 1 THEN {log(good / (1 - bad))!r}D WHEN -1 THEN {log((1 - good) / bad)!r}D ELSE 0D END")
    return " + ".join([terms[0] + "D", *terms[1:]])


def learn(patterns: DataFrame, rules: list[str], rounds: int = ROUNDS) -> str:
    """SQL of a document's log odds of being good, from the counts ``n`` of vote patterns; starts from weighted votes."""
    odds = " + ".join(f"CASE {r} WHEN 1 THEN 1D WHEN -1 THEN -{BAD}D ELSE 0D END" for r in rules)
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-F.expr(odds)))
        n = F.col("n").cast("double")
        sums = [F.sum(n * p).alias("good"), F.sum(n).alias("all")]
        for r in rules:
            v = F.col(r)
            some = lambda c: F.when(c, n).otherwise(0.0)
            sums += [F.sum(some(v == 1) * p).alias(f"{r}_good"), F.sum(some(v != 0) * p).alias(f"{r}_good_all"), F.sum(some(v == -1) * (1 - p)).alias(f"{r}_bad"), F.sum(some(v != 0) * (1 - p)).alias(f"{r}_bad_all")]
        s = patterns.agg(*sums).first()
        if not s["all"]:
            break
        bound = lambda x: min(0.99, max(0.01, x))
        share = lambda a, b: bound((a + RIGHT) / (b + RIGHT + WRONG))
        right = {r: (share(s[f"{r}_good"], s[f"{r}_good_all"]), share(s[f"{r}_bad"], s[f"{r}_bad_all"])) for r in rules}
        odds = _log_odds(rules, bound(s["good"] / s["all"]), right)
    return odds


def judge(docs: DataFrame, rules: dict[str, tuple[str, str]] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the counts, base_failed, posterior and kept for each row of ``docs``.

    A null or empty text has no words and fails; rows are judged one by one, so that repeats, null ids and other columns
    change nothing but the counts of votes. An empty table gives an empty table.
    """
    rules = rules or RULES
    names = list(rules)
    vote = lambda bad, good: F.expr(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END")
    failed = F.expr(FAILED)
    votes = settle(measure(docs, keep).withColumn("base_failed", failed).withColumns({f"vote_{r}": vote(*rules[r]) for r in names}))
    ballots = [f"vote_{r}" for r in names]
    # documents that fail the fixed rules would be all that the model finds to be bad
    patterns = settle(votes.where("not base_failed").groupBy(*ballots).agg(F.count(F.lit(1)).alias("n")))
    # three to the number of rules at most, once they are counted
    odds = learn(settle(patterns.coalesce(1)), ballots)
    out = votes.withColumn("posterior", 1 / (1 + F.exp(-F.expr(odds))))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def oracle() -> str:
    """DuckDB SQL of doc_id, COUNTS, base_failed and kept; the rounds of expectation-maximisation are unrolled."""
    ws = r"[\x20\x09-\x0D]"
    drop = lambda chars: reduce(lambda s, c: f"replace({s}, {_quoted(c)}, '')", chars, "t")
    names = [f"v_{r}" for r in RULES]
    votes = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS v_{r}" for r, (bad, good) in RULES.items())
    parts = [
        f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
        win AS (SELECT rid, i, list_slice(ws, i, i + {WINDOW - 1}) AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w)),
        rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
        cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM rep) GROUP BY rid),
        f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length({drop(BLANKS)}) AS BIGINT) AS word_chars, CAST(length(t) - length({drop(SYMBOLS)}) AS BIGINT) AS n_symbols,
          CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, CAST(length({drop(BLANKS + SYMBOLS + OTHER)}) AS BIGINT) AS n_letters,
          CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(list_filter(ls, lambda x: regexp_matches(x, '[.!?:"]{ws}*$'))) AS BIGINT) AS n_closed FROM w LEFT JOIN cov USING (rid)),
        v AS MATERIALIZED (SELECT *, {votes} FROM f),
        pat AS MATERIALIZED (SELECT {', '.join(names)}, count(*) AS n FROM v WHERE NOT {FAILED} GROUP BY ALL),
        o0 AS MATERIALIZED (SELECT *, CAST({' + '.join(f'CASE {n} WHEN 1 THEN 1 WHEN -1 THEN -{BAD} ELSE 0 END' for n in names)} AS DOUBLE) AS o FROM pat)"""
    ]
    share = lambda a, b: f"least(0.99, greatest(0.01, ({a} + {RIGHT}) / ({b} + {RIGHT + WRONG})))"
    for k in range(1, ROUNDS + 1):
        good, bad = "n / (1 + exp(-o))", "n * (1 - 1 / (1 + exp(-o)))"
        sums = "".join(f", {share(f'sum(CASE WHEN {v} = 1 THEN {good} ELSE 0 END)', f'sum(CASE WHEN {v} <> 0 THEN {good} ELSE 0 END)')} AS g{j}, {share(f'sum(CASE WHEN {v} = -1 THEN {bad} ELSE 0 END)', f'sum(CASE WHEN {v} <> 0 THEN {bad} ELSE 0 END)')} AS b{j}" for j, v in enumerate(names))
        odds = "".join(f" + CASE {v} WHEN 1 THEN ln(g{j} / (1 - b{j})) WHEN -1 THEN ln((1 - g{j}) / b{j}) ELSE 0 END" for j, v in enumerate(names))
        parts.append(f"m{k} AS MATERIALIZED (SELECT least(0.99, greatest(0.01, sum({good}) / sum(n))) AS prior{sums} FROM o{k - 1})")
        parts.append(f"o{k} AS MATERIALIZED (SELECT pat.*, ln(prior / (1 - prior)){odds} AS o FROM pat, m{k})")
    on = " AND ".join(f"v.{n} = o.{n}" for n in names)
    return ", ".join(parts) + f" SELECT doc_id, {', '.join(COUNTS)}, {FAILED} AS base_failed, NOT {FAILED} AND coalesce(o.o, 0) >= 0 AS kept FROM v LEFT JOIN o{ROUNDS} o ON {on}"


def _quoted(c: str) -> str:
    return f"chr({ord(c)})"
