"""Spelling variants: a self-join of the vocabulary's trie, with the sets of nodes at distance one carried down it.

Two words at distance one are equal up to some place ``j``; there one of them has another letter (replaced) or none
(inserted, deleted), and from there on they are equal again. In the trie, the node ``x`` of the first ``j`` letters and its
children form a set: with one edit at ``j``, each of them is at the place of each other. The set goes down the trie: by
every letter, its members step to their children by that letter, and stay together if two or more can. Words that end at
members of one set are at distance one. So an edit is spent once, and what is carried are sets, not pairs; a set has one
member for each letter at ``j`` (``R``, a letter is skipped there) and one for none (``I``, nothing is skipped).

The trie is cut into parts by prefixes, short where few words begin so and longer where many do; a task walks down the
parts below their prefixes. Edits inside a prefix lead from one part to another: such sets have spent their edit above the
parts, so that only equal rests can follow, and their words meet by an equi-join on place and rest.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.llm.common import ascii_lower, settle, small

RUN = r"[A-Za-z\x{00C0}-\x{00FF}]+"
#: Words that a part of the trie holds at most, as long as longer prefixes can divide it, and that a task walks at a time at least.
PART, CHUNK = 20_000, 20_000
FAR = np.iinfo(np.int64).max
NEAR = "word string, n_near long, form_n long, form string"


def vocabulary(docs: DataFrame, length: int = 5, count: int = 3, spoil: int | None = 97) -> DataFrame:
    """(word, n): the lower-cased words (A-Z only) of ``length`` code points or more that occur ``count`` times or more.

    With ``spoil``, occurrences lose a letter first, as a test of what is found: with h the crc32 of ``<doc_id>:<word>`` (a
    null id is written ``null``), where ``spoil`` divides h, code point h modulo the word's length goes. Null texts have no
    words; rows that repeat count again; an empty table gives an empty one.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run")).where(F.char_length("run") >= length)
    low = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(ascii_lower(F.col("run")))
    runs = runs.select("doc_id", low.alias("run"))
    if spoil:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), "run").cast("binary"))
        at = F.expr("cast(h % char_length(run) as int)")
        runs = runs.withColumn("h", h).withColumn("run", F.when(F.col("h") % spoil == 0, _without(F.col("run"), at)).otherwise(F.col("run"))).where(F.char_length("run") >= length)
    return runs.groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


def _without(word: Column, at: Column) -> Column:
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


class _Level:
    """The nodes of one depth: the word that ends at each (or -1), and where its children are among the nodes of the next depth."""

    def __init__(self, trie: Trie, depth: int, words: np.ndarray, node: np.ndarray, nodes: int) -> None:
        ends = trie.lens[words] == depth
        self.ends = np.full(nodes, -1, np.int64)
        self.ends[node[ends]] = words[ends]
        self.fresh = np.zeros(nodes, bool)
        self.fresh[node] = trie.cut[words] <= depth
        self.words, parent = words[~ends], node[~ends]
        letter = trie.points[trie.starts[self.words] + depth].astype(np.int64)
        new = np.ones(len(self.words), bool)
        new[1:] = (parent[1:] != parent[:-1]) | (letter[1:] != letter[:-1])
        self.node = np.cumsum(new) - 1
        self.letter, parents = letter[new], parent[new]
        self.count = np.bincount(parents, minlength=nodes)
        self.first = np.concatenate([[0], np.cumsum(self.count)])[:-1]

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each child of ``nodes``: the place in ``nodes`` it comes from, and its own number."""
        count = self.count[nodes]
        source = np.repeat(np.arange(len(nodes)), count)
        inner = np.arange(len(source)) - np.repeat(np.cumsum(count) - count, count)
        return source, self.first[nodes][source] + inner


class Trie:
    """The trie of sorted, distinct words; ``cut`` says at which depth the part of each word begins."""

    def __init__(self, words: list[str], n: np.ndarray, cut: np.ndarray) -> None:
        self.points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
        self.lens = np.fromiter(map(len, words), np.int64, len(words))
        self.starts = np.cumsum(self.lens) - self.lens
        self.cut = cut
        # of two words, the one of more occurrences, or else the smaller one, comes first
        self.order = np.lexsort((np.arange(len(words)), -n))
        self.rank = np.empty(len(words), np.int64)
        self.rank[self.order] = np.arange(len(words))

    def near(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each word, how many words of its part are at distance one with an edit below the part's prefix, and the rank of the first (FAR if none)."""
        every = len(self.lens)
        self.n_near, self.best = np.zeros(every, np.int64), np.full(every, FAR)
        upper = _Level(self, 0, np.arange(every), np.zeros(every, np.int64), 1)
        group, node, at = (np.zeros(0, np.int64) for _ in range(3))  # members R: set, node, letter at the edit
        plain, plain_at = np.zeros(0, np.int64), np.zeros(0, np.int64)  # member I of each set: node or -1, letter at the edit or 0
        depth = 0
        while len(upper.words):
            lower = _Level(self, depth + 1, upper.words, upper.node, len(upper.letter))
            # sets that begin here: a node and all its children
            begin = np.flatnonzero(upper.fresh & (upper.count > 0))
            source, child = upper.children(begin)
            group, node, at = np.concatenate([group, len(plain) + source]), np.concatenate([node, child]), np.concatenate([at, upper.letter[child]])
            plain, plain_at = np.concatenate([plain, begin]), np.concatenate([plain_at, np.zeros(len(begin), np.int64)])
            self._emit(upper, lower, group, node, at, plain, plain_at)
            # all step down by one letter
            source, child = lower.children(node)
            has = np.flatnonzero(plain >= 0)
            i_source, i_child = upper.children(plain[has])
            i_source, i_letter = has[i_source], upper.letter[i_child]
            keys = np.concatenate([group[source] << 32 | lower.letter[child], i_source << 32 | i_letter])
            _, key, members = np.unique(keys, return_inverse=True, return_counts=True)
            kept = members >= 2
            number = np.cumsum(kept) - 1
            r_key, i_key = key[: len(source)], key[len(source) :]
            stay, i_stay = kept[r_key], kept[i_key]
            group, node, at = number[r_key[stay]], child[stay], at[source[stay]]
            next_at = np.where(plain_at[i_source] == 0, i_letter, plain_at[i_source])
            plain, plain_at = np.full(int(kept.sum()), -1), np.zeros(int(kept.sum()), np.int64)
            plain[number[i_key[i_stay]]], plain_at[number[i_key[i_stay]]] = i_child[i_stay], next_at[i_stay]
            upper, depth = lower, depth + 1
        return self.n_near, self.best

    def _emit(self, upper: _Level, lower: _Level, group: np.ndarray, node: np.ndarray, at: np.ndarray, plain: np.ndarray, plain_at: np.ndarray) -> None:
        """Count the words that end at members of one set for each other."""
        end = lower.ends[node]
        live = end >= 0
        group, at, word = group[live], at[live], end[live]
        order = np.lexsort((self.rank[word], group))
        group, at, word = group[order], at[order], word[order]
        sets = len(plain)
        r = np.bincount(group, minlength=sets)
        lead = np.cumsum(r) - r
        first, second = np.full(sets, -1), np.full(sets, -1)
        first[r > 0], second[r > 1] = lead[r > 0], lead[r > 1] + 1
        ranked = lambda place: np.where(place >= 0, self.rank[word[place]] if len(word) else FAR, FAR)
        one, two = ranked(first), ranked(second)
        whole = np.where(plain >= 0, upper.ends[plain], -1)
        # members R: the others, and the whole word unless its letter at the edit is theirs (an edit further on says the same)
        other = np.where(np.arange(len(word)) == first[group], two[group], one[group])
        met = (whole[group] >= 0) & (plain_at[group] != at)
        rank_whole = np.where(whole >= 0, self.rank[whole], FAR)
        self._count(word, r[group] - 1 + met, np.minimum(other, np.where(met, rank_whole[group], FAR)))
        # the whole word: the members R but the one with its letter
        same = np.bincount(group[plain_at[group] == at], minlength=sets)
        lead_same = (first >= 0) & (at[first] == plain_at) if len(at) else np.zeros(sets, bool)
        live = whole >= 0
        self._count(whole[live], (r - same)[live], np.where(lead_same, two, one)[live])

    def _count(self, word: np.ndarray, n: np.ndarray, best: np.ndarray) -> None:
        np.add.at(self.n_near, word, n)
        some = n > 0
        np.minimum.at(self.best, word[some], best[some])


def near_in_parts(words: list[str], n: np.ndarray, cut: np.ndarray) -> pd.DataFrame:
    """(word, n_near, form_n, form) of the words, sorted and whole parts of the trie, that have a near word below their part's prefix."""
    trie = Trie(words, n, cut)
    n_near, best = trie.near()
    have = np.flatnonzero(n_near)
    form = trie.order[best[have]]
    named = lambda places: pd.Series([words[i] for i in places], dtype=object)
    return pd.DataFrame({"word": named(have), "n_near": n_near[have], "form_n": n[form], "form": named(form)})


def _walk(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows are sorted by word, so that those of one head stand together; heads are walked some at a time, each as a whole."""
    held: list[pd.DataFrame] = []
    rows = 0
    for frame in frames:
        held.append(frame)
        rows += len(frame)
        if rows >= CHUNK:
            now = pd.concat(held, ignore_index=True)
            last = np.flatnonzero((now["head"] != now["head"].iloc[-1]).to_numpy())
            stop = int(last[-1]) + 1 if len(last) else 0
            if stop:
                yield _walked(now.iloc[:stop])
            held, rows = [now.iloc[stop:]], len(now) - stop
    if rows:
        yield _walked(pd.concat(held, ignore_index=True))


def _walked(rows: pd.DataFrame) -> pd.DataFrame:
    return near_in_parts(rows["word"].tolist(), rows["n"].to_numpy(np.int64), rows["cut"].to_numpy(np.int64))


def parts(words: DataFrame, most: int = PART) -> DataFrame:
    """``words`` with ``cut``, the length of the prefix whose words form a part: the first of 0, 2, 3, 4, 6, 9, … with at most ``most`` words."""
    done, depth = None, 0
    while True:
        head = F.substring("word", 1, depth)
        big = settle(words.groupBy(head.alias("head")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("head"))
        last = big.isEmpty()
        here = words if last else words.withColumn("head", head).join(small(big), "head", "left_anti").drop("head")
        here = here.withColumn("cut", F.lit(depth))
        done = here if done is None else done.unionByName(here)
        if last:
            return settle(done)
        words = settle(words.withColumn("head", head).join(small(big), "head", "left_semi").drop("head"))
        depth = 2 if depth == 0 else depth + 1 if depth < 4 else depth * 3 // 2


def _across(words: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) by edits inside the prefixes of the parts; a group has one row for each letter, and one for none."""
    word, j = F.col("word"), F.col("j")
    places = words.where("cut > 0").select("word", "n", F.explode(F.sequence(F.lit(0), F.least("cut", F.char_length("word") + 1) - 1)).alias("j"))
    at = F.substring(word, j + 1, F.lit(1))
    skipped = F.when(j < F.char_length("word"), F.struct(_without(word, j).alias("rest"), F.lit(False).alias("whole")))
    both = F.array_compact(F.array(skipped, F.struct(word.alias("rest"), F.lit(True).alias("whole"))))
    rows = places.select("word", "n", "j", at.alias("at"), F.inline(both))
    member = F.struct((-F.col("n")).alias("o"), "word", "at", "whole")
    groups = rows.groupBy("j", "rest").agg(F.collect_list(member).alias("m")).where((F.size("m") > 1) & F.exists("m", lambda y: ~y["whole"]))
    x = F.col("x")
    others = F.filter("m", lambda y: (y["word"] != x["word"]) & ((y["whole"] == x["whole"]) | (y["at"] != x["at"])))
    each = groups.select("m", F.explode("m").alias("x")).select(x["word"].alias("word"), others.alias("others")).where(F.size("others") > 0)
    best = F.array_min(F.transform("others", lambda y: F.struct(y["o"].alias("o"), y["word"].alias("word"))))
    return each.select("word", F.size("others").cast("long").alias("n_near"), (-best["o"]).alias("form_n"), best["word"].alias("form"))


def near_words(words: DataFrame, most: int = PART) -> DataFrame:
    """(word, n_near, form_n, form) of the words of ``words`` (word, n) that others are at distance one of: how many, and the one of largest n
    (ties: the smallest in code-point order)."""
    cut = parts(words.select("word", "n"), most)
    head = F.substring("word", F.lit(1), F.col("cut")).alias("head")
    below = cut.select("word", "n", "cut", head).repartition("head").sortWithinPartitions("word").mapInPandas(_walk, NEAR)
    first = F.min(F.struct((-F.col("form_n")).alias("o"), "form"))
    both = below.unionByName(_across(cut)).groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("first"))
    return both.select("word", "n_near", (-F.col("first.o")).alias("form_n"), F.col("first.form").alias("form"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of the chain word, form, form's form ...; n doubles at each step, so that chains are short and end."""
    now = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        on = small(now.select(F.col("word").alias("root"), F.col("root").alias("next")))
        step = settle(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, length: int = 5, count: int = 3, spoil: int | None = 97, factor: int = 2, most: int = PART) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of ``vocabulary``.

    A word's form is its near word of largest n, if that is ``factor`` times the word's n or more; its root is the last form
    of the chain, or the word itself. Words without near words have n_near 0 and neither form nor form_n.
    """
    words = settle(vocabulary(docs, length, count, spoil))
    near = settle(near_words(words, most))
    known = words.join(near, "word", "left")
    is_form = F.col("form_n") >= factor * F.col("n")
    known = settle(known.select("word", F.when(is_form, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("form_n")).alias("form_n")))
    ends = small(roots(known.where("form is not null")))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """DuckDB SQL of the query's columns: crc32 by table, and near words by equal rests after one deletion."""
    poly = 0xEDB88320
    step = "CASE WHEN x % 2 = 1 THEN xor(x // 2, {p}) ELSE x // 2 END".format(p=poly)
    return f"""WITH RECURSIVE c(i, k, x) AS (SELECT i, 0, i FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT i, k + 1, {step} FROM c WHERE k < 8),
    tab AS MATERIALIZED (SELECT list(x ORDER BY i) AS t FROM c WHERE k = 8),
    r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS id, translate(unnest(regexp_extract_all(text, '{RUN}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
    g AS (SELECT id, w, count(*) AS n FROM r WHERE length(w) >= 5 GROUP BY id, w),
    b AS (SELECT w, n, flatten(list_transform(string_split(id || ':' || w, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)] ELSE [192 + unicode(s) // 64, 128 + unicode(s) % 64] END)) AS bytes FROM g),
    h AS (SELECT w, n, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(bytes AS BIGINT[])), lambda a, y: xor(a // 256, t[CAST(xor(a, y) % 256 AS INT) + 1]))) AS h FROM b, tab),
    s AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS INT)) || substr(w, CAST(h % length(w) AS INT) + 2) ELSE w END AS word, n FROM h),
    v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM s WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
    p AS (SELECT x.word, y.word AS near, y.n AS m FROM d x JOIN d y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
      UNION SELECT x.word, y.word, y.n FROM v x JOIN d y ON y.rest = x.word UNION SELECT y.word, x.word, x.n FROM v x JOIN d y ON y.rest = x.word),
    k AS (SELECT word, count(*) AS n_near, max(m) AS top, arg_min(near, (-m, near)) AS near FROM p GROUP BY word),
    f AS MATERIALIZED (SELECT v.word, CASE WHEN top >= 2 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * n THEN top END AS form_n FROM v LEFT JOIN k USING (word)),
    q(word, root) AS (SELECT word, word FROM f UNION ALL SELECT q.word, f.form FROM q JOIN f ON f.word = q.root WHERE f.form IS NOT NULL),
    e AS (SELECT q.word, q.root FROM q JOIN f ON f.word = q.root WHERE f.form IS NULL)
    SELECT f.word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS DOUBLE) AS form_n FROM f JOIN e USING (word)"""
