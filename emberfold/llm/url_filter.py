"""URL filters: rules for hosts and paths, and gradient-boosted trees on lexical features where no rule fits.

The URLs that a rule fits are the labelled ones. Of these, a bounded sample of different URLs becomes a table of binned
features; each level of a tree is one aggregation of gradients and curvatures by node, feature and bin, from which the
best splits follow. The trees are CASE expressions over the features, so that judging is a projection over all pages.

Both kinds weigh the same, however many URLs there are of each: what is unlike all that was labelled is not blocked for
the mere share of blocked labels. Gradients are summed as whole numbers: the order in which partial sums meet changes nothing, and reruns agree.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import pairwise
from math import floor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfold.llm.common import ascii_lower, settle, small

#: (host and path, verdict): a rule fits its host and all subdomains of it, where the path begins as the rule's does.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Different URLs that are learned from, of each verdict, about.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 12, 3, 16, 0.4, 1.0
#: Pseudo-counts behind the share of blocked URLs of a suffix, and the steps in which shares are written.
PRIOR, STEPS = 20, 1000
#: One is this much in sums of gradients, and a URL of a kind that half of them are weighs this much.
ONE, EVEN = 1 << 20, 1000
SUFFIXES = ("label", "domain", "ending", "segment")
FEATURES = ("length", "host_length", "labels", "hyphens", "path_length", "depth", "digits", "entropy", "params", "secure", *(f"{s}_share" for s in SUFFIXES))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#`` (A-Z lower-cased), and from there to ``?`` or ``#``; empty for null or without ``://``."""
    part = lambda i: F.coalesce(F.regexp_extract(url, PARTS, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """The longest rule that fits, or null."""

    def fits(rule: str) -> Column:
        name, slash, rest = rule.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)

    return F.coalesce(F.lit(None).cast("string"), *[F.when(fits(r), F.lit(r)) for r, _ in sorted(rules, key=lambda x: (-len(x[0]), x[0]))])


def verdict_of(rule: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    return reduce(lambda col, r: col.when(rule == r[0], F.lit(r[1])), rules[1:], F.when(rule == rules[0][0], F.lit(rules[0][1]))) if rules else F.lit(None).cast("string")


def entropy(text: Column) -> Column:
    """Bits a character of a text that is not null, by its own characters; 0 if it is empty."""
    nat = lambda n: F.when(n > 0, n * F.log(F.greatest(n, F.lit(1.0)))).otherwise(0.0)
    begin = F.struct(F.lit("").alias("c"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))

    def step(a: Column, c: Column) -> Column:
        same = a["c"] == c
        return F.struct(c.alias("c"), F.when(same, a["run"] + 1).otherwise(1.0).alias("run"), F.when(same, a["sum"]).otherwise(a["sum"] + nat(a["run"])).alias("sum"))

    n = F.char_length(text).cast("double")
    total = F.aggregate(F.array_sort(F.split(text, "")), begin, step, lambda a: a["sum"] + nat(a["run"]))
    return F.when(n > 0, (F.log(F.greatest(n, F.lit(1.0))) - total / n) / F.log(F.lit(2.0))).otherwise(0.0)


def lexical(pages: DataFrame, keep: Column) -> DataFrame:
    """``keep``, the whole-number features of each URL that need no statistics, and its suffixes."""
    text = F.coalesce("url", F.lit(""))
    host, path = host_and_path(F.col("url"))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    n = F.char_length(text)
    named = {
        "length": n,
        "host_length": F.char_length(host),
        "labels": F.when(host == "", 0).otherwise(F.regexp_count(host, F.lit(r"\.")) + 1),
        "hyphens": F.regexp_count(host, F.lit("-")),
        "path_length": F.char_length(path),
        "depth": F.regexp_count(path, F.lit("/[^/]")),
        "digits": F.floor(F.regexp_count(text, F.lit("[0-9]")) * 100 / F.greatest(n, F.lit(1))),
        "entropy": F.floor(entropy(text) * 16),
        "params": F.regexp_count(query, F.lit("[^&;]+")),
        "secure": F.lower(text).startswith("https://").cast("int"),
    }
    suffixes = {"label": F.substring_index(host, ".", -1), "domain": F.substring_index(host, ".", -2), "ending": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1), "segment": F.regexp_extract(path, "^/([^/]*)/", 1)}
    return pages.select(keep, *[c.cast("int").alias(f"_{k}") for k, c in named.items()], *[F.coalesce(c, F.lit("")).alias(f"_{k}") for k, c in suffixes.items()])


@dataclass
class Boosted:
    """Trees over FEATURES: a leaf is a number, a node is (feature, edge, what holds up to the edge, what holds above it)."""

    shares: DataFrame | None
    base: float
    trees: list


def _value(tree: object) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, edge, low, high = tree
    return F.when(F.col(f"_{f}") <= edge, _value(low)).otherwise(_value(high))


def _with_shares(rows: DataFrame, shares: DataFrame | None) -> DataFrame:
    """Adds the share of blocked URLs of each suffix, in STEPS; one that was never seen has a half."""
    unseen = F.lit(STEPS // 2)
    for s in SUFFIXES:
        if shares is None:
            rows = rows.withColumn(f"_{s}_share", unseen)
        else:
            own = shares.where(F.col("kind") == s).select(F.col("suffix").alias(f"_{s}"), F.col("share").alias(f"_{s}_share"))
            rows = rows.join(small(own), f"_{s}", "left").withColumn(f"_{s}_share", F.coalesce(f"_{s}_share", unseen))
    return rows


def fit(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> Boosted:
    """Learn from ``labelled`` (url, blocked 0 or 1): about ``sample`` different URLs of each kind, drawn by a hash of the URL.

    Null URLs are one URL without characters; a URL that repeats counts once (with both labels, once for each). Without
    rows there are no trees and nothing is blocked; with one kind only, all is as that kind.
    """
    url = F.coalesce(F.col("url"), F.lit(""))
    n0, n1 = labelled.agg(F.count_if(F.col("blocked") == 0), F.count_if(F.col("blocked") == 1)).first()
    if not n0 or not n1:
        return Boosted(None, 9.0 if n1 else -9.0, [])
    share = F.when(F.col("blocked") == 1, min(1.0, sample / n1)).otherwise(min(1.0, sample / n0))
    drawn = labelled.where(F.pmod(F.xxhash64(url), F.lit(1 << 20)) < share * (1 << 20)).select(url.alias("url"), F.col("blocked").cast("int").alias("blocked")).distinct()
    drawn = settle(lexical(drawn, F.col("blocked")))
    n, k = drawn.agg(F.count(F.lit(1)), F.sum("blocked")).first()
    if not 0 < (k or 0) < n:
        return Boosted(None, 9.0 if k else -9.0, [])
    even = F.when(F.col("blocked") == 1, round(EVEN * n / (2 * k))).otherwise(round(EVEN * n / (2 * (n - k))))
    each = drawn.select("blocked", F.explode(F.array(*[F.struct(F.lit(s).alias("kind"), F.col(f"_{s}").alias("suffix")) for s in SUFFIXES])).alias("s"))
    share = F.round((F.sum(F.col("blocked") * even) + PRIOR * EVEN // 2) / (F.sum(even) + PRIOR * EVEN) * STEPS).cast("int")
    shares = settle(each.groupBy("s.kind", "s.suffix").agg(share.alias("share")))

    rows = _with_shares(drawn, shares)
    values = [f"_{f}" for f in FEATURES]
    rows = settle(rows.groupBy("blocked", *values).agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.col("n") * even))
    cuts = [i / BINS for i in range(BINS + 1)]
    weighed = rows.agg(*[F.percentile(v, cuts, F.col("n")).alias(v) for v in values]).first()
    # a split says "up to the edge"; edges lie half way between neighbouring values, and are whole as the values are
    edges = {f: sorted({floor((a + b) / 2) for a, b in pairwise(sorted(set(weighed[f"_{f}"])))}) for f in FEATURES}
    bins = [F.array(*[F.lit(e) for e in edges[f]]).cast("array<int>") for f in FEATURES]
    place = lambda f, b: F.size(F.filter(b, lambda e: e < F.col(f"_{f}")))
    rows = rows.withColumn("_bins", F.array(*[place(f, b) for f, b in zip(FEATURES, bins, strict=True)]))

    made: list = []
    scored = settle(rows.withColumn("_f", F.lit(0.0)))
    for _ in range(trees):
        tree = _grow(scored, edges, depth)
        made.append(tree)
        scored = settle(scored.withColumn("_f", F.col("_f") + _value(tree)))
    return Boosted(shares, 0.0, made)


def _grow(scored: DataFrame, edges: dict[str, list[int]], depth: int) -> object:
    """One tree, level by level: a level is one aggregation by (node, feature, bin)."""
    p = 1 / (1 + F.exp(-F.col("_f")))
    g = F.round((F.col("blocked") - p) * ONE).cast("long") * F.col("w")
    h = F.round(p * (1 - p) * ONE).cast("long") * F.col("w")
    nodes: dict[int, list] = {1: []}  # open nodes, by the splits above: (feature, edge, whether above it)
    splits: dict[int, tuple[str, int]] = {}
    leaves: dict[int, float] = {}
    for level in range(depth + 1):
        if not nodes:
            break
        which = reduce(lambda col, x: col.when(_path(x[1]), x[0]), nodes.items(), F.when(F.lit(False), 0))
        told = scored.select(which.alias("node"), g.alias("g"), h.alias("h"), F.posexplode("_bins").alias("feature", "bin")).where("node is not null")
        table = told.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
        found: dict[int, dict[int, dict[int, tuple[int, int]]]] = {}
        for r in table:
            found.setdefault(r["node"], {}).setdefault(r["feature"], {})[r["bin"]] = (r["g"], r["h"])
        nodes_next: dict[int, list] = {}
        for node, above in nodes.items():
            split, value = best_split(found[node], edges) if node in found else (None, 0.0)
            if split is None or level == depth:
                leaves[node] = value
            else:
                splits[node] = split
                nodes_next[2 * node] = [*above, (*split, False)]
                nodes_next[2 * node + 1] = [*above, (*split, True)]
        nodes = nodes_next
    build = lambda node: (*splits[node], build(2 * node), build(2 * node + 1)) if node in splits else leaves.get(node, 0.0)
    return build(1)


def _path(above: list) -> Column:
    return reduce(lambda a, b: a & b, [(F.col(f"_{f}") > e) if up else (F.col(f"_{f}") <= e) for f, e, up in above], F.lit(True))


def best_split(bins: dict[int, dict[int, tuple[int, int]]], edges: dict[str, list[int]]) -> tuple[tuple[str, int] | None, float]:
    """The split of largest gain (ties: the first feature, the lowest edge), None if none gains, and the value of the node as a leaf.

    ``bins`` has (gradient, curvature) in units of ONE times EVEN by feature and bin.
    """
    some = next(iter(bins.values()))
    g, h = sum(x[0] for x in some.values()), sum(x[1] for x in some.values())
    ridge = RIDGE * ONE * EVEN
    worth = lambda a, b: a * a / (b + ridge)
    best, gain = None, ONE * EVEN * 1e-3
    for i, f in enumerate(FEATURES):
        left_g = left_h = 0
        for b, edge in enumerate(edges[f]):
            x = bins[i].get(b, (0, 0))
            left_g, left_h = left_g + x[0], left_h + x[1]
            if 0 < left_h < h and (now := worth(left_g, left_h) + worth(g - left_g, h - left_h) - worth(g, h)) > gain:
                best, gain = (f, edge), now
    return best, RATE * g / (h + ridge)


def score(pages: DataFrame, model: Boosted, keep: tuple[str | Column, ...]) -> DataFrame:
    """``keep`` and score (0 to 1, higher: blocked likelier) of each row of ``pages``, by its URL alone."""
    rows = _with_shares(lexical(pages, F.struct(*keep).alias("_keep")), model.shares)
    odds = reduce(lambda a, b: a + b, map(_value, model.trees), F.lit(model.base))
    return rows.select("_keep.*", (1 / (1 + F.exp(-odds))).alias("score"))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, keep: tuple[str, ...] = ("page_id",), sample: int = SAMPLE, least: float = 0.5) -> DataFrame:
    """``keep``, host, path, rule (null if none fits), verdict (allow or block) and score for each row of ``pages``.

    The longest rule that fits decides; where none does, the trees do, which are learned from the URLs of ``pages`` that a
    rule fits. A null URL, or one without ``://``, has neither host nor path and is judged by the trees. Rows that repeat
    each have their own result, columns beside ``keep`` and url change nothing, an empty table gives an empty table.
    """
    host, path = host_and_path(F.col("url"))
    rule = rule_of(host, path, rules)
    labelled = pages.select("url", rule.alias("rule")).where("rule is not null")
    model = fit(labelled.select("url", (verdict_of(F.col("rule"), rules) == "block").cast("int").alias("blocked")), sample)
    out = score(pages, model, (*keep, host.alias("host"), path.alias("path"), rule.alias("rule")))
    method = F.when(F.col("score") >= least, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*keep, "host", "path", "rule", F.coalesce(verdict_of(F.col("rule"), rules), method).alias("verdict"), "score")
