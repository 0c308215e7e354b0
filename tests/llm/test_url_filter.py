"""URL filters: rules, features and trees against plain versions."""

import itertools
import math
import random
import re
from collections import Counter

import pytest

from emberfold.llm import url_filter
from emberfold.llm.queries import op13_url_filter

RULES = dict(url_filter.RULES)


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(url):
    host, path = plain_parts(url)
    fits = [r for r in RULES for name, rest in [r.split("/", 1)] if (host == name or host.endswith("." + name)) and path.startswith("/" + rest)]
    return max(fits, key=len, default=None)


def plain_features(url):
    url = url or ""
    host, path = plain_parts(url)
    n = len(url)
    query = re.search(r"(?s)\?([^#]*)", url)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(url).values()) if n else 0.0
    ending, segment = re.search(r"\.([A-Za-z0-9]{1,8})$", path), re.search("^/([^/]*)/", path)
    out = {"length": n, "host_length": len(host), "labels": host.count(".") + 1 if host else 0, "hyphens": host.count("-"), "path_length": len(path), "depth": len(re.findall("/[^/]", path)), "digits": math.floor(len(re.findall("[0-9]", url)) * 100 / max(n, 1))}
    out |= {"entropy": bits, "params": len(re.findall("[^&;]+", query[1])) if query else 0, "secure": int(url.lower().startswith("https://"))}
    return out, {"label": host.split(".")[-1], "domain": ".".join(host.split(".")[-2:]), "ending": ending[1] if ending else "", "segment": segment[1] if segment else ""}


URLS = [
    "http://com/", "http://com", "https://WWW.Example.COM/en/1?a=b#c", "ftp://x.example.com/en/", "ftp://x.example.com/en", "http://a.net/es/", "http://net/fr/x", "http://xnet/fr/x", "http://a.net/ES/",
    "a://b://c.com/", "//x.com/", "http:///en/", "http://?x://y.com/", "http://h.com?q/en/", "http://h.com#/en/", "http://h.com/a\nb?x", "", None, "nothing", "http://ÄB.com/é?ü=1&b=2;c#z", "http://-a-.org/" + "x" * 20_000, "HTTPS://a.com/x/y//z.HTML", "http://www.example.com./en/",
    "http://evilexample.com/en/", "http://x.www.example.com/en/z", "http://example.com/en/", "://com/", "http://a.org:80/", "😀://😀.net/es/😀", "http://a.net/fr/?a&b&&c=d",
]


def some_urls(n=600, seed=4):
    rng = random.Random(seed)
    host = lambda: rng.choice(["", "www.", "m.", "cheap-pills.", "blog."]) + rng.choice(["example", "ab", "c-d-e"]) + rng.choice([".com", ".net", ".org"])
    return [f"{rng.choice(['http', 'https'])}://{host()}/{rng.choice(['en', 'es', 'fr'])}/{rng.randrange(10 ** rng.randrange(1, 6))}{rng.choice(['', '/', '.html', '?a=1&b=2', '#top'])}" for _ in range(n)] + URLS


@pytest.fixture(scope="module")
def pages(spark):
    urls = some_urls()
    urls += urls[:40]
    return spark.createDataFrame([(i if i % 50 else None, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "'mine' AS host", "7 AS _length", "1 AS blocked", "'x' AS score", "'r' AS rule", "3 AS w").repartition(3).cache()


def test_rules_and_parts(pages):
    got = url_filter.judge(pages, keep=("page_id", "url")).collect()
    assert len(got) == pages.count()
    for r in got:
        rule = plain_rule(r["url"])
        assert ((r["host"], r["path"]), r["rule"]) == (plain_parts(r["url"]), rule)
        assert r["verdict"] == (RULES[rule] if rule else "block" if r["score"] >= 0.5 else "allow")


def test_features(pages):
    rows = url_filter.lexical(pages, pages["url"]).collect()
    for r in rows:
        want, suffixes = plain_features(r["url"])
        assert {k: r[f"_{k}"] for k in want if k != "entropy"} == {k: v for k, v in want.items() if k != "entropy"}
        assert {k: r[f"_{k}"] for k in suffixes} == suffixes
        assert abs(r["_entropy"] / 16 - want["entropy"]) < 1 / 16 + 1e-9


def plain_boost(rows, trees, depth):
    """rows: (features, blocked); gradients row by row, splits by trying every edge. Returns the odds of any features."""
    ordered = {f: sorted(x[f] for x, _ in rows) for f in url_filter.FEATURES}
    edges = {}
    for f, v in ordered.items():
        at = [(len(v) - 1) * i / url_filter.BINS for i in range(url_filter.BINS + 1)]
        values = sorted({v[int(a)] + (a - int(a)) * (v[min(int(a) + 1, len(v) - 1)] - v[int(a)]) for a in at})
        edges[f] = sorted({math.floor((a + b) / 2) for a, b in itertools.pairwise(values)})
    k = sum(y for _, y in rows)
    even = [round(url_filter.EVEN * len(rows) / (2 * (k if y else len(rows) - k))) for _, y in rows]
    one = url_filter.ONE * url_filter.EVEN
    odds = [0.0] * len(rows)
    made = []

    def grow(members, level):
        g, h = sum(gs[i] for i in members), sum(hs[i] for i in members)
        worth = lambda a, b: a * a / (b + one)
        best, gain = None, one * 1e-3
        for f in url_filter.FEATURES if level < depth else ():
            for e in edges[f]:
                low = [i for i in members if rows[i][0][f] <= e]
                lg, lh = sum(gs[i] for i in low), sum(hs[i] for i in low)
                if 0 < lh < h and (now := worth(lg, lh) + worth(g - lg, h - lh) - worth(g, h)) > gain:
                    best, gain = (f, e), now
        if best is None:
            return url_filter.RATE * g / (h + one)
        f, e = best
        return f, e, grow([i for i in members if rows[i][0][f] <= e], level + 1), grow([i for i in members if rows[i][0][f] > e], level + 1)

    def value(tree, x):
        while isinstance(tree, tuple):
            tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
        return tree

    for _ in range(trees):
        ps = [1 / (1 + math.exp(-o)) for o in odds]
        gs = [e * (math.floor((y - p) * url_filter.ONE + 0.5) if y > p else -math.floor((p - y) * url_filter.ONE + 0.5)) for (_, y), p, e in zip(rows, ps, even, strict=True)]
        hs = [e * math.floor(p * (1 - p) * url_filter.ONE + 0.5) for p, e in zip(ps, even, strict=True)]
        made.append(grow(range(len(rows)), 0))
        odds = [o + value(made[-1], x) for o, (x, _) in zip(odds, rows, strict=True)]
    return lambda x: sum(value(t, x) for t in made)


def test_trees_against_row_by_row(spark, pages):
    """Shares and trees of a plain version, from the same whole-number features, give every page the same score."""
    known = {r["url"]: r["blocked"] for r in pages.select("url").collect() if (rule := plain_rule(r["url"])) for r in [{"url": r["url"], "blocked": int(RULES[rule] == "block")}]}
    bits = {r["url"]: r["_entropy"] for r in url_filter.lexical(pages, pages["url"]).collect()}
    features = {u: plain_features(u) for u in bits}
    n, k = len(known), sum(known.values())
    even = {1: round(url_filter.EVEN * n / (2 * k)), 0: round(url_filter.EVEN * n / (2 * (n - k)))}
    counts = {(s, v): [0, 0] for u in known for s, v in features[u][1].items()}
    for u, y in known.items():
        for s, v in features[u][1].items():
            counts[s, v][0] += even[y]
            counts[s, v][1] += y * even[y]
    half_up = lambda x: math.floor(x + 0.5)
    share = {k: half_up((y + url_filter.PRIOR * url_filter.EVEN // 2) / (n + url_filter.PRIOR * url_filter.EVEN) * url_filter.STEPS) for k, (n, y) in counts.items()}
    whole = lambda u: features[u][0] | {"entropy": bits[u]} | {f"{s}_share": share.get((s, v), url_filter.STEPS // 2) for s, v in features[u][1].items()}
    odds = plain_boost([(whole(u), y) for u, y in known.items()], url_filter.TREES, url_filter.DEPTH)
    for r in url_filter.judge(pages, keep=("url",)).collect():
        assert abs(r["score"] - 1 / (1 + math.exp(-odds(whole(r["url"]))))) < 1e-9


def test_learns_and_reruns(spark):
    """A kind of URL that no rule names is told apart by its digits and hyphens; the draw is bounded and the same each time."""
    rng = random.Random(2)
    bad = [f"http://{rng.choice('xyz')}-{rng.choice('pq')}-{i}.net/{rng.randrange(10**6)}?a=1&b={i}" for i in range(900)]
    good = [f"https://site{rng.choice('abcdef')}.net/about/{rng.choice(['team', 'news', 'help'])}/{chr(97 + i % 26)}" for i in range(900)]
    rows = [(u, 1) for u in bad[:600]] + [(u, 0) for u in good[:600]]
    model = url_filter.fit(spark.createDataFrame(rows * 2, "url string, blocked int"), sample=300)
    test = spark.createDataFrame([(u, 1) for u in bad[600:]] + [(u, 0) for u in good[600:]], "url string, truth int")
    got = url_filter.score(test, model, ("url", "truth")).collect()
    assert sum((r["score"] >= 0.5) == r["truth"] for r in got) / len(got) > 0.97
    again = url_filter.fit(spark.createDataFrame(rows * 2, "url string, blocked int").repartition(7), sample=300)
    assert again.trees == model.trees


def test_nothing_to_learn(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/"), (2, "http://b.net/es/1"), (3, None)], "page_id long, url string")
    assert {r["page_id"]: r["verdict"] for r in url_filter.judge(one).collect()} == {1: "block", 2: "block", 3: "block"}
    assert {r["verdict"] for r in url_filter.judge(one, rules=()).collect()} == {"allow"}
    one.write.parquet(f"{tmp_path}/pages.parquet")
    assert op13_url_filter(spark, str(tmp_path)).columns == ["page_id", "host", "path", "rule", "verdict"]
