import re

import duckdb
import numpy as np
import pytest

from corpusloom.llm.oracles import url_sql
from corpusloom.llm.url_filter import DAMPING, THRESHOLD, host_links, host_scores, verdicts

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
URLS = [
    "http://A.Example.NET/en/1?x", "http://example.net", "http://example.net/", "https://badexample.net/en/1", "ftp://x.org/fr/#a", "http://x.org/FR/",
    "no scheme", None, "", "://only.com/de/", "http://www.example.com/de/a", "http://example.com/de", "http://u.example.com?q=/de/", "a://b://c/d",
    "http://hub.com/", "http://farm.org/",
]


def parts(url):
    match = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in match[1]) if match else ""
    return host, match[2] if match else ""


def rule_of(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def test_rules_match_brute_force(spark):
    rows = [(k, u, None, 0) for k, u in enumerate(URLS)]
    got = {r.page_id: r for r in verdicts(spark.createDataFrame(rows, "page_id long, url string, html string, rule int")).collect()}
    for k, url in enumerate(URLS):
        host, path = parts(url)
        rule, verdict = rule_of(host, path)
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule), url
        assert got[k].verdict == verdict or rule is None
    assert got[6].verdict == got[7].verdict == "allow"


def test_links_and_propagation(spark):
    html = '<a href="http://bad.net/x">1</a><a class=k href=//bad.net/y>2</a><A HREF="/own">3</A><a href="mailto:x@y.z">4</a><img src="http://i.com">'
    pages = spark.createDataFrame([
        (1, "http://farm.com/", html), (2, "http://bad.net/", None), (3, "http://good.org/fr/1", '<a href="http://ok.com/">'), (4, "http://ok.com/a", ""),
        (5, "http://farm.com/2", '<a href="http://bad.net/">'), (6, "http://alone.com/", ""),
    ], "page_id long, url string, html string")
    links = {(r.src, r.dst): r.n for r in host_links(pages).collect()}
    assert links == {("farm.com", "bad.net"): 3, ("farm.com", "farm.com"): 1, ("good.org", "ok.com"): 1}
    rows = {r.page_id: r for r in verdicts(pages, threshold=0.3).collect()}
    assert rows[1].verdict == rows[5].verdict == "block" and rows[4].verdict == rows[6].verdict == "allow"
    assert rows[4].favour > 0.3 and rows[1].suspicion > 0.3


def relative_mass(weights, seed):
    """Solved, not iterated: a host's own share, or the part of its received PageRank that comes from the seeds."""
    sums = weights.sum(1, keepdims=True)
    step = np.where(sums > 0, weights / np.where(sums > 0, sums, 1), 0).T
    walk = lambda from_: np.linalg.solve(np.eye(len(step)) - DAMPING * step, (1 - DAMPING) * from_)
    mass, whole = walk(seed), walk(np.ones(len(step)))
    got, of = mass - (1 - DAMPING) * seed, whole - (1 - DAMPING)
    return mass, np.maximum(seed, np.where(of > 1e-9, got / np.where(of > 1e-9, of, 1), 0))


def test_scores_match_solved_equations(spark):
    rng = np.random.default_rng(3)
    n = 12
    weights = np.where(rng.random((n, n)) < 0.25, rng.integers(1, 5, (n, n)), 0)
    weights[:, 0] = weights[1] = 0
    allowed, blocked = rng.random(n), np.where(rng.random(n) < 0.5, rng.random(n), 0)
    links = spark.createDataFrame([(f"h{i}", f"h{j}", int(w)) for (i, j), w in np.ndenumerate(weights) if w], "src string, dst string, n long")
    seeds = spark.createDataFrame([(f"h{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(allowed, blocked, strict=True))],
                                  "host string, allowed double, blocked double")
    got = {r.host: (r.trust, r.favour, r.distrust, r.suspicion) for r in host_scores(links, seeds, tolerance=1e-8).collect()}
    want = zip(*relative_mass(weights, allowed), *relative_mass(weights.T, blocked), strict=True)
    for i, row in enumerate(want):
        assert got[f"h{i}"] == pytest.approx(row, abs=1e-6)


def graph(farms):
    """Farms that share a blocked host, a hub with one bad link of ten, a chain, a named host, one that mostly links to itself."""
    to = lambda host, n=1: f'<a href="http://{host}/">x</a>' * n
    rows = [(f"http://farm{k}.com/", to("bad.net")) for k in range(farms)]
    rows += [
        ("http://bad.net/", '<a href="/own">x</a>' * 9 + to("news.com")), ("http://big.com/", to("bad.net", 100)), ("http://far.com/", to("big.com")),
        ("http://news.com/", to("fine.com", 9) + to("bad.net")), ("http://fine.com/", ""), ("http://good.org/fr/", to("named.com")),
        ("http://named.com/", to("bad.net")), ("http://inward.com/", '<a href="/own">x</a>' * 9 + to("bad.net")),
        ("http://worse.net/", ""), ("http://near.com/", to("worse.net")), ("http://next.com/", to("near.com")), ("http://last.com/", to("next.com")),
        ("http://open.com/", "<a " * 20_000 + to("bad.net")), ("none", None), (None, to("bad.net")),
    ]
    return [(k, *r) for k, r in enumerate(rows)]


@pytest.mark.parametrize("farms", [1, 10])
def test_farms_of_one_blocked_host_are_blocked_however_many(spark, farms):
    pages = spark.createDataFrame(graph(farms), "page_id long, url string, html string")
    got = {r.host: r.verdict for r in verdicts(pages).collect()}
    assert {got[f"farm{k}.com"] for k in range(farms)} == {"block"} == {got[h] for h in ("big.com", "bad.net", "near.com", "next.com", "open.com")}
    assert {got[h] for h in ("news.com", "fine.com", "named.com", "inward.com", "last.com", "")} == {"allow"}


def test_query_and_sql_decide_by_one_rule_across_hosts(spark):
    pages = spark.createDataFrame(graph(10), "page_id long, url string, html string")
    columns = ["page_id", "host", "path", "rule", "verdict", "favour", "suspicion"]
    got = sorted(tuple(r) for r in verdicts(pages).select(columns).collect())
    with duckdb.connect() as db:
        db.register("pages", pages.toPandas())
        want = sorted(db.execute(f"SELECT {', '.join(columns)} FROM ({url_sql(RULES, DAMPING, THRESHOLD)})").fetchall())
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], abs=2e-4)
    assert len({r[6] for r in got}) > 5


def test_empty_table(spark):
    assert verdicts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
