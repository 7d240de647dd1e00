import numpy as np
import pytest
from pyspark.sql import functions as F
from tickforge.llm import url_filter as uf

SCHEMA = "page_id long, url string, html string, host string, rank double, src string"
LINK = "<a href=\"http://{}/x\">a</a>"
ROWS = [(1, "http://Good.example.net/en/1", LINK.format("friend.example.org")),
        (2, "https://friend.example.org/fr/2?x", LINK.format("CASINO.example.com") * 3),
        (3, "http://casino.example.com/de/1#a", None), (4, "http://lone.example.com", "<a href=/local>l</a>"),
        (5, None, LINK.format("casino.example.com")), (6, "no scheme", ""), (7, "http://net/", None),
        (8, "http://spam.net/en/", "<a href='//spam2.org/'>x</a>"), (None, "http://spam2.org/fr", None),
        (1, "http://Good.example.net/en/1", LINK.format("friend.example.org")),
        (9, "http://aexample.com/de/1", None), (10, "http://x.example.com/de", None), (11, "a://b://c/d", "")]


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path], default=len(path))
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    return low, path[:end]


def ruled(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in uf.RULES
           if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


@pytest.fixture(scope="module")
def judged(spark):
    pages = spark.createDataFrame([(*r, "h", 1.0, "s") for r in ROWS], SCHEMA).repartition(3)
    return uf.judge(pages, rounds=4).collect()


def test_hosts_paths_and_rules(judged):
    want = sorted(str((i, *plain(u), ruled(*plain(u))[0])) for i, u, _ in ROWS)
    assert sorted(str((r.page_id, r.host, r.path, r.rule)) for r in judged) == want
    for r in judged:
        if r.rule is not None:
            assert r.verdict == ruled(r.host, r.path)[1]


def test_distrust_reaches_hosts_that_link_to_blocked_ones(judged):
    by = {r.host: r for r in judged}
    assert by["friend.example.org"].distrust > 0 and by["friend.example.org"].trust > 0
    assert by[""].verdict == "allow" and by["casino.example.com"].distrust > 0.1


def test_propagation_equals_dense_iteration(spark):
    rng = np.random.default_rng(3)
    names = [f"h{i}" for i in range(12)]
    pairs = {(int(a), int(b)) for a, b in rng.integers(0, 12, (30, 2)) if a != b}
    edges = spark.createDataFrame([(names[a], names[b], float(a + b)) for a, b in pairs], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("h0",), ("h3",), ("h3",)], "host string")
    m = np.zeros((12, 12))
    for a, b in pairs:
        m[b, a] = a + b
    m = m / np.maximum(m.sum(axis=0), 1e-12)
    start = np.zeros(12)
    start[[0, 3]] = 1 - uf.DAMPING
    rank = start
    for _ in range(5):
        rank = uf.DAMPING * m @ rank + start
    got = {r.host: r["rank"] for r in uf.propagate(edges, seeds, rounds=5).collect()}
    assert all(abs(got.get(n, 0.0) - rank[i]) < 1e-9 for i, n in enumerate(names))


def test_empty_table(spark):
    assert uf.judge(spark.createDataFrame([], SCHEMA), rounds=1).count() == 0


def test_domain_edges(spark):
    hosts = spark.createDataFrame([("a.b.com",), ("",), ("com",)], "host string")
    got = {(r.src, r.dst) for r in uf.domain_edges(hosts).where(F.col("weight") == 1).collect()}
    assert got == {("a.b.com", "b.com"), ("b.com", "a.b.com")}


@pytest.mark.parametrize("linkers", [2, 30, 300])
def test_verdicts_do_not_depend_on_the_size_of_the_graph(spark, linkers):
    bad = LINK.format("best-casino.bad.info") + LINK.format("pills.info")  # neither has a page
    rows = [("http://farm.info/1", bad), ("http://sub.pills.info/1", ""),
            ("http://alphabets.info/1", LINK.format("fine.info")), ("http://fine.info/1", "")]
    rows += [(f"http://news{i}.info/1", bad + LINK.format("fine.info") * 18) for i in range(linkers)]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.host: r.verdict for r in uf.judge(pages).collect()}
    assert got.pop("farm.info") == got.pop("sub.pills.info") == "block"
    assert set(got.values()) == {"allow"} and len(got) == linkers + 2


def test_much_linked_blocked_seed_stays_blocked(spark):
    rows = [("http://casino.info/1", "")] + [(f"http://h{i}.info/1", LINK.format("casino.info")) for i in range(50)]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    assert {r.verdict for r in uf.judge(pages, rounds=4).collect()} == {"block"}


def test_path_belongs_to_the_first_host(spark):
    urls = ["http://a.net?u=http://b.com/x", "http://a.org#http://b.com/fr/1", "http://a.net", "http://a.net/?u=http://b.com/x"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in uf.judge(pages, rounds=1).collect()}
    assert got == {0: ("a.net", "", None), 1: ("a.org", "", None), 2: ("a.net", "", None), 3: ("a.net", "/", "net/")}


def test_inherited_distrust_equals_dense_iteration(spark):
    rng = np.random.default_rng(8)
    n, rounds = 14, 6
    links, domains = (np.where(rng.random((n, n)) < p, rng.integers(1, 5, (n, n)), 0).astype(float) for p in (0.2, 0.12))
    for m in (links, domains):
        np.fill_diagonal(m, 0)
    links[5] = 0  # a host without links, and one without domain edges
    domains[6] = 0
    rows = [(f"h{a}", f"h{b}", float(links[a, b]), float(domains[a, b])) for a in range(n) for b in range(n) if links[a, b] + domains[a, b]]
    seeds = [0, 3]
    want = np.zeros(n)
    want[seeds] = 1
    for _ in range(rounds):
        new = np.zeros(n)
        for a in range(n):
            if a in seeds:
                new[a] = 1
                continue
            parts = [(m[a] @ want / m[a].sum(), w) for m, w in ((links, 1 - uf.DOMAIN_SHARE), (domains, uf.DOMAIN_SHARE)) if m[a].sum()]
            total = sum(w for _, w in parts)
            new[a] = uf.DAMPING * sum(x * w for x, w in parts) / total if parts else 0
        want = new
    got = {r.host: r["rank"] for r in uf.inherit(
        spark.createDataFrame(rows, "src string, dst string, links double, domains double"),
        spark.createDataFrame([("h0",), ("h3",), ("h3",)], "host string"), rounds=rounds).collect()}
    assert all(abs(got.get(f"h{i}", 0.0) - want[i]) < 1e-9 for i in range(n))


def test_seed_tables(spark):
    rows = [("http://a.info/1", LINK.format("b.info")), ("http://b.info/1", ""), ("http://c.info/1", LINK.format("b.info") + LINK.format("d.info")),
            ("http://d.info/1", LINK.format("c.info"))]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(rows)], "page_id long, url string, html string")
    table = lambda *hosts: spark.createDataFrame([(h,) for h in hosts], "host string")
    verdicts = lambda **k: {r.host: r.verdict for r in uf.judge(pages, rounds=4, **k).collect()}
    assert set(verdicts().values()) == {"allow"}
    got = verdicts(blocked_hosts=table("b.info", "b.info", None), trusted_hosts=table("d.info"))
    assert got == {"a.info": "block", "b.info": "block", "c.info": "allow", "d.info": "allow"}
