"""Redirect equivalence against brute force and its SQL, on pages with links of all kinds."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lumenarc.llm import redirects as R

SF = "/root/testdata/sf0.001"
COLUMNS = ["page_id", "host", "path", "rule", "verdict"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[cut:].split("?")[0].split("#")[0]
    return rest[:cut].lower(), path


def rule_of(url, rules):
    host, path = parts(url)
    fit = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def brute(urls, edges, rules):
    """(rule, verdict) of each URL by union of addresses, which are those of plain lower-case URLs here."""
    node = lambda u: u.split("#")[0]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        up[find(node(a))] = find(node(b))
    told = {}
    for x in list(up):
        v = rule_of(x, rules)[1]
        if v:
            told.setdefault(find(x), set()).add(v)
    out = []
    for u in urls:
        rule, v = rule_of(u, rules)
        if v is None and u is not None and "://" in u:
            said = told.get(find(node(u)), set())
            v = "allow" if "allow" in said or not said else "block"
        out.append((rule, v or "allow"))
    return out


@pytest.fixture(scope="module")
def linked(spark):
    """400 pages whose links make chains, rings and a hub that a third of them names."""
    rng = random.Random(11)
    hosts = ["a.example.com", "www.example.com", "b.net", "www.b.net", "c.org", "d.org", "e.f.org", "net"]
    urls = [f"https://{rng.choice(hosts)}/{rng.choice(['en', 'es', 'fr', 'de'])}/{i}" for i in range(400)]
    hub = "https://c.org/xx/hub"
    pages, edges = [], []
    for i, u in enumerate(urls):
        kind = rng.random()
        to = hub if kind < 0.33 and "org/" in u else rng.choice(urls[max(0, i - 9) : i + 1])
        link = rng.choice(['<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">', '<LINK REL="canonical" HREF="{}">'])
        if kind < 0.7:
            edges.append((u, to))
            pages.append((i, u, f"<html><head>{link.format(to)}</head><body>text</body></html>"))
        else:
            pages.append((i, u + "#top", "<p>no links, but refresh and canonical <!-- " + link.format("https://b.net/es/1") + " --></p>" if kind < 0.8 else None))
    return spark.createDataFrame(pages, "page_id long, url string, html string"), pages, edges


def test_links_reach_aliases(spark, linked):
    d, pages, edges = linked
    got = {r.page_id: (r.rule, r.verdict) for r in R.judge(d, R.rule_table(spark, R.RULES), R.page_edges(d)).collect()}
    want = brute([p[1] for p in pages], edges, R.RULES)
    assert [got[i] for i in range(len(pages))] == want
    assert sum(r is None and v == "block" for r, v in want) > 10 and sum(r is None and v == "allow" for r, v in want) > 10


def test_query_and_its_sql(spark, linked, tmp_path):
    d, pages, _ = linked
    clean = d.withColumn("html", F.regexp_replace("html", "<!--.*?-->", ""))
    clean.write.parquet(str(tmp_path / "pages.parquet"))
    for source in (SF, str(tmp_path)):
        con = duckdb.connect()
        con.execute(f"create view pages as select * from read_parquet('{source}/pages.parquet{'' if source == SF else '/*.parquet'}')")
        res = con.execute(R.op11_sql())
        at = [[c[0] for c in res.description].index(c) for c in COLUMNS]
        want = sorted(tuple(r[i] for i in at) for r in res.fetchall())
        assert sorted(tuple(r[c] for c in COLUMNS) for r in R.op11_redirects(spark, source).collect()) == want and want
    table = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").collect()
    got = {r.page_id: r for r in R.op11_redirects(spark, SF).collect()}
    for r in table:
        assert (got[r.page_id].host, got[r.page_id].path, got[r.page_id].rule) == (*parts(r.url), rule_of(r.url, R.RULES)[0])


def test_redirect_log_long_chain_and_precedence(spark):
    """A chain of 60 redirects carries a block from its end; an allowed address in the middle of another frees its aliases, but not a blocked one."""
    chain = [(f"http://x.org/{i}", f"http://x.org/{i + 1}") for i in range(60)] + [("http://x.org/60", "http://b.net/es/1")]
    other = [("http://y.org/1", "http://shop.com/a"), ("http://shop.com/a", "http://b.net/fr/9"), ("http://y.org/2", "http://y.org/1")]
    urls = ["http://x.org/0", "HTTP://X.org:80/7#part", "http://y.org/2", "http://b.net/fr/9", "http://shop.com/a", "http://z.org/"]
    d = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict, r.alias) for r in R.judge(d, R.rule_table(spark, R.RULES), spark.createDataFrame([*chain, *other, (None, "http://z.org/"), ("http://z.org/", "nowhere")], "from_url string, to_url string")).collect()}
    assert got == {0: (None, "block", "http://b.net/es/1"), 1: (None, "block", "http://b.net/es/1"), 2: (None, "allow", "http://b.net/fr/9"), 3: ("net/fr/", "block", None), 4: ("com/", "allow", None), 5: (None, "allow", None)}


def test_targets_of_pages():
    page = "http://a.org/x/y?z"
    cases = {
        '<link rel="canonical" href="/k?a=1&amp;b=2">': ["http://a.org/k?a=1&b=2"], "<link rel='shortcut canonical' href='w'/>": ["http://a.org/x/w"], '<link rel=canonical href=//b.org/q>': ["http://b.org/q"],
        '<meta http-equiv="Refresh" content="5;URL=\'../up\'">': ["http://a.org/up"], '<meta http-equiv=refresh content="30">': [], '<base href="https://c.org/d/"><link rel="canonical" href="e">': ["https://c.org/d/e"],
        '<script>"<link rel=canonical href=/no>"</script><!-- <link rel=canonical href=/no> -->': [], '<link rel="canonical" href="">': [], '<link rel=canonical href="mailto:x@y.z">': [], '<link rel=canonical href="http://[bad">': [],
    }
    for markup, want in cases.items():
        assert R.targets(page, markup) == want, markup


def test_odd_pages(spark):
    urls = [(1, None), (2, ""), (3, "no scheme"), (4, "http://"), (5, "ftp://NET/es/x?y#z"), (6, "https://net/es"), (None, "https://net/es/"), (7, "a://b://c.com/d"), (7, "a://b://c.com/d"), (8, "http://www.Example.COM/en/\n1")]
    d = spark.createDataFrame([(i, u, "<link rel=canonical href=/q>" if i != 4 else None, "z", "z", 1) for i, u in urls], "page_id long, url string, html string, host string, rule string, own_host int")
    got = R.judge(d, R.rule_table(spark, R.RULES), R.page_edges(d))
    assert got.columns == ["page_id", "url", "html", "own_host", "host", "path", "rule", "verdict", "alias"]
    rows = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in got.collect()), key=str)
    want = sorted(((i or 0, *parts(u), *rule_of(u, R.RULES)) for i, u in urls), key=str)
    assert [(*r[:4], r[4] if r[3] else None) for r in rows] == want and len(rows) == len(urls)
    none = R.judge(d.limit(0), R.rule_table(spark, R.RULES), R.page_edges(d.limit(0)))
    assert none.count() == 0
    tie = spark.createDataFrame([("org", "/", "block"), ("org", "/", "allow"), (None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string")
    said = {r.page_id: r.verdict for r in R.judge(spark.createDataFrame([(1, "http://x.org/"), (2, "http://y.net")], "page_id long, url string"), tie, R.page_edges(d.limit(0))).collect()}
    assert said == {1: "allow", 2: "block"}
