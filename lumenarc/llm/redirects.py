"""URL filters by redirect equivalence.

An address is a URL as a server sees it: without fragment, scheme and host in lower case, no default port. Redirects (rows of a log, or
meta refresh in a page) and canonical links tie addresses together; the connected components of these edges, found by distributed large-star and
small-star steps, are classes of aliases. Each address is judged by the longest rule that fits it, in two equality joins: its host and
what it is a subdomain of, against the rules' hosts, then the rules' paths. A component takes over what the rules say of its addresses: an
address without a rule is blocked if an alias is blocked and none is allowed. An explicit allow so has precedence twice: an allowed
address is never blocked by its aliases, and its aliases without a rule are allowed with it.

Defined results: a null URL or one without :// has empty host and path, no rule, no alias, and is allowed; repeated URLs are judged alike; links
that can't be resolved, or lead to no http or https address, tie nothing; edges with a null end are left out; rules with a null host or verdict are left
out, a null path is an empty one; of rules that are the same but for the verdict allow wins; null html has no links; an empty table gives
no rows.
"""

from __future__ import annotations

import html as entities
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import small_batches, stash, table, unused
from .components import components

#: The rules of the query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def host_of(url: Column) -> Column:
    """From the first :// to the first /, ? or #, A to Z in lower case; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to the first ? or #."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """The URL without fragment, with scheme and host in lower case and without user or default port; null if it has no ://."""
    scheme = F.lower(F.regexp_extract(url, r"^((?s:.*?))://", 1))
    host = F.regexp_replace(host_of(url), r"^[^@]*@", "")
    port = F.when(scheme == "http", F.regexp_replace(host, r":(80)?$", "")).when(scheme == "https", F.regexp_replace(host, r":(443)?$", "")).otherwise(host)
    path, query = path_of(url), F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*[^?#]*(\?[^#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.concat(scheme, F.lit("://"), port, F.when(path == "", F.lit("/")).otherwise(path), query))


class _Links(HTMLParser):
    """Targets of canonical links and of refreshes that go elsewhere; what stands in scripts, styles or comments is none."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.base, self.found = "", []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {k: v or "" for k, v in reversed(attrs)}
        if tag == "base" and not self.base:
            self.base = a.get("href", "")
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.found.append(a.get("href", ""))
        elif tag == "meta" and a.get("http-equiv", "").strip().lower() == "refresh":
            _, _, rest = a.get("content", "").replace(",", ";", 1).partition(";")
            name, sign, target = rest.strip().partition("=")
            if sign and name.strip().lower() == "url":
                self.found.append(target.strip().strip("'\""))

    handle_startendtag = handle_starttag


def targets(url: str, markup: str) -> list[str]:
    """Absolute URLs that a page names as itself."""
    parser, out = _Links(), []
    parser.feed(markup)
    parser.close()
    for href in parser.found:
        try:
            target = urljoin(urljoin(url, entities.unescape(parser.base).strip()), href.strip())
        except ValueError:
            continue
        if href.strip() and target.lower().startswith(("http://", "https://")):
            out.append(target)
    return out


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """from_url and to_url of the canonical links and refreshes of pages. Only pages that hold one of the two words reach the parser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(u, t) for u, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for t in targets(u, m)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["from_url", "to_url"])

    small_batches(pages.sparkSession)
    held = pages.select(F.col(f"`{url}`").cast("string").alias("u"), F.col(f"`{html}`").cast("string").alias("m"))
    return held.filter(F.col("u").contains("://") & F.col("m").rlike("(?i)canonical|refresh")).mapInArrow(run, "from_url string, to_url string")


def aliases(edges: DataFrame) -> DataFrame:
    """node and root of every address of an edge: the smallest address of its component. edges: from_url, to_url."""
    both = edges.select(address(F.col("from_url")).alias("a"), address(F.col("to_url")).alias("b"))
    return components(both.filter("a is not null and b is not null"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict")) for h, p, v in rules))))


def by_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """rule and verdict of each (host, path) that a rule fits: the longest of rules, then of hosts. places: distinct host, path; rules: host, path, verdict."""
    own = rules.filter("host is not null and verdict in ('allow', 'block')").select(F.lower("host").alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict").alias("told"))
    # A rule fits the host itself and what ends in a dot and the host: one row for each such ending, a handful a host.
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))
    rank = F.struct(F.length(F.concat("rule_host", "rule_path")).alias("length"), F.length("rule_host").alias("of_host"), (F.col("told") == "allow").alias("allows"))
    fits = places.select("host", "path", F.explode(endings).alias("rule_host")).join(own, "rule_host").filter(F.startswith("path", "rule_path"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("told").alias("verdict")), rank).alias("best"))
    return best.select("host", "path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, edges: DataFrame, url: str = "url") -> DataFrame:
    """All columns of pages and host, path, rule, verdict and alias (the address whose class decided, null where a rule or nothing did); columns of these names are replaced. edges: from_url, to_url."""
    host, path, rule, verdict, alias, node, by_class = unused(pages, "own_host", "own_path", "own_rule", "own_verdict", "own_alias", "own_node", "class_verdict")
    link = F.col(f"`{url}`").cast("string")
    parts = lambda x: [host_of(x).alias("host"), path_of(x).alias("path")]
    ties = aliases(edges)
    tied = stash(ties.select("node", "root", *parts(F.col("node"))), "aliases")
    places = pages.select(*parts(link)).unionByName(tied.select("host", "path")).filter("host <> ''").distinct()
    told = stash(by_rules(places, rules), "told")
    # What the rules say of the addresses of each component; those that are silent on all of it decide nothing.
    classes = tied.join(told, ["host", "path"]).groupBy("root").agg(F.bool_or(F.col("verdict") == "allow").alias("allows"))
    over = stash(tied.join(classes, "root").select(F.col("node").alias(node), F.col("root").alias(alias), F.when(F.col("allows"), F.lit("allow")).otherwise(F.lit("block")).alias(by_class)), "classes")
    named = told.select(F.col("host").alias(host), F.col("path").alias(path), F.col("rule").alias(rule), F.col("verdict").alias(verdict))
    held = pages.select("*", host_of(link).alias(host), path_of(link).alias(path), address(link).alias(node))
    # Pages without a host have no rule and no alias: they stay out of the joins, where they would be one hot key.
    none = F.lit(None).cast("string")
    without = held.filter(F.col(host) == "").select("*", none.alias(rule), none.alias(verdict), none.alias(alias), none.alias(by_class))
    joined = held.filter(F.col(host) != "").join(named, [host, path], "left").join(over, node, "left")
    every = joined.unionByName(without)
    last = {"host": F.col(host), "path": F.col(path), "rule": F.col(rule), "verdict": F.coalesce(verdict, by_class, F.lit("allow")), "alias": F.when(F.col(verdict).isNull(), F.col(alias))}
    taken = {c.lower() for c in last}
    return every.select(*(F.col(f"`{c}`") for c in pages.columns if c.lower() not in taken), *(v.alias(k) for k, v in last.items()))


def op11_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages.select("page_id", "url"), rule_table(spark, RULES), page_edges(pages)).select("page_id", "host", "path", "rule", "verdict")


def op11_sql() -> str:
    """The same for links that are absolute or begin with a slash."""
    rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
    node = lambda u: f"case when {u} like '%://%' then regexp_replace(lower(regexp_extract({u}, '^[^:]*://[^/?#]*')), ':(80|443)?$', '') || coalesce(nullif(regexp_extract({u}, '://[^/?#]*([^?#]*)', 1), ''), '/') || regexp_extract({u}, '^[^?#]*(\\?[^#]*)', 1) end"
    parts = lambda u: f"translate(regexp_extract({u}, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract({u}, '://[^/?#]*([^?#]*)', 1) as path"
    return f"""
with recursive rules(rule_host, rule_path, told) as (values {rules}),
tags as (
  select url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)[^>]*(?:canonical|refresh)[^>]*>')) as tag from pages where url like '%://%'),
hrefs as (
  select url, trim(regexp_extract(tag, '(?i)(?:href="|content="[^"]*url=)([^"]*)"', 1)) as href from tags),
links as (
  select url, case when regexp_matches(href, '(?i)^https?://') then href when href like '//%' then regexp_extract(url, '^[^:]*:') || href when href like '/%' then regexp_extract(url, '^[^:]*://[^/?#]*') || href end as target
  from hrefs),
edges as (select {node('url')} as a, {node('target')} as b from links where target is not null),
ties as (select a, b from edges union select b, a from edges),
reach(node, seen) as (select a, a from ties union select r.node, b.b from reach r join ties b on b.a = r.seen),
roots as (select node, min(seen) as root from reach group by node),
addresses as (select node, root, {parts('node')} from roots),
places as (select {parts('url')} from pages union select host, path from addresses),
fits as (
  select p.host, p.path, rule_host || rule_path as rule, told, row_number() over (partition by p.host, p.path order by length(rule_host || rule_path) desc) as nth
  from places p join rules on (p.host = rule_host or ends_with(p.host, '.' || rule_host)) and starts_with(p.path, rule_path) where p.host <> ''),
classes as (select a.root, bool_or(f.told = 'allow') as allows from addresses a join fits f on f.host = a.host and f.path = a.path and nth = 1 group by a.root),
split as (select page_id, {node('url')} as node, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') as path from pages)
select s.page_id, s.host, s.path, f.rule, coalesce(f.told, case when c.allows then 'allow' when not c.allows then 'block' end, 'allow') as verdict
from split s left join fits f on f.host = s.host and f.path = s.path and nth = 1 left join roots r on r.node = s.node left join classes c on c.root = r.root
"""
