"""URL filters: block and allow rules, and block decisions carried over redirects and canonical links."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.components import connected_components
from barloom.llm.shared import materialize, read, row_place

#: Rules up to this many go into the plan as a literal; longer lists are joined by host.
LITERAL_RULES = 1_000
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def lower(column):
    """A-Z lower-cased, nothing else."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url):
    return lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url):
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def without_dots(path):
    """A path with its ``.`` and ``..`` segments resolved."""
    parts = F.split(path, "/")
    none = F.array().cast("array<string>")
    kept = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), none, lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    ended = F.concat(kept, F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(none))
    return F.when(F.regexp_like(path, F.lit(r"(^|/)\.\.?(/|$)")), F.concat(F.lit("/"), F.array_join(ended, "/"))).otherwise(path)


def node_of(url):
    """The resource a URL names: without its fragment, scheme and host lower-cased, dots in its path resolved; null without ``://``."""
    head = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*", 0)
    path, query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(\?[^#]*)", 1)
    return F.when(head != "", F.concat(lower(head), without_dots(path), query))


def resolved(base, target):
    """An absolute URL from a link found on a page."""
    target = F.replace(F.trim(target), F.lit("&amp;"), F.lit("&"))
    scheme, root = F.regexp_extract(base, r"(?s)^(.*?:)//", 1), F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    folder, own = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*(/(?:[^?#]*/)?)", 1), F.regexp_extract(base, r"(?s)^.*?://[^/?#]*[^?#]*", 0)
    return (
        F.when(target.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("/"), F.concat(root, target))
        .when(target.startswith("?"), F.concat(own, target))
        .when(target.startswith("#"), base)
        .otherwise(F.concat(root, F.when(folder == "", F.lit("/")).otherwise(folder), target))
    )


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``a, b``: nodes of a page and of what it names as canonical or redirects to (meta refresh)."""
    tags = F.regexp_extract_all(F.col("_html"), F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    found = pages.filter(F.col(html).rlike("(?i)canonical|http-equiv")).select(F.col(url).alias("_url"), F.col(html).alias("_html")).select("_url", F.explode(tags).alias("tag"))
    href = F.regexp_extract("tag", r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = F.regexp_extract("tag", r"""(?is)\bcontent\s*=\s*["'][^"'>]*?url\s*=\s*'?([^"'\s>]+)""", 1)
    target = F.when(F.col("tag").rlike(r"""(?is)^<link\b.*\brel\s*=\s*["']?[^"'>]*\bcanonical\b"""), href).when(F.col("tag").rlike(r"""(?is)^<meta\b.*\bhttp-equiv\s*=\s*["']?refresh\b"""), refresh)
    edges = found.withColumn("target", target).filter("target <> ''")
    return edges.select(node_of(F.col("_url")).alias("a"), node_of(resolved(F.col("_url"), F.col("target"))).alias("b")).filter("a is not null and b is not null and a <> b").distinct()


def with_rules(urls: DataFrame, rules: DataFrame, row: str) -> DataFrame:
    """Add ``rule`` and ``decision`` of the longest rule that fits, to rows with ``host, path`` told apart by ``row``.

    ``rules`` has ``host, path, verdict``. A rule fits its host and all subdomains if the path
    starts with the rule's. Of the same rule in both lists, allow goes first.
    """
    listed = rules.limit(LITERAL_RULES + 1).collect()
    if len(listed) <= LITERAL_RULES:
        chain = decision = F.lit(None).cast("string")
        for r in sorted(listed, key=lambda r: (len(r["host"] + r["path"]), r["verdict"] == "allow", r["host"])):
            fits = ((F.col("host") == r["host"]) | F.endswith("host", F.lit(f".{r['host']}"))) & F.startswith("path", F.lit(r["path"]))
            chain, decision = F.when(fits, r["host"] + r["path"]).otherwise(chain), F.when(fits, r["verdict"]).otherwise(decision)
        return urls.withColumns({"rule": chain, "decision": decision})
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    hits = urls.select(row, "path", F.explode(suffixes).alias("suffix")).join(named, (F.col("suffix") == F.col("r_host")) & F.startswith("path", "r_path"))
    best = hits.groupBy(F.col(row).alias("_hit")).agg(F.max(F.struct(F.length(F.concat("r_host", "r_path")), (F.col("r_verdict") == "allow").alias("allow"), F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict"))).alias("best"))
    return urls.join(best, F.col(row) == F.col("_hit"), "left").withColumns({"rule": F.col("best.rule"), "decision": F.col("best.verdict")}).drop("best", "_hit")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", html: str = "html", key: str = "page_id", redirects: DataFrame | None = None) -> DataFrame:
    """One row per page: ``_key, host, path, rule, verdict, component``.

    The longest rule decides. A page without one is blocked if any URL of its component, linked by
    canonical links, refreshes or rows ``source, target`` of ``redirects``, is blocked by a rule; an
    allow rule holds for its own URL only and stops nothing else. All other pages are allowed, as are
    null URLs and URLs without ``://``. Only URLs with a link enter the components; an empty table
    gives no rows, repeated rows are judged alike.
    """
    base = pages.select(F.col(key).alias("_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), node_of(F.col(url)).alias("node"))
    judged = with_rules(base.withColumn("_row", row_place(pages)), rules, "_row")
    edges = link_edges(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node_of(F.col("source")).alias("a"), node_of(resolved(F.col("source"), F.col("target"))).alias("b")))
    groups = materialize(connected_components(edges, "a", "b").select(F.col("node").alias("member"), "component"), "components")
    hosts = groups.select("component", "member", host_of(F.col("member")).alias("host"), path_of(F.col("member")).alias("path"))
    bad = with_rules(hosts, rules, "member").filter("decision = 'block'").select(F.col("component").alias("bad")).distinct()
    marked = groups.join(bad, F.col("component") == F.col("bad"), "left").select("member", "component", F.col("bad").isNotNull().alias("blocked"))
    out = judged.join(marked, F.col("node") == F.col("member"), "left")
    verdict = F.coalesce("decision", F.when(F.col("blocked"), "block").otherwise("allow"))
    return out.select("_key", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("component", "node").alias("component"))


def default_rules(spark: SparkSession) -> DataFrame:
    rows = [(r[: r.index("/")], r[r.index("/") :], v) for r, v in RULES]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"), default_rules(spark)).select(F.col("_key").alias("page_id"), "host", "path", "rule", "verdict")


def redirected_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages judged with redirects: each page of an id divisible by 4 leads to the next one, and that to the one after it."""
    pages = read(spark, sf_dir, "pages")
    after = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("target"))
    redirects = pages.filter("page_id % 4 < 2").join(after, "page_id").select(F.col("url").alias("source"), "target")
    return judge(pages, default_rules(spark), redirects=redirects).select(F.col("_key").alias("page_id"), "rule", "verdict")


#: No page of the driver's tables has a canonical link or a refresh, so there the rules alone decide.
ORACLE = r"""
WITH p AS (SELECT page_id, lower(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), '')) AS host,
                  coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
r AS (SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
REDIRECT_ORACLE = r"""
WITH RECURSIVE p AS (SELECT page_id, lower(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's')) AS host, regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path,
    lower(regexp_extract(url, '^.*?://[^/?#]*', 0, 's')) || regexp_extract(url, '^.*?://[^/?#]*([^#]*)', 1, 's') AS node FROM pages),
r AS (SELECT *, CASE
        WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM p),
one AS (SELECT a.node AS u, b.node AS v FROM p a JOIN p b ON b.page_id = a.page_id + 1 WHERE a.page_id % 4 < 2),
e AS (SELECT u, v FROM one UNION SELECT v, u FROM one),
bad AS (SELECT DISTINCT node FROM r WHERE rule IN ('net/', 'example.com/de/')),
reach AS (SELECT node FROM bad UNION SELECT e.v FROM reach JOIN e ON e.u = reach.node)
SELECT page_id, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN node IN (SELECT node FROM reach) THEN 'block' ELSE 'allow' END AS verdict FROM r
"""
