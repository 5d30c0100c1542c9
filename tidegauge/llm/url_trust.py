"""URL filter: host rules, and trust propagated over the link graph for hosts that no rule covers.

A rule (action, host, path) fits its host and all subdomains where the url's path starts with the rule's; the longest rule
wins, of equal ones the one with the longer host. Links with a host (``//host/`` too) give edges between hosts, one per ordered pair, with
the number of links as weight. A host whose pages are allowed more often than blocked is a trusted seed, in the opposite case
a blocked seed, with the difference as weight. Trust is the personalised PageRank of trusted seeds along links; distrust that
of blocked seeds against the links: who links to blocked hosts is distrusted. A host is blocked when distrust / (trust +
distrust) exceeds ``threshold``; hosts that neither reaches are allowed.

Mass that reaches a host without onward links ends there; returning it to the seeds would only scale all ranks. NULL urls and
urls without ``://`` have an empty host and path and are judged like any host; NULL pages have no links; links of a host to itself
are ignored; repeated rows count each time; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.decontamination import LOWER, UPPER
from tidegauge.session import stored

Rule = tuple[str, str, str]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"(?i)href\s*=\s*[\"']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matched(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The winning rule of columns ``host`` and ``path``, as text, and its action."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, action = F.when(fits, host + path).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def parsed(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    url = F.col("url").cast("string")
    places = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    name, action = matched(rules)
    return places.select("*", name.alias("rule"), action.alias("action"))


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    links = pages.select(host_of(F.col("url").cast("string")).alias("src"), F.explode(
        F.regexp_extract_all(F.col("html").cast("string"), F.lit(_LINK), F.lit(1))).alias("dst"))
    ends = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return ends.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def seeds(places: DataFrame) -> DataFrame:
    """(kind, host, weight): kind t for trusted hosts, d for blocked ones; weights of a kind sum to 1."""
    lean = F.sum(F.when(F.col("action") == "allow", 1).when(F.col("action") == "block", -1).otherwise(0))
    hosts = places.groupBy("host").agg(lean.alias("lean")).where("lean <> 0")
    marked = hosts.select(F.when(F.col("lean") > 0, "t").otherwise("d").alias("kind"), "host", F.abs("lean").alias("lean"))
    total = marked.groupBy("kind").agg(F.sum("lean").alias("total"))  # two rows
    return marked.join(F.broadcast(total), "kind").select("kind", "host", (F.col("lean") / F.col("total")).alias("weight"))


def propagate(edges: DataFrame, start: DataFrame, damping: float = 0.85, rounds: int = 30, stride: int = 5, tolerance: float = 1e-7) -> DataFrame:
    """(kind, host, rank) after ``rounds`` steps, or fewer once ranks move less than ``tolerance`` in a stride.

    The edge table holds a link once per direction of flow, so one join and one pre-aggregated group make a step of both.
    """
    flow = edges.select(F.lit("t").alias("kind"), F.col("src").alias("from"), F.col("dst").alias("to"), "n").unionByName(
        edges.select(F.lit("d").alias("kind"), F.col("dst").alias("from"), F.col("src").alias("to"), "n"))
    total = flow.groupBy("kind", "from").agg(F.sum("n").alias("out"))
    flow = stored(flow.join(total, ["kind", "from"]).select("kind", "from", "to", (F.col("n") / F.col("out")).alias("p")), "host-flow")
    base = start.select("kind", "host", (F.col("weight") * (1 - damping)).alias("rank"))
    rank = base
    if flow.isEmpty():
        return rank
    for turn in range(1, rounds + 1):
        sent = rank.withColumnRenamed("host", "from").join(flow, ["kind", "from"])
        moved = sent.select("kind", F.col("to").alias("host"), (F.col("rank") * F.col("p") * damping).alias("rank"))
        new = moved.unionByName(base).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if turn % stride == 0:
            new = stored(new, f"ranks-{turn}")
            if turn > stride:
                old = last.withColumnRenamed("rank", "old")
                change = new.join(old, ["kind", "host"], "full").agg(F.sum(F.abs(F.coalesce("rank", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
                if (change or 0.0) < tolerance:
                    return new
            last = new
        rank = new
    return rank


def host_verdicts(pages: DataFrame, places: DataFrame, threshold: float = 0.5, damping: float = 0.85, rounds: int = 30) -> DataFrame:
    """(host, trust, distrust, blocked) of every host that trust or distrust reaches."""
    start = stored(seeds(places), "host-seeds")
    ranks = propagate(stored(host_edges(pages), "host-edges"), start, damping, rounds)
    both = ranks.groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "t", F.col("rank")).otherwise(0.0)).alias("trust"),
        F.sum(F.when(F.col("kind") == "d", F.col("rank")).otherwise(0.0)).alias("distrust"))
    return both.withColumn("blocked", F.col("distrust") > threshold * (F.col("trust") + F.col("distrust")))


def judge(pages: DataFrame, rules: Sequence[Rule], threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule and verdict of every page."""
    places = parsed(pages.select("page_id", "url"), rules)
    hosts = host_verdicts(pages.select("url", "html"), places, threshold)
    own = F.when(F.coalesce("blocked", F.lit(False)), "block").otherwise("allow")
    return places.join(hosts, "host", "left").select(
        F.col("page_id").cast("bigint"), "host", "path", "rule", F.coalesce("action", own).alias("verdict"))


RULES: tuple[Rule, ...] = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"),
    ("block", "net", "/fr/"))


def _oracle(rounds: int = 30) -> str:
    url = r"regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', {})"
    steps = ["r0 AS (SELECT kind, host, w * 0.15 AS rank FROM s)"]
    for i in range(1, rounds + 1):
        steps.append(f"""r{i} AS MATERIALIZED (SELECT kind, host, sum(rank) AS rank FROM (
  SELECT f.kind, f.dst AS host, r.rank * f.p * 0.85 AS rank FROM r{i - 1} r JOIN f ON f.kind = r.kind AND f.src = r.host
  UNION ALL SELECT kind, host, w * 0.15 FROM s) GROUP BY 1, 2)""")
    return rf"""
WITH p AS (
  SELECT page_id, translate(coalesce({url.format(1)}, ''), '{UPPER}', '{LOWER}') AS host, coalesce({url.format(2)}, '') AS path, html FROM pages),
rules(act, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
hosts AS (SELECT DISTINCT host, path FROM p),
fit AS (
  SELECT host, path, rh || rp AS rule, act FROM hosts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  QUALIFY row_number() OVER (PARTITION BY host, path ORDER BY length(rh || rp) DESC, length(rh) DESC) = 1),
j AS (SELECT p.page_id, p.host, p.path, fit.rule, fit.act FROM p LEFT JOIN fit USING (host, path)),
lean AS (SELECT host, sum(CASE act WHEN 'allow' THEN 1 WHEN 'block' THEN -1 ELSE 0 END) AS l FROM j GROUP BY 1 HAVING l <> 0),
s AS (SELECT kind, host, l / sum(l) OVER (PARTITION BY kind) AS w
      FROM (SELECT CASE WHEN l > 0 THEN 't' ELSE 'd' END AS kind, host, CAST(abs(l) AS DOUBLE) AS l FROM lean)),
e AS (SELECT src, dst, count(*) AS n FROM (
        SELECT host AS src, translate(unnest(regexp_extract_all(html, '(?i)href\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\s>]*)', 1)), '{UPPER}', '{LOWER}') AS dst FROM p)
      WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY 1, 2),
b AS (SELECT 't' AS kind, src, dst, n FROM e UNION ALL SELECT 'd', dst, src, n FROM e),
f AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS p FROM b),
{", ".join(steps)},
h AS (SELECT host, coalesce(sum(rank) FILTER (WHERE kind = 't'), 0) AS t, coalesce(sum(rank) FILTER (WHERE kind = 'd'), 0) AS d FROM r{rounds} GROUP BY 1)
SELECT page_id, j.host, path, rule, coalesce(act, CASE WHEN d > 0.5 * (t + d) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN h ON j.host = h.host"""


ORACLE = _oracle()
