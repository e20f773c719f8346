"""URL rules and link-graph propagation (operator 1).

A rule names a host and a path start; it fits the host and its subdomains and
the longest fitting rule wins.  Pages without a rule get their host's verdict
from the link graph: personalised PageRank carries trust from hosts with
allowed pages forward along host edges, and distrust from hosts with blocked
pages backward (who links to bad hosts is suspect).  Beside each runs the
PageRank of all pages with the same edges, so that a host's distrust (trust)
is the share of its rank that stems from blocked (allowed) pages.  A host is
blocked if its distrust reaches ``THRESHOLD`` and exceeds its trust.

Host edges are hrefs to another host, counted, and one edge each way between
a host and its parent domain of two labels or more (an IP address has none).

Rows in, defined results: a null url or one without ``://`` has an empty host
and path and is allowed; null html has no links; repeated rows count each;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohorta.llm.scratch import stored

#: Rules of the query (fixed values).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
DAMPING = 0.85
ROUNDS = 8
THRESHOLD = 0.5
#: An IP address, which belongs to no domain.
ADDRESS = r"^[0-9]+(\.[0-9]+){3}(:[0-9]+)?$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/"'?#\s<>]+)"""


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, or null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        value = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<verdict:string,rule:string>")


def parent(host: Column) -> Column:
    """The domain one label up if it has two labels, else null."""
    up = F.regexp_extract(host, r"^[^.]+\.(.+\..+)$", 1)
    return F.when(up != "", up)


def ancestors(hosts: DataFrame) -> DataFrame:
    """Distinct (src, dst): from each host and each domain above it to the next one up, at any depth."""
    labels = F.split("src", r"\.")
    empty = F.array_position(labels, "")
    every = (hosts.filter(parent(F.col("src")).isNotNull() & ~F.col("src").rlike(ADDRESS))
             .select(F.col("src").alias("host"), F.size(labels).alias("n"), empty.alias("empty"))
             .select("*", F.explode(F.sequence("n", F.lit(3), F.lit(-1))).alias("left")))
    # an empty label ends the way up
    return (every.filter("empty = 0 or empty > n - left + 1")
            .select(F.expr("substring_index(host, '.', -left)").alias("src"))
            .select("src", parent(F.col("src")).alias("dst")).filter("dst is not null").distinct())


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts and edges to parent domains."""
    own = pages.select(host_of(F.col("url")).alias("src"), F.col("html").cast("string").alias("html"))
    links = (own.filter("src <> ''")
             .select("src", F.explode(F.regexp_extract_all(F.col("html"), F.lit(HREF), F.lit(1))).alias("dst"))
             .select("src", F.translate("dst", UPPER, LOWER).alias("dst")).filter("src <> dst")
             .groupBy("src", "dst").agg(F.count("*").cast("double").alias("n")))
    links = stored(links, "host-links")
    hosts = own.select("src").filter("src <> ''").distinct().union(links.select("dst")).distinct()
    found = ancestors(hosts)
    up = found.withColumn("n", F.lit(1.0))
    down = up.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    return links.union(up).union(down).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """host, trust, distrust from (host, pages, allowed, blocked) and (src, dst, n).

    Both directions are one table keyed by (way, host); a round is one join
    with the edges and one sum, in which the seeds take part.
    """
    out = edges.groupBy("src").agg(F.sum("n").alias("total"))
    forward = edges.join(out, "src").select(F.lit(0).alias("way"), "src", "dst", (F.col("n") / F.col("total")).alias("w"))
    into = edges.groupBy("dst").agg(F.sum("n").alias("total"))
    backward = edges.join(into, "dst").select(F.lit(1).alias("way"), F.col("dst").alias("src"), F.col("src").alias("dst"),
                                              (F.col("n") / F.col("total")).alias("w"))
    both = stored(forward.union(backward), "host-edges")
    start = stored(seeds.select(F.lit(0).alias("way"), "host", F.col("allowed").alias("hit"), F.col("pages").alias("all"))
                   .union(seeds.select(F.lit(1), "host", F.col("blocked"), F.col("pages")))
                   .select("way", "host", F.col("hit").cast("double").alias("hit"), F.col("all").cast("double").alias("all")),
                   "host-seeds")
    base = start.select("way", "host", (F.col("hit") * (1 - damping)).alias("hit"),
                        (F.col("all") * (1 - damping)).alias("all"))
    rank = start
    for k in range(rounds):
        sent = (both.withColumnRenamed("src", "host").join(rank, ["way", "host"])
                .select("way", F.col("dst").alias("host"), (F.col("w") * F.col("hit") * damping).alias("hit"),
                        (F.col("w") * F.col("all") * damping).alias("all")))
        rank = sent.union(base).groupBy("way", "host").agg(F.sum("hit").alias("hit"), F.sum("all").alias("all"))
        if k % 4 == 3 or k == rounds - 1:
            rank = stored(rank, "host-rank")
    share = F.col("hit") / F.when(F.col("all") > 0, F.col("all"))
    return rank.groupBy("host").agg(F.coalesce(F.max(F.when(F.col("way") == 0, share)), F.lit(0.0)).alias("trust"),
                                    F.coalesce(F.max(F.when(F.col("way") == 1, share)), F.lit(0.0)).alias("distrust"))


def url_verdicts(pages: DataFrame, rules=RULES, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict of every page, with the host's trust and distrust."""
    judged = (pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"),
                           path_of(F.col("url")).alias("path"))
              .withColumn("found", rule_of(F.col("host"), F.col("path"), rules)))
    judged = judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"),
                           F.col("found.verdict").alias("ruled"))
    seeds = (judged.filter("host <> ''").groupBy("host")
             .agg(F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("allowed"),
                  F.count_if(F.col("ruled") == "block").alias("blocked")))
    # rounded so that summing in another order gives the same verdict
    known = propagate(seeds, host_edges(pages), rounds).select(
        "host", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))
    bad = (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust"))
    return (judged.join(known, "host", "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", F.when(bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
                    "trust", "distrust"))


def verdict_sql(rules=RULES, rounds: int = ROUNDS, damping: float = DAMPING, threshold: float = THRESHOLD) -> str:
    """The same verdicts in DuckDB SQL, rounds written out."""
    url = "coalesce(url, '')"
    host = f"translate(regexp_extract({url}, '^.*?://([^/?#]*)', 1, 's'), '{UPPER}', '{LOWER}')"
    path = f"regexp_extract({url}, '^.*?://[^/?#]*([^?#]*)', 1, 's')"
    cases = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, start = rule.partition("/")
        cases.append((f"(host = '{name}' or ends_with(host, '.{name}')) and starts_with(path, '/{start}')", rule, verdict))
    rule = "case " + " ".join(f"when {c} then '{r}'" for c, r, _ in cases) + " end"
    ruled = "case " + " ".join(f"when {c} then '{v}'" for c, _, v in cases) + " end"
    href = HREF.replace("'", "''")
    up = r"nullif(regexp_extract(src, '^[^.]+\.(.+\..+)$', 1), '')"
    sql = f"""with recursive pg as (select page_id, {host} as host, {path} as path, html from pages),
judged as (select page_id, host, path, {rule} as rule, {ruled} as ruled from pg),
seeds as (select host, count(*) as pages, count(*) filter (ruled = 'allow') as allowed,
  count(*) filter (ruled = 'block') as blocked from judged where host <> '' group by host),
links as (select src, dst, count(*)::double as n from
  (select host as src, translate(unnest(regexp_extract_all(html, '{href}', 1)), '{UPPER}', '{LOWER}') as dst
   from pg where host <> '') where src <> dst group by src, dst),
h0 as (select host as src from seeds union select dst from links),
ups as (select src, {up} as dst from h0 where {up} is not null and not regexp_matches(src, '{ADDRESS}')
  union select dst, {up.replace('src', 'dst')} from ups where {up.replace('src', 'dst')} is not null),
edges as (select src, dst, sum(n) as n from (select * from links union all select src, dst, 1.0 from ups
  union all select dst, src, 1.0 from ups) group by src, dst),
both_ways as (select 0 as way, src, dst, n / sum(n) over (partition by src) as w from edges
  union all select 1, dst, src, n / sum(n) over (partition by dst) from edges),
start as (select 0 as way, host, allowed::double as hit, pages::double as al from seeds
  union all select 1, host, blocked::double, pages::double from seeds),
r0 as (select * from start)"""
    for k in range(1, rounds + 1):
        sql += f""",
r{k} as (select way, host, sum(hit) as hit, sum(al) as al from
  (select b.way, b.dst as host, b.w * r.hit * {damping} as hit, b.w * r.al * {damping} as al
   from both_ways b join r{k - 1} r on b.src = r.host and b.way = r.way
   union all select way, host, hit * {1 - damping!r}, al * {1 - damping!r} from start) group by way, host)"""
    return sql + f""",
known as (select host, round(coalesce(max(case when way = 0 then hit / nullif(al, 0) end), 0.0), 9) as trust,
  round(coalesce(max(case when way = 1 then hit / nullif(al, 0) end), 0.0), 9) as distrust from r{rounds} group by host)
select page_id, j.host, path, rule, coalesce(ruled, case when distrust >= {threshold} and distrust > trust
  then 'block' else 'allow' end) as verdict, trust, distrust
from judged j left join known k on j.host = k.host"""
