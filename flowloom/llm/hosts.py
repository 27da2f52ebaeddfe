"""URL filtering by rules and by empirical-Bayes host reputation, built-in expressions only.

Labelled pages say how many of a host's pages turned out bad. The share is
shrunk from host to registered domain to public suffix to everything: each
level has a beta prior around the estimate of the level above, whose strength
comes from how much the groups of that level differ (moments of the
beta-binomial). A host is blocked if the lower posterior bound of its bad share
exceeds a limit. Rules go first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Rules as (verdict, host, path), and suffixes of two labels.
RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
SECOND_LEVEL = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in", "com.cn"]
STRONGEST = 1e6


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); NULL if none does."""
    out = None
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        value = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host, without user and port."""
    name = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")
    labels = F.split(name, r"\.")
    two = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), F.lit(2)), ".")
    three = F.array_join(F.slice(labels, F.greatest(F.size(labels) - 2, F.lit(1)), F.lit(3)), ".")
    long = two.isin(SECOND_LEVEL)
    return F.when(long, three).otherwise(two), F.when(long, two).otherwise(F.element_at(labels, -1))


def _strength(groups: DataFrame) -> DataFrame:
    """One row: the prior strength of a level from the moments of its groups (``bad``, ``n``)."""
    sums = groups.where("n > 0").agg(
        F.sum("n").alias("N"), F.sum("bad").alias("B"), F.sum(F.col("n") * F.col("n")).alias("N2"), F.count("*").alias("k"),
        F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("Q"))
    p = F.col("B") / F.col("N")
    m = p * (1 - p)
    spread = F.col("Q") - F.col("N") * p * p
    rho = (spread - m * (F.col("k") - 1)) / (m * (F.col("N") - F.col("N2") / F.col("N") - (F.col("k") - 1)))
    return sums.select(
        F.coalesce(p, F.lit(0.0)).alias("mean"),
        F.when(rho > 1 / STRONGEST, (1 - F.least(rho, F.lit(0.999))) / F.least(rho, F.lit(0.999))).otherwise(STRONGEST).alias("strength"))


def reputation(outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """Posterior per host: ``host``, ``bad_share`` and its ``lower`` bound.

    ``outcomes`` has one row per page: ``host``, ``bad`` (1, 0 or NULL where the
    page is not labelled). Counts are combined before each shuffle, so a host
    with most of the pages is one row a task.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = outcomes.groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"), F.count("bad").alias("n")).withColumns({"domain": domain, "suffix": suffix})
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))

    def prior(level: DataFrame, name: str) -> DataFrame:
        return F.broadcast(_strength(level).select(F.col("mean").alias("_mean"), F.col("strength").alias(name)))  # one row

    def shrink(above: str, strength: str) -> Column:
        return (F.col("bad") + F.col(strength) * F.col(above)) / (F.col("n") + F.col(strength))

    s = suffixes.crossJoin(prior(suffixes, "_s")).select("suffix", shrink("_mean", "_s").alias("suffix_share"))
    d = domains.crossJoin(prior(domains, "_d")).drop("_mean").join(s, "suffix").select("domain", "suffix", shrink("suffix_share", "_d").alias("domain_share"))
    h = hosts.crossJoin(prior(hosts, "_h")).drop("_mean").join(d, ["domain", "suffix"])
    mean = shrink("domain_share", "_h")
    deviation = F.sqrt(F.greatest(mean * (1 - mean), F.lit(0.0)) / (F.col("n") + F.col("_h") + 1))
    return h.select("host", mean.alias("bad_share"), (mean - z * deviation).alias("lower"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules=RULES, limit: float = 0.5, id_col: str = "page_id", url_col: str = "url",
               z: float = 1.645) -> DataFrame:
    """``id_col``, ``host``, ``path``, ``rule``, ``verdict`` of every page.

    ``labels`` gives outcomes by page id in ``doc_id``: a page is bad if any of
    its labels has ``quality`` 0 or ``toxic`` 1. Pages without a label count for
    nothing. A NULL or malformed url has an empty host, which is judged like
    any host. Repeated rows are rows of their own (and count as often). Without
    any label every host is allowed unless a rule blocks it.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    outcome = labels.groupBy(F.col("doc_id").alias(id_col)).agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    known = reputation(rows.join(outcome, id_col, "left").select("host", "bad"), z)
    rule = rule_of(F.col("host"), F.col("path"), rules)
    return rows.join(known, "host", "left").select(
        id_col, "host", "path", rule["rule"].alias("rule"),
        F.coalesce(rule["verdict"], F.when(F.col("lower") > limit, "block").otherwise("allow")).alias("verdict"))


# The same in DuckDB SQL.
SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages),
rows AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
outcome AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY 1),
named AS (
  SELECT host, coalesce(sum(bad), 0)::DOUBLE AS bad, count(bad)::DOUBLE AS n,
    string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS l
  FROM rows LEFT JOIN outcome USING (page_id) GROUP BY host),
hosts AS (
  SELECT host, bad, n, array_to_string(l[greatest(len(l) - 1, 1):], '.') AS two, l[-1] AS last,
    array_to_string(l[greatest(len(l) - 2, 1):], '.') AS three FROM named),
split AS (
  SELECT host, bad, n, CASE WHEN two IN (%(second)s) THEN three ELSE two END AS domain,
    CASE WHEN two IN (%(second)s) THEN two ELSE last END AS suffix FROM hosts),
domains AS (SELECT suffix, domain, sum(bad) AS bad, sum(n) AS n FROM split GROUP BY ALL),
suffixes AS (SELECT suffix, sum(bad) AS bad, sum(n) AS n FROM domains GROUP BY ALL),
%(levels)s,
s AS (SELECT suffix, (bad + strength * mean) / (n + strength) AS share FROM suffixes, p_suffixes),
d AS (SELECT domain, suffix, (bad + strength * share) / (n + strength) AS dshare FROM domains JOIN s USING (suffix), p_domains),
h AS (SELECT host, n, strength, (bad + strength * dshare) / (n + strength) AS m FROM split JOIN d USING (domain, suffix), p_split),
known AS (SELECT host, m - 1.645 * sqrt(greatest(m * (1 - m), 0) / (n + strength + 1)) AS lower_bound FROM h),
ruled AS (SELECT page_id, host, path, CASE %(rules)s END AS rule FROM rows)
SELECT page_id, host, path, rule,
  CASE rule %(verdicts)s ELSE CASE WHEN lower_bound > 0.5 THEN 'block' ELSE 'allow' END END AS verdict
FROM ruled LEFT JOIN known USING (host)
""" % {
    "second": ", ".join(f"'{x}'" for x in SECOND_LEVEL),
    "levels": ",\n".join(f"""m_{t} AS (
  SELECT sum(n) AS N_, sum(bad) AS B, sum(n * n) AS N2, count(*) AS k, sum(bad * bad / n) AS Q FROM {t} WHERE n > 0),
r_{t} AS (
  SELECT B / N_ AS p, (Q - N_ * (B / N_) * (B / N_) - (B / N_) * (1 - B / N_) * (k - 1))
    / nullif((B / N_) * (1 - B / N_) * (N_ - N2 / N_ - (k - 1)), 0) AS rho FROM m_{t}),
p_{t} AS (
  SELECT coalesce(p, 0.0) AS mean, CASE WHEN rho > 1e-6 THEN (1 - least(rho, 0.999)) / least(rho, 0.999) ELSE 1e6 END AS strength FROM r_{t})"""
                         for t in ("suffixes", "domains", "split")),
    "rules": " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
                      for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))),
    "verdicts": " ".join(f"WHEN '{h}{p}' THEN '{v}'" for v, h, p in RULES),
}
