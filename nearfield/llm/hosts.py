"""URL filters: stated rules first, else the reputation of the host.

A page's outcome is bad where a label gives it quality 0. Counts of outcomes shrink by beta-binomial priors along host, registered domain
and suffix: the mean of each level is the prior mean of the level below, and the strength of a prior is estimated from how
much the groups of the level vary beyond binomial chance (empirical Bayes, by moments). A host is blocked where the
lower bound of its posterior share of bad pages, mean less :data:`Z` standard deviations, is above :data:`CUT`.

Counts per host are partial sums, written once, so a host with most of the pages is no burden; only pages whose host may be blocked are joined with
the blocked hosts, those of one host in many tasks.

Defined cases. A null url, or one without ``://``, has an empty host and path, no rule, and is allowed. A host without labels has its domain's
prior. Null labels are no outcomes; a page with several labels has several. Repeated pages count as often as they stand there.
The suffix is a host's last two labels if these are among :data:`SUFFIXES`, else its last one; the registered domain has one label more. Among rules that fit the longest wins; ties go to the one listed first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.bitmap import bitmap, flagged
from nearfield.session import materialise
from nearfield.tables import lookup

Z, CUT = 1.6448536269514722, 0.5
#: Intra-group correlation: the least, the most, and what is assumed where groups are too few to estimate it.
RHO_LEAST, RHO_MOST, RHO_ASSUMED = 0.001, 0.5, 0.05
#: (verdict, host, path). A parameter of a few hundred rules at most; they become one expression.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Public suffixes of two labels under which sites of unrelated owners are registered. A parameter, for longer lists.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk", "sch.uk", "com.au", "edu.au", "gov.au", "id.au", "net.au", "org.au", "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp",
    "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz", "ac.in", "co.in", "gov.in", "net.in", "org.in", "com.br", "gov.br", "net.br", "org.br", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn",
    "com.mx", "gob.mx", "org.mx", "com.ar", "gob.ar", "org.ar", "com.tr", "gov.tr", "org.tr", "ac.za", "co.za", "gov.za", "org.za", "ac.kr", "co.kr", "go.kr", "or.kr", "com.tw", "edu.tw", "org.tw",
    "com.hk", "edu.hk", "org.hk", "com.sg", "edu.sg", "ac.il", "co.il", "org.il", "com.pl", "net.pl", "org.pl", "com.ua", "com.es", "org.es", "co.id", "or.id", "com.my", "co.th", "com.vn", "com.co",
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path up to a query or fragment; both empty without ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the longest is tried first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, parent: str | None) -> float:
    """The prior's strength 1 / rho - 1 from groups (n, bad) within their parents."""
    by = [parent] if parent else []
    totals = groups.where("n > 0").groupBy(*by).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("bb"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.count(F.lit(1)).alias("g"))
    spread = F.col("bb") - F.col("bad") * F.col("bad") / F.col("n")
    s = totals.where("n > 0").agg(F.sum("n"), F.sum("bad"), F.sum(spread), F.sum(F.col("n") - F.col("nn") / F.col("n")), F.sum(F.col("g") - 1)).first()
    n, bad, ss, room, free = (float(x or 0) for x in s)
    v = bad / n * (1 - bad / n) if n else 0.0
    rho = RHO_ASSUMED if v <= 0 or room - free <= 0 else min(RHO_MOST, max(RHO_LEAST, (ss / v - free) / (room - free)))
    return 1 / rho - 1


def domain_and_suffix(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    two = F.substring_index(host, ".", -2)
    known = two.isin(list(suffixes))
    return F.when(known, F.substring_index(host, ".", -3)).otherwise(two), F.when(known, two).otherwise(F.substring_index(host, ".", -1))


def reputations(outcomes: DataFrame, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, n, bad, mean, lower) from (host, bad), bad null where a page has no outcome."""
    hosts = outcomes.where("host <> ''").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    domain, suffix = domain_and_suffix(F.col("host"), suffixes)
    hosts = materialise(hosts.withColumn("domain", domain).withColumn("suffix", suffix), "hosts-counts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = materialise(hosts.groupBy("domain", "suffix").agg(*sums), "hosts-domains")
    suffixed = domains.groupBy("suffix").agg(*sums)
    k_host, k_domain, k_suffix = _strength(hosts, "domain"), _strength(domains, "suffix"), _strength(suffixed, None)
    n, bad = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    root = (bad + 1) / (n + 2)
    shrunk = lambda k, prior: (F.col("bad") + F.lit(k) * prior) / (F.col("n") + F.lit(k))
    means = suffixed.select("suffix", shrunk(k_suffix, F.lit(root)).alias("suffix_mean"))
    priors = domains.join(means, "suffix").select("domain", shrunk(k_domain, F.col("suffix_mean")).alias("domain_mean"))
    posterior = lookup(hosts, "domain", priors, "host").withColumn("a", F.col("bad") + F.lit(k_host) * F.col("domain_mean")).withColumn("b", F.col("n") - F.col("bad") + F.lit(k_host) * (1 - F.col("domain_mean")))
    total, mean = F.col("a") + F.col("b"), F.col("a") / (F.col("a") + F.col("b"))
    return posterior.select("host", "n", "bad", mean.alias("mean"), (mean - F.lit(Z) * F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))).alias("lower"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality", suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(page_id, host, path, rule, verdict), a row for each row of pages."""
    host, path = host_and_path(F.col(url_col))
    own = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    outcome = labels.where(F.col(label_col).isNotNull()).select(F.col(label_id).alias("page_id"), (F.col(label_col) == 0).cast("long").alias("bad"))
    # Hosts without an outcome take the prior of their domain, so all pages are counted.
    counted = reputations(own.select("page_id", "host").join(outcome, "page_id", "left"), suffixes)
    blocked = materialise(counted.where(F.col("lower") > CUT).select("host", F.lit("block").alias("reputation")), "hosts-blocked")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    marked = flagged(own, "host", bitmap(blocked, "host"), "may")
    apart = marked.where("NOT may").drop("may").withColumn("reputation", F.lit(None).cast("string"))
    joined = lookup(marked.where("may").drop("may"), "host", blocked, "page_id", "left").select(*own.columns, "reputation")
    return apart.unionByName(joined).select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "reputation", F.lit("allow")).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


SQL = f"""
WITH r AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r
), o AS (
  SELECT host, CASE WHEN l.quality IS NULL THEN NULL WHEN l.quality = 0 THEN 1 ELSE 0 END AS bad
  FROM p LEFT JOIN (SELECT * FROM labels WHERE quality IS NOT NULL) l ON l.doc_id = p.page_id
), h AS (
  SELECT host, CASE WHEN two IN {SUFFIXES} THEN array_to_string(list_slice(parts, -3, -1), '.') ELSE two END AS domain, CASE WHEN two IN {SUFFIXES} THEN two ELSE list_extract(parts, -1) END AS suffix,
    count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM (SELECT *, string_split(host, '.') AS parts, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS two FROM o) WHERE host <> '' GROUP BY host, parts, two
), d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
levels AS (
  SELECT 'host' AS lv, domain AS parent, n, bad FROM h UNION ALL SELECT 'domain', suffix, n, bad FROM d UNION ALL SELECT 'suffix', '', n, bad FROM s
), totals AS (
  SELECT lv, parent, sum(n) AS n, sum(bad) AS bad, sum(bad * bad / n) AS bb, sum(n * n) AS nn, count(*) AS g FROM levels WHERE n > 0 GROUP BY lv, parent
), pooled AS (
  SELECT lv, sum(n) AS n, sum(bad) AS bad, sum(bb - bad * bad / n) AS ss, sum(n - nn / n) AS room, sum(g - 1) AS free FROM totals GROUP BY lv
), k AS (
  SELECT lv, 1 / (CASE WHEN bad / n * (1 - bad / n) <= 0 OR room - free <= 0 THEN {RHO_ASSUMED}
    ELSE least({RHO_MOST}, greatest({RHO_LEAST}, (ss / (bad / n * (1 - bad / n)) - free) / (room - free))) END) - 1 AS k FROM pooled
), root AS (SELECT (coalesce(sum(bad), 0) + 1) / (coalesce(sum(n), 0) + 2) AS m FROM s),
sm AS (SELECT suffix, (bad + kk.k * root.m) / (n + kk.k) AS m FROM s, root, (SELECT coalesce(max(k), {1 / RHO_ASSUMED - 1}) AS k FROM k WHERE lv = 'suffix') kk),
dm AS (SELECT domain, (bad + kk.k * sm.m) / (n + kk.k) AS m FROM d JOIN sm USING (suffix), (SELECT coalesce(max(k), {1 / RHO_ASSUMED - 1}) AS k FROM k WHERE lv = 'domain') kk),
post AS (SELECT host, bad + kk.k * dm.m AS a, n - bad + kk.k * (1 - dm.m) AS b FROM h JOIN dm USING (domain), (SELECT coalesce(max(k), {1 / RHO_ASSUMED - 1}) AS k FROM k WHERE lv = 'host') kk),
blocked AS (SELECT host FROM post WHERE a / (a + b) - {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > {CUT}),
ruled AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN host IN (SELECT host FROM blocked) THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
