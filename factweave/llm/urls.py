"""URL filtering: path rules first, then empirical-Bayes host reputation.

Labelled pages (``labels`` by page id; bad = toxic or low quality) give outcomes per host. Each level
of host, registered domain and suffix is a beta-binomial posterior whose prior mean is the level
above and whose strength is fitted by moments from the spread between groups; the root prior is the
overall rate. A page without a rule is blocked when the posterior's lower bound exceeds ``threshold``; the bound is
the normal approximation ``mean - z * deviation`` of the beta posterior, not its quantile.

Labels are read from the bare host, without user name and port. A suffix is the last label, or the last two where a
country's two letters follow a generic second level (``SECOND_LEVEL``), so ``a.com.mx`` and ``b.com.mx`` are domains of
their own; an address in digits or brackets is its own domain, of suffix ``ip``.

DataFrame code throughout. Pages meet one row per distinct host, so a hot host is only a hot join key
on the probe side, which adaptive execution splits; counts are pre-aggregated before every shuffle.
Defined cases: a null url or one without ``://`` has empty host and path, no rule, and is judged by
the empty host's own reputation; a null page_id keeps its row and meets no label; unlabelled hosts inherit domain,
suffix, then overall rates; repeated rows give repeated verdicts, and each labelled row counts; empty pages give no rows,
empty labels leave the prior of one half; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.llm.common import lower_ascii, table

#: Verdict, host, path prefix.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Generic second levels that registries of countries sell names below.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gob", "gov", "gouv", "govt", "ltd", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
_LONG = rf"(^|\.)({'|'.join(SECOND_LEVEL)})\.[a-z]{{2}}$"
_ADDRESS = r"^([0-9]+(\.[0-9]+){3}|\[.*)$"


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest fitting rule, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _bare(host: Column) -> Column:
    """The host without user name and port."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")


def _suffix(host: Column) -> Column:
    bare = _bare(host)
    return F.when(bare.rlike(_ADDRESS), "ip").when(bare.rlike(_LONG), F.substring_index(bare, ".", -2)).otherwise(F.substring_index(bare, ".", -1))


def _domain(host: Column) -> Column:
    bare = _bare(host)
    return F.when(bare.rlike(_ADDRESS), bare).when(bare.rlike(_LONG), F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))


def _strength(groups: DataFrame) -> Column:
    """Moment estimate of a beta prior's strength over groups with ``n`` and ``bad``."""
    mean = F.sum("bad") / F.sum("n")
    spread = F.sum((F.col("bad") * F.col("bad")) / F.col("n")) / F.sum("n") - mean * mean
    noise = mean * (1 - mean) * F.count("*") / F.sum("n")
    between = F.greatest(spread - noise, F.lit(1e-6))
    return F.least(F.greatest(mean * (1 - mean) / between - 1, F.lit(2.0)), F.lit(200.0))


def host_reputation(hosts: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """``host, rate, lower`` for each row of ``hosts`` from ``outcomes(host, bad 0/1)``."""
    counted = outcomes.groupBy("host").agg(F.count("*").alias("n"), F.sum("bad").alias("bad"))
    counted = counted.withColumn("domain", _domain(F.col("host"))).withColumn("suffix", _suffix(F.col("host")))
    dom = counted.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    suf = dom.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    root = suf.agg(((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("r0")).select(F.coalesce("r0", F.lit(0.5)).alias("r0"))
    ks = suf.agg(F.coalesce(_strength(suf), F.lit(2.0)).alias("k_suf")).crossJoin(F.broadcast(dom.agg(F.coalesce(_strength(dom), F.lit(2.0)).alias("k_dom"))))
    ks = ks.crossJoin(F.broadcast(counted.agg(F.coalesce(_strength(counted), F.lit(2.0)).alias("k_host")))).crossJoin(F.broadcast(root))
    named = hosts.select("host").distinct().withColumn("domain", _domain(F.col("host"))).withColumn("suffix", _suffix(F.col("host")))

    def level(df: DataFrame, stats: DataFrame, key: str) -> DataFrame:
        return df.join(stats.select(key, F.col("n").alias(f"n_{key}"), F.col("bad").alias(f"bad_{key}")), key, "left").na.fill(0, [f"n_{key}", f"bad_{key}"])

    j = level(level(level(named, counted, "host"), dom, "domain"), suf, "suffix").crossJoin(F.broadcast(ks))
    shrink = lambda bad, n, prior, k: (bad + prior * k) / (n + k)
    s = shrink(F.col("bad_suffix"), F.col("n_suffix"), F.col("r0"), F.col("k_suf"))
    d = shrink(F.col("bad_domain"), F.col("n_domain"), s, F.col("k_dom"))
    h = shrink(F.col("bad_host"), F.col("n_host"), d, F.col("k_host"))
    size = F.col("n_host") + F.col("k_host")
    return j.select("host", h.alias("rate"), (h - F.lit(z) * F.sqrt(h * (1 - h) / (size + 1))).alias("lower"))


def judge_urls(pages: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, rate, lower, verdict`` for each row of ``pages``."""
    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    bad = ((F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)).cast("long")
    outcomes = labels.select(F.col("doc_id").cast("long").alias("page_id"), bad.alias("bad")).join(urls.select("page_id", "host"), "page_id").select("host", "bad")
    scored = urls.join(host_reputation(urls, outcomes), "host", "left")
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    learnt = F.when(F.col("lower") > threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", rule.alias("rule"), "rate", "lower", F.coalesce(verdict, learnt).alias("verdict"))


def op10_url_reputation(spark, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict", F.round("rate", 9).alias("rate"), F.round("lower", 9).alias("lower"))


OP10_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) v(what, h, p)),
p AS (SELECT *, list_slice(string_split(host, '.'), -1, -1)[1] AS last1, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS last2, array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') AS last3
  FROM (SELECT page_id, host AS full_host, path, regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', '') AS host FROM u)),
k AS (SELECT page_id, full_host AS host, path,
    CASE WHEN regexp_matches(host, 'ADDRESS') THEN host WHEN regexp_matches(host, 'LONG') THEN last3 ELSE last2 END AS domain,
    CASE WHEN regexp_matches(host, 'ADDRESS') THEN 'ip' WHEN regexp_matches(host, 'LONG') THEN last2 ELSE last1 END AS suffix FROM p),
o AS (SELECT k.host, k.domain, k.suffix, CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END AS bad FROM k JOIN labels l ON l.doc_id = k.page_id),
ch AS (SELECT host, domain, suffix, count(*) AS n, sum(bad) AS bad FROM o GROUP BY ALL),
cd AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM ch GROUP BY ALL),
cs AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM cd GROUP BY ALL),
m AS (SELECT coalesce((sum(bad) + 1) / (sum(n) + 2), 0.5) AS r0 FROM cs),
st AS (SELECT lv, sum(bad) / sum(n) AS mean, sum(bad * bad / n) / sum(n) AS second, count(*) / sum(n) AS cn
       FROM (SELECT 'h' AS lv, n, bad FROM ch UNION ALL SELECT 'd', n, bad FROM cd UNION ALL SELECT 's', n, bad FROM cs) GROUP BY lv),
ks AS (SELECT lv, least(greatest(mean * (1 - mean) / greatest(second - mean * mean - mean * (1 - mean) * cn, 1e-6) - 1, 2.0), 200.0) AS k FROM st),
w AS (SELECT coalesce(max(k) FILTER (lv = 'h'), 2.0) AS kh, coalesce(max(k) FILTER (lv = 'd'), 2.0) AS kd, coalesce(max(k) FILTER (lv = 's'), 2.0) AS ks FROM ks),
hs AS (SELECT DISTINCT host, domain, suffix FROM k),
e AS (SELECT hs.host, coalesce(ch.n, 0) AS n, w.kh AS kh, coalesce(ch.bad, 0) AS bh,
    (coalesce(cd.bad, 0) + w.kd * (coalesce(cs.bad, 0) + m.r0 * w.ks) / (coalesce(cs.n, 0) + w.ks)) / (coalesce(cd.n, 0) + w.kd) AS d
  FROM hs LEFT JOIN ch ON ch.host = hs.host LEFT JOIN cd ON cd.domain = hs.domain LEFT JOIN cs ON cs.suffix = hs.suffix, w, m),
q AS (SELECT host, h, h - 1.645 * sqrt(h * (1 - h) / (size + 1)) AS lower FROM (SELECT host, n + kh AS size, (bh + d * kh) / (n + kh) AS h FROM e)),
f AS (SELECT page_id, what, h || p AS rule FROM u JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) = 1)
SELECT k.page_id, k.host, k.path, f.rule, coalesce(f.what, CASE WHEN q.lower > 0.5 THEN 'block' ELSE 'allow' END) AS verdict, round(q.h, 9) AS rate, round(q.lower, 9) AS lower
FROM k JOIN q USING (host) LEFT JOIN f USING (page_id)
""".replace("ADDRESS", _ADDRESS).replace("LONG", _LONG)
