"""URL filters: rules first, else the host's reputation by empirical Bayes.

Reputation: labelled pages are good or bad. The bad rate of a host is a
beta-binomial whose prior comes from its registered domain, whose prior comes
from its public suffix, whose prior comes from all labelled pages. The
strength of each level's prior is estimated by the method of moments from how
far its members' rates spread round the rate of their own parent. A host is
blocked if the lower bound of its posterior (mean less WIDTH deviations) is
over MOST_BAD; so a host with few labels leans on its domain and is allowed in
doubt. One without any labels takes its domain's rate for its own, else its
suffix's, else that of all labelled pages, and is as unsure as that prior.

A domain is the last label before the suffix and the suffix; the suffix is the
last label, or the last two if SUFFIXES has them; an IPv4 address is a domain
of its own. User names and ports are no part of either. A host is judged with
its user name and port as written.

Null urls, and those without ://, have empty host and path, fit no rule and
share the reputation of the empty host. Labels with null marks don't count
unless the other mark says bad; repeated labels each count; repeated pages get
a row each. Other columns aren't read. An empty table of pages gives no rows;
without labels every host is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: Of rules given as a list, which becomes part of the plan.
MOST_RULES = 1000
WIDTH, MOST_BAD, WEAKEST, STRONGEST = 1.645, 0.5, 2.0, 1000.0
# Public suffixes of two labels.
SUFFIXES = [
    f"{second}.{country}"
    for country, names in {
        "uk": "ac co gov ltd me net org plc sch",
        "au": "asn com edu gov id net org",
        "nz": "ac co geek gen govt net org school",
        "za": "ac co gov net org web",
        "jp": "ac ad co ed go gr lg ne or",
        "kr": "ac co go ne or pe re",
        "cn": "ac com edu gov net org",
        "tw": "com edu gov idv net org",
        "hk": "com edu gov idv net org",
        "sg": "com edu gov net org per",
        "my": "com edu gov net org",
        "th": "ac co go in net or",
        "in": "ac co edu firm gen gov ind net nic org res",
        "id": "ac co go or sch web",
        "il": "ac co gov net org",
        "tr": "com edu gen gov net org",
        "br": "com edu gov net org",
        "ar": "com edu gob net org",
        "mx": "com edu gob net org",
        "co": "com edu gov net org",
        "pe": "com edu gob net org",
        "ua": "com edu gov net org",
        "pl": "com edu gov net org",
        "es": "com edu gob nom org",
        "pt": "com edu gov org",
        "gr": "com edu gov net org",
    }.items()
    for second in names.split()
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ADDRESS = r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    name = F.substring_index(F.substring_index(host, "@", -1), ":", 1)
    two = F.substring_index(name, ".", -2)
    long = two.isin(SUFFIXES)
    own = name.rlike(_ADDRESS)
    domain = F.when(own, name).when(long, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, F.when(own, "").when(long, two).otherwise(F.substring_index(name, ".", -1))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as a struct of size, text and verdict; null if none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    fits = [
        F.when((F.concat(F.lit("."), host).endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("text"), F.lit(verdict).alias("verdict")))
        for verdict, h, p in rules
    ]
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<size:int,text:string,verdict:string>")


def _summed(level: DataFrame, *keys: str) -> DataFrame:
    return level.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))


def _strength(level: DataFrame, parent: str | None = None) -> float:
    """Pseudo-counts of the priors of a level (n, bad for each member), from the spread within each parent, pooled over parents."""
    n, rate = F.col("n"), F.col("bad") / F.col("n")
    # a sum of squares about the parent's rate m is that of rates less N m^2
    sums = level.groupBy(*[parent] * (parent is not None)).agg(F.count("*").alias("k"), F.sum("n").alias("total"), F.sum("bad").alias("bads"), F.sum(n * n).alias("squares"), F.sum(n * rate * rate).alias("powers"))
    mean = F.col("bads") / F.col("total")
    some = sums.withColumn("mean", mean).filter((F.col("k") > 1) & (F.col("mean") > 0) & (F.col("mean") < 1))
    spread = (F.col("powers") - F.col("total") * F.col("mean") * F.col("mean")) / (F.col("mean") * (1 - F.col("mean"))) - (F.col("k") - 1)
    room = F.col("total") - F.col("squares") / F.col("total") - (F.col("k") - 1)
    above, below = some.agg(F.sum(spread), F.sum(room)).first()
    share = above / below if below and below > 0 else 0.0
    return min(STRONGEST, max(WEAKEST, 1 / share - 1)) if share > 0 else STRONGEST


def reputations(labelled: DataFrame, hosts_of_pages: DataFrame) -> DataFrame:
    """host, bad (0 or 1) -> host, bound for each host of pages: the lower posterior bound of its bad rate. All counts are by partial aggregation."""
    domain_of, suffix_of = domain_and_suffix(F.col("host"))
    hosts = labelled.groupBy("host").agg(F.count("*").cast("double").alias("n"), F.sum("bad").cast("double").alias("bad")).withColumns({"domain": domain_of, "suffix": suffix_of})
    domains = _summed(hosts, "domain", "suffix")
    suffixes = _summed(domains, "suffix")
    total, bad = suffixes.agg(F.sum("n"), F.sum("bad")).first()
    rate = bad / total if total else 0.0
    a, b, c = _strength(suffixes), _strength(domains, "suffix"), _strength(hosts, "domain")
    wider = suffixes.select("suffix", ((a * rate + F.col("bad")) / (a + F.col("n"))).alias("wider"))
    prior = domains.join(wider, "suffix").select("domain", ((b * F.col("wider") + F.col("bad")) / (b + F.col("n"))).alias("prior"))
    wanted = hosts_of_pages.select("host").distinct().join(hosts.select("host", "n", "bad"), "host", "left").na.fill(0, ["n", "bad"]).withColumns({"domain": domain_of, "suffix": suffix_of})
    wanted = wanted.join(prior, "domain", "left").join(wider, "suffix", "left").withColumn("prior", F.coalesce("prior", "wider", F.lit(rate)))
    wanted = wanted.withColumn("mean", (c * F.col("prior") + F.col("bad")) / (c + F.col("n")))
    return wanted.select("host", (F.col("mean") - WIDTH * F.sqrt(F.col("mean") * (1 - F.col("mean")) / (c + F.col("n") + 1))).alias("bound"))


def verdicts(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each page. labels: doc_id (a page_id), quality and toxic; bad is toxic or of no quality."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    bad = ((F.col("toxic") == 1) | (F.col("quality") == 0)).cast("int")
    marks = labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")).filter("bad is not null")
    known = parts.select("page_id", "host").join(marks, "page_id").select("host", "bad")
    judged = parts.join(reputations(known, parts), "host", "left").withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("bound") > MOST_BAD, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("fit.text").alias("rule"), F.coalesce("fit.verdict", method).alias("verdict"))


_FITS = "\n  UNION ALL ".join(f"SELECT '{v}' AS verdict, '{h}' AS h, '{p}' AS p" for v, h, p in RULES)
_LONG = ", ".join(f"'{x}'" for x in SUFFIXES)
_NAME = "split_part(string_split(host, '@')[-1], ':', 1)"
_LAST = f"array_to_string(list_slice(string_split({_NAME}, '.'), -{{}}, -1), '.')"
_DOMAIN = f"CASE WHEN regexp_matches({_NAME}, '{_ADDRESS}') THEN {_NAME} WHEN {_LAST.format(2)} IN ({_LONG}) THEN {_LAST.format(3)} ELSE {_LAST.format(2)} END"
_SUFFIX = f"CASE WHEN regexp_matches({_NAME}, '{_ADDRESS}') THEN '' WHEN {_LAST.format(2)} IN ({_LONG}) THEN {_LAST.format(2)} ELSE {_LAST.format(1)} END"


def _sql_strength(level: str, parent: str) -> str:
    return f"""(SELECT CASE WHEN below > 0 AND above > 0 THEN least({STRONGEST}, greatest({WEAKEST}, below / above - 1)) ELSE {STRONGEST} END FROM (
    SELECT sum((powers - total * m * m) / (m * (1 - m)) - (k - 1)) AS above, sum(total - squares / total - (k - 1)) AS below FROM (
      SELECT count(*) AS k, sum(n) AS total, sum(n * n) AS squares, sum(bad * bad / n) AS powers, sum(bad) / sum(n) AS m FROM {level} GROUP BY {parent}) WHERE k > 1 AND m > 0 AND m < 1))"""


SQL = f"""WITH rules AS ({_FITS}),
rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
known AS (SELECT host, CASE WHEN toxic = 1 OR quality = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS bad FROM parts JOIN labels ON page_id = doc_id WHERE (toxic = 1 OR quality = 0) IS NOT NULL),
hosts AS (SELECT host, count(*)::DOUBLE AS n, sum(bad) AS bad, {_DOMAIN} AS domain, {_SUFFIX} AS suffix FROM known GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY suffix),
base AS (SELECT coalesce(sum(bad) / sum(n), 0) AS rate FROM suffixes),
strengths AS (SELECT {_sql_strength('suffixes', "''")} AS a, {_sql_strength('domains', 'suffix')} AS b, {_sql_strength('hosts', 'domain')} AS c, rate FROM base),
s AS (SELECT suffix, (a * rate + bad) / (a + n) AS wider FROM suffixes, strengths),
d AS (SELECT domain, (b * wider + bad) / (b + n) AS prior FROM domains JOIN s USING (suffix), strengths),
all_hosts AS (SELECT host, {_DOMAIN} AS domain, {_SUFFIX} AS suffix FROM (SELECT DISTINCT host FROM parts)),
h AS (SELECT host, (c * coalesce(prior, wider, rate) + coalesce(bad, 0)) / (c + coalesce(n, 0)) AS mean, c + coalesce(n, 0) + 1 AS size
  FROM all_hosts LEFT JOIN (SELECT host, n, bad FROM hosts) USING (host) LEFT JOIN d USING (domain) LEFT JOIN s USING (suffix), strengths),
fits AS (SELECT page_id, host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM parts), rules WHERE ('.' || host) LIKE ('%.' || h) AND starts_with(path, p) GROUP BY ALL)
SELECT parts.page_id, parts.host, parts.path, rule, coalesce(verdict, CASE WHEN mean - {WIDTH} * sqrt(mean * (1 - mean) / size) > {MOST_BAD} THEN 'block' ELSE 'allow' END) AS verdict
FROM parts JOIN h USING (host) LEFT JOIN fits USING (page_id, host, path)"""
