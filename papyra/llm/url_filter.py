"""URL filter: path rules first, empirical-Bayes host reputation for the rest; DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import LOWER, UPPER, checkpoint, read, skew_safe_join

#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Suffixes of two labels, where sites of different owners share a registry; any other suffix is the last label. A caller
#: with a complete list (of two and three labels, however many) passes it as `suffixes`.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")
#: Normal quantile of the one-sided posterior bound, and the bad rate it must exceed.
Z, THRESHOLD = 1.645, 0.5
MAX_RULES = 500


def host_of(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_columns(rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; of equally long ones the block, then the alphabetically last."""
    name = verdict = F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[0] == "block", r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        name, verdict = F.when(fits, host + path).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def rules_joined(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """pages (host, path, ...) with rule and _verdict as rule_columns gives them, by joining each host's tails with the rules' hosts."""
    table = pages.sparkSession.createDataFrame([(h, p, k, h + p) for k, h, p in rules], "_rhost string, _rpath string, _kind string, _name string")
    urls = pages.select("host", "path").distinct()
    tails = urls.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda i: F.concat_ws(".", F.slice(F.split("host", r"\."), i, 1 << 20)))).alias("_rhost"))
    best = F.max_by(F.struct("_name", "_kind"), F.struct(F.length("_name"), F.col("_kind") == "block", F.col("_name")))
    fit = tails.join(table, "_rhost").where(F.col("path").startswith(F.col("_rpath"))).groupBy("host", "path").agg(best.alias("_best"), F.count(F.lit(1)).alias("_fits"))
    sizes = pages.groupBy("host", "path").agg(F.count(F.lit(1)).alias("_rows"))
    fit = checkpoint(fit.join(sizes, ["host", "path"]).select(F.struct("host", "path").alias("_at"), "_best", "_rows"))
    out = skew_safe_join(checkpoint(pages.withColumn("_at", F.struct("host", "path"))), fit, "_at", "_rows", pages.count())
    return out.select(*pages.columns, F.col("_best._name").alias("rule"), F.col("_best._kind").alias("_verdict"))


def strength(children: DataFrame) -> float:
    """Prior strength by the method of moments: columns _n, _b (labelled, bad) and _m (the parent's mean)."""
    v = F.col("_m") * (1 - F.col("_m"))
    row = children.where("_n > 0").agg(
        F.sum(F.pow(F.col("_b") - F.col("_n") * F.col("_m"), 2) / F.col("_n")).alias("s"), F.sum(v).alias("v"), F.sum(v * (F.col("_n") - 1)).alias("w")
    ).first()
    rho = (row.s - row.v) / row.w if row.w else 0.5
    return 1 / round(min(0.999, max(0.001, rho)), 6) - 1


def shrink(children: DataFrame, k: float) -> DataFrame:
    return children.withColumn("_m", (F.col("_b") + k * F.col("_m")) / (F.col("_n") + k))


def url_filter(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, z: float = Z, threshold: float = THRESHOLD, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, n_labelled (of the host), bad_bound.

    Pages that fit a rule are the labelled outcomes (block: bad). Bad rates shrink through beta-binomial priors from
    the global rate to suffix, registered domain and host, each level's strength fitted by moments. A page without a
    rule is blocked when the lower posterior bound of its host's bad rate (mean - z sd) exceeds threshold. Up to MAX_RULES rules are compiled
    into the plan, more are joined by host. suffixes: those of two and three labels; all others are taken to have one, so under a
    suffix that the list lacks unrelated sites share a domain's prior. A user or port counts for the host, not for its domain and suffix.

    A null url, or one without ``://``, has an empty host and path and shares the reputation of the empty host. Null
    and repeated ids keep their rows. An empty table gives an empty result. Other columns are ignored.
    """
    host, path = host_of(F.col("_url"))
    pages = df.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col), F.lit("")).alias("_url")).select("_id", host.alias("host"), path.alias("path"))
    if len(rules) <= MAX_RULES:
        rule, verdict = rule_columns(rules)
        pages = checkpoint(pages.select("_id", "host", "path", rule.alias("rule"), verdict.alias("_verdict")))
    else:
        pages = checkpoint(rules_joined(checkpoint(pages), rules))
    # Users and ports say nothing about who owns a host.
    labels = F.split(F.regexp_replace("host", r"^.*@|:[0-9]*$", ""), r"\.")
    ends = lambda n: (F.size(labels) > n) & F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n)).isin(*(x for x in suffixes if x.count(".") == n - 1))
    deep = F.when(ends(3), 3).when(ends(2), 2).otherwise(1)
    tail = lambda n: F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n))
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("_rows"), F.count("_verdict").alias("_n"), F.count_if(F.col("_verdict") == "block").alias("_b"))
    hosts = checkpoint(hosts.withColumn("_suffix", tail(deep)).withColumn("_domain", tail(deep + 1)))
    total = hosts.agg(F.sum("_rows").alias("rows"), F.sum("_n").alias("n"), F.sum("_b").alias("b")).first()
    n_rows = total.rows or 0
    mu = ((total.b or 0) + 0.5) / ((total.n or 0) + 1)
    domains = hosts.groupBy("_domain", "_suffix").agg(F.sum("_n").alias("_n"), F.sum("_b").alias("_b"), F.count(F.lit(1)).alias("_size"))
    suffixes = domains.groupBy("_suffix").agg(F.sum("_n").alias("_n"), F.sum("_b").alias("_b"), F.count(F.lit(1)).alias("_size")).withColumn("_m", F.lit(mu))
    suffixes = checkpoint(shrink(suffixes, strength(suffixes)))
    domains = skew_safe_join(domains, suffixes.select("_suffix", "_m", F.col("_size").alias("_kids")), "_suffix", "_kids", n_rows)
    domains = checkpoint(shrink(domains, strength(domains)))
    hosts = skew_safe_join(hosts, domains.select("_domain", "_m", F.col("_size").alias("_kids")), "_domain", "_kids", n_rows)
    k = strength(hosts := checkpoint(hosts))
    mean, weight = (F.col("_b") + k * F.col("_m")) / (F.col("_n") + k), F.col("_n") + k
    bound = mean - z * F.sqrt(mean * (1 - mean) / (weight + 1))
    hosts = checkpoint(hosts.select("host", "_rows", F.col("_n").alias("n_labelled"), F.round(bound, 6).alias("bad_bound")))
    judged = skew_safe_join(pages, hosts, "host", "_rows", n_rows)
    return judged.select(
        F.col("_id").alias(id_col), "host", "path", "rule",
        F.coalesce("_verdict", F.when(F.col("bad_bound") > threshold, "block").otherwise("allow")).alias("verdict"),
        "n_labelled", "bad_bound",
    )


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages"))


def _sql_rules() -> str:
    out = ""
    for kind, host, path in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[0] != "block", r[1] + r[2])):
        out += f" when (host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}') then '{kind} {host}{path}'"
    return f"case{out} end"


_STRENGTH = "(select 1 / round(least(0.999, greatest(0.001, coalesce((sum(pow(b - n * m, 2) / n) - sum(m * (1 - m))) / nullif(sum(m * (1 - m) * (n - 1)), 0), 0.5))), 6) - 1 from {0} where n > 0)"
_SUFFIXES = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
SQL = f"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
p as (select *, {_sql_rules()} as hit, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') as l from h),
q as (select *, case when len(l) > 2 and array_to_string(l[-2:], '.') in ({_SUFFIXES}) then 2 else 1 end as deep from p),
hosts as (select host, any_value(array_to_string(l[greatest(1, len(l) - deep + 1):], '.')) as suffix, any_value(array_to_string(l[greatest(1, len(l) - deep):], '.')) as domain,
  count(hit)::double as n, (count(*) filter (where hit like 'block %'))::double as b from q group by host),
s0 as (select suffix, sum(n) as n, sum(b) as b, (select (sum(b) + 0.5) / (sum(n) + 1) from hosts) as m from hosts group by suffix),
s1 as (select suffix, (b + k * m) / (n + k) as m from (select *, {_STRENGTH.format('s0')} as k from s0)),
d0 as (select domain, sum(n) as n, sum(b) as b, any_value(s1.m) as m from hosts join s1 using (suffix) group by domain),
d1 as (select domain, (b + k * m) / (n + k) as m from (select *, {_STRENGTH.format('d0')} as k from d0)),
h0 as (select host, n, b, m from hosts join d1 using (domain)),
h1 as (select host, n, (b + k * m) / (n + k) as e, n + k as w from (select *, {_STRENGTH.format('h0')} as k from h0)),
h2 as (select host, n::bigint as n_labelled, round(e - {Z} * sqrt(e * (1 - e) / (w + 1)), 6) as bad_bound from h1)
select page_id, host, path, substr(hit, strpos(hit, ' ') + 1) as rule,
  coalesce(split_part(hit, ' ', 1), case when bad_bound > {THRESHOLD} then 'block' else 'allow' end) as verdict, n_labelled, bad_bound
from q join h2 using (host)
"""
