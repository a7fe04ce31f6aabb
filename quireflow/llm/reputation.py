"""URL filter: rules first, then the reputation of the host by empirical Bayes.

Labelled outcomes of pages (bad or not) are counted by host, registered domain and suffix. Each level's rate is shrunk
towards the level above by a beta prior whose strength is the moment estimate of how much the groups of that level
differ (beta-binomial); a host is blocked when the lower bound of its posterior rate of bad pages is above a limit that
follows the overall rate: LIFT times its odds. Hosts without labels inherit their domain's posterior, so only evidence
blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireflow.llm.common import quoted, written

#: Suffixes of more than one label under which names are registered (fixed values; a full list can be given as a table). The last three are reserved names that many sites share.
SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "ltd.uk", "me.uk", "net.uk", "org.uk", "plc.uk", "sch.uk", "com.au", "edu.au", "gov.au", "net.au", "org.au", "ac.nz", "co.nz", "govt.nz", "net.nz", "org.nz",
    "ac.jp", "co.jp", "go.jp", "ne.jp", "or.jp", "ac.kr", "co.kr", "go.kr", "or.kr", "com.cn", "edu.cn", "gov.cn", "net.cn", "org.cn", "com.hk", "org.hk", "com.tw", "org.tw", "com.sg", "edu.sg", "com.my", "co.id", "co.th",
    "ac.in", "co.in", "gov.in", "net.in", "org.in", "ac.il", "co.il", "org.il", "com.tr", "org.tr", "com.ua", "com.pl", "org.pl", "com.br", "gov.br", "org.br", "com.ar", "com.mx", "org.mx", "com.co", "com.pe", "ac.za", "co.za", "org.za",
    "example.com", "example.net", "example.org",
)
#: (verdict, rule): the host up to the first slash, then the start of the path.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: One-sided 95 % of a normal posterior, and how many times the overall odds of a bad page the odds of the bound must exceed.
Z, LIFT = 1.645, 3.0
#: Between-group correlation is held within these, so a prior weighs 1 to 999 pages.
RHO_LOW, RHO_HIGH = 0.001, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the filter sees them; both empty without ``://``."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def levels(host: Column, suffixes=SUFFIXES) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host; a port is no part of them."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    two = F.regexp_extract(name, r"([^.]*\.[^.]*)$", 1)
    long = two.isin(*suffixes)
    suffix = F.when(long, two).otherwise(F.regexp_extract(name, r"([^.]*)$", 1))
    domain = F.when(long, F.regexp_extract(name, r"([^.]*\.[^.]*\.[^.]*)$", 1)).otherwise(two)
    return F.when(domain == "", name).otherwise(domain), suffix


def table_levels(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """hosts (host, ...) with domain and suffix by a table of suffixes (first column): the longest that a host ends with.

    A host's tails meet the table by one equi join of rows per host, not per page; without a match the last label counts.
    """
    name = F.regexp_replace("host", r":[0-9]*$", "")
    labels = F.split(name, r"\.", -1)
    tails = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda k: F.struct((F.size("labels") - k + 1).alias("n"), F.array_join(F.slice("labels", k, F.size("labels")), ".").alias("tail")))
    parted = hosts.withColumn("labels", labels)
    known = suffixes.select(F.lower(F.col(suffixes.columns[0])).alias("tail")).distinct()
    longest = parted.select("host", F.explode(tails).alias("t")).select("host", "t.n", "t.tail").join(known, "tail").groupBy("host").agg(F.max("n").alias("long"))
    last = lambda n: F.array_join(F.slice("labels", F.greatest(F.size("labels") - n + 1, F.lit(1)), n), ".")
    n = F.coalesce("long", F.lit(1))
    return parted.join(longest, "host", "left").withColumn("suffix", last(n)).withColumn("domain", last(n + 1)).drop("labels", "long")


def _prior(groups: DataFrame, rate: float) -> float:
    """Strength of the beta prior of a level: moments of the groups' (n, k) around the overall rate.

    The one float term of a group is rounded to a millionth, so the sum doesn't hang on the order of rows.
    """
    r = groups.where("n > 0").agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum(F.floor(F.col("k") * F.col("k") * 1000000.0 / F.col("n")).cast("long")).alias("kk"),
        F.sum(F.floor(F.col("n") * 1000000.0).cast("decimal(38,0)") * F.col("n")).alias("nn"),
    ).first()
    if not r["g"]:
        return 1.0 / RHO_HIGH - 1.0
    spread = r["kk"] / 1e6 - rate * rate * r["n"]
    free = r["n"] - float(r["nn"]) / 1e6 / r["n"] - (r["g"] - 1)
    noise = rate * (1.0 - rate)
    rho = (spread / noise - (r["g"] - 1)) / free if noise > 0 and free > 0 else RHO_LOW
    rho = min(max(rho, RHO_LOW), RHO_HIGH)
    return 1.0 / rho - 1.0


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, suffixes: tuple[str, ...] | DataFrame = SUFFIXES) -> DataFrame:
    """Every page with host, path, rule, verdict, and the posterior of its host (labelled, bad, rate, lower bound, the limit of the bound).

    suffixes: registered suffixes of two labels, or a table of suffixes of any length. outcomes: (id, bad boolean); several outcomes of an id count as one, bad if any is; null outcomes count for nothing.
    A null url, or one without ``://``, has empty host and path and is judged as the host "" is. Repeated rows stay;
    other columns are not read; without labels everything that no rule blocks is allowed; an empty table gives an empty
    result. Counts are pre-aggregated before every shuffle; what meets the pages again is one row per host.
    """
    host, path = url_parts(F.col(quoted(url_col)))
    rows = pages.select(F.col(quoted(id_col)).alias("page_id"), host.alias("host"), path.alias("path"))
    seen = outcomes.select(F.col(outcomes.columns[0]).alias("page_id"), F.col(outcomes.columns[1]).cast("boolean").alias("bad")).where("bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    counted = rows.select("page_id", "host").join(seen, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("k"))
    if isinstance(suffixes, DataFrame):
        hosts = table_levels(written(counted, "host-counts"), suffixes)
    else:
        domain, suffix = levels(F.col("host"), suffixes)
        hosts = counted.select("host", "n", "k", domain.alias("domain"), suffix.alias("suffix"))
    hosts = written(hosts, "host-outcomes")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    tops = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    total = tops.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    rate = total["k"] / total["n"] if total["n"] else 0.0
    limit = LIFT * rate / (1.0 + (LIFT - 1.0) * rate)
    weight_top, weight_domain, weight_host = (F.lit(_prior(g, rate)) for g in (tops, domains, hosts))

    of_top = tops.select("suffix", ((F.col("k") + weight_top * rate) / (F.col("n") + weight_top)).alias("top_rate"))
    of_domain = domains.join(of_top, "suffix").select("domain", "suffix", ((F.col("k") + weight_domain * F.col("top_rate")) / (F.col("n") + weight_domain)).alias("domain_rate"))
    size = F.col("n") + weight_host
    mean = (F.col("k") + weight_host * F.col("domain_rate")) / size
    posterior = hosts.join(of_domain, ["domain", "suffix"]).select("host", F.col("n").alias("labelled"), F.col("k").alias("bad"), mean.alias("rate"), (mean - F.lit(Z) * F.sqrt(mean * (F.lit(1.0) - mean) / (size + 1.0))).alias("bound"))
    rule, says = matched_rule(F.col("host"), F.col("path"), rules)
    return rows.join(posterior, "host").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(says, F.when(F.col("bound") > F.lit(limit), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        "labelled", "bad", F.round("rate", 6).alias("rate"), F.round("bound", 6).alias("bound"), F.round(F.lit(limit), 6).alias("limit"),
    )
