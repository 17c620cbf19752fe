"""URL filter: explicit rules first, then an empirical-Bayes reputation of the host.

Every page with an outcome (bad or not) counts for its host, registered domain and
suffix.  At each level a beta-binomial prior is fitted to the groups' rates by moments,
and rates are shrunk from the top down: suffix to the overall rate, domain to its
suffix, host to its domain.  A page that no rule decides is blocked when the lower
bound of its host's posterior bad rate is above ``MOST_BAD`` and its domain has outcomes
of its own.  The bound uses the variance of the host's beta posterior, so a host with few
outcomes keeps the spread of the hosts of its domain; where moments can't be fitted the
prior weighs ``LEAST_WEIGHT`` pages, and where groups show no spread of their own at most
``MOST_WEIGHT``.

Outcomes come from the pages themselves, never from the rules: a page is bad if its host
has a word of ``BAD_WORDS``, or if signs ``SIGNS`` are over a ``JUNK_SHARE``-th of the
characters of its visible text (markup, scripts and styles taken out, entities too).  A
page without html has an outcome only by its host's words.

Only sums of counts leave a task before the joins.  Judged rows and host counts are stored,
so pages are read once.  The joins are on the host, domain and suffix tables, whose sizes
Spark weighs when it picks a join; a host with a large share of the pages is a skewed join
that Spark splits.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no
rule and is judged as the host of empty name; an empty host has no domain and no suffix;
ties between rules of equal length go to the later in code-point order (two different
rules that fit one url never have equal text); repeated rows are judged row by row; with
no outcomes at all nothing is blocked; an empty table gives an empty result; other columns
are not read.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from voxlake.llm.common import discard, stored

#: (rule as ``host/path``, verdict)
Rules = Sequence[tuple[str, str]]

#: Second-level labels under which names are registered (a fixed, documented choice).
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: Standard deviations below the posterior mean.
BOUND_SD = 1.645
#: Bad rate that the bound must exceed.
MOST_BAD = 0.2
#: Range of a fitted prior's weight, in pages; the least also where no fit is possible.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 100.0
#: Words of host names (parts between other characters than a-z) that make a page bad: adult, betting, drugs, advertising.
BAD_WORDS = ("ads", "adult", "bet", "bets", "betting", "casino", "escort", "pills", "poker", "porn", "sex", "spam", "viagra", "warez", "xxx")
#: Signs of junk text, and one over the share of visible characters above which a page is bad.
SIGNS, JUNK_SHARE = "#*$%|<>", 10
# patterns of what a reader doesn't see
HIDDEN = (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>", r"&#?[a-zA-Z0-9]+;")


def split_url(url: str = "url") -> tuple[Column, Column]:
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def rule_of(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does."""
    ordered = sorted(rules, key=lambda r: (len(r[0]), r[0]), reverse=True)

    def fits(rule: str) -> Column:
        name, _, rest = rule.partition("/")
        return ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")

    def choose(k: int) -> Column:
        return reduce(lambda c, r: c.when(fits(r[0]), F.lit(r[k])), ordered[1:], F.when(fits(ordered[0][0]), F.lit(ordered[0][k])))

    return (choose(0), choose(1)) if ordered else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def domain_and_suffix(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix: the last label, or two where the second is a known registry's."""
    second = "|".join(SECOND_LEVEL)
    suffix = F.regexp_extract(host, rf"((?:^|(?<=\.))(?:{second})\.[a-z]{{2}}|[^.]+)$", 1)
    domain = F.regexp_extract(host, rf"([^.]+\.(?:(?:{second})\.[a-z]{{2}}|[^.]+))$", 1)
    return F.when(domain == "", host).otherwise(domain), suffix


def outcome(host: Column, html: Column) -> Column:
    """1 for a bad page, 0 for a good one, null where nothing is known."""
    seen = html
    for pattern in HIDDEN:
        seen = F.regexp_replace(seen, pattern, " ")
    seen = F.regexp_replace(seen, r"[ \x09-\x0D]+", "")
    signs = F.length(seen) - F.length(F.translate(seen, SIGNS, ""))
    named = host.rlike(f"(^|[^a-z])({'|'.join(BAD_WORDS)})([^a-z]|$)")
    return F.when(named, 1).otherwise((signs * JUNK_SHARE > F.length(seen)).cast("int"))


def _weight(groups: DataFrame, rate: str) -> DataFrame:
    """One row: the prior's weight, by moments of the groups' rates about their priors."""
    n, k, p = F.col("n").cast("double"), F.col("bad").cast("double"), F.col(rate)
    sums = groups.where("n > 0").agg(
        F.sum(n).alias("sn"),
        F.count("*").alias("g"),
        F.sum(n * (k / n - p) * (k / n - p)).alias("spread"),
        F.sum(n * p * (1 - p)).alias("within"),
    )
    # E n (k/n - p)^2 = p (1 - p) (1 + (n - 1) rho), so spread ~ mean * (g + rho * (sn - g)); rho = 1 / (weight + 1)
    mean = F.col("within") / F.col("sn")
    rho = (F.col("spread") / mean - F.col("g")) / (F.col("sn") - F.col("g"))
    fitted = F.when((F.col("within") > 0) & (F.col("sn") > F.col("g")), F.when(rho > 0, 1 / rho - 1).otherwise(MOST_WEIGHT)).otherwise(LEAST_WEIGHT)
    return sums.select(F.greatest(F.lit(LEAST_WEIGHT), F.least(F.lit(MOST_WEIGHT), F.coalesce(fitted, F.lit(LEAST_WEIGHT)))).alias("weight"))


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, domain_n, prior, weight, n, bad, rate, low) from (host, bad 0/1/null for unknown).

    ``domain_n`` are the outcomes of the host's registered domain.
    """
    domain, suffix = domain_and_suffix(F.col("host"))
    counts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    hosts = stored(counts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    overall = suffixes.agg(F.coalesce(F.sum("bad") / F.nullif(F.sum("n"), F.lit(0)), F.lit(0.0)).alias("prior"))

    def shrunk(groups: DataFrame, name: str) -> DataFrame:
        # one row of one number, so the cross join is a scalar's
        rated = groups.crossJoin(F.broadcast(_weight(groups, "prior")))
        return rated.withColumn(name, (F.col("bad") + F.col("weight") * F.col("prior")) / (F.col("n") + F.col("weight")))

    by_suffix = stored(shrunk(suffixes.crossJoin(F.broadcast(overall)), "rate").select("suffix", F.col("rate").alias("prior")), "suffix-rates")
    by_domain = shrunk(domains.join(by_suffix, "suffix"), "rate").select("domain", "suffix", F.col("n").alias("domain_n"), F.col("rate").alias("prior"))
    by_domain = stored(by_domain, "domain-rates")
    by_host = shrunk(hosts.join(by_domain, ["domain", "suffix"]), "rate")
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("weight") + 1))
    out = stored(by_host.select("host", "domain_n", "prior", "weight", "n", "bad", "rate", (F.col("rate") - BOUND_SD * deviation).alias("low")), "host-rates")
    for made in (hosts, domains, suffixes, by_suffix, by_domain):
        discard(made)
    return out


def judge(pages: DataFrame, rules: Rules, outcomes: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, low) for every page; ``low`` is its host's bound.

    ``outcomes`` has (url, bad 0/1); without it they come from the pages (url, html).
    """
    host, path = split_url()
    bad = outcome(host, F.col("html")) if outcomes is None else F.lit(None).cast("int")
    cut = pages.select("page_id", host.alias("host"), path.alias("path"), bad.alias("bad"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = stored(cut.withColumns({"rule": rule, "ruled": verdict}), "ruled-pages")
    known = ruled.select("host", "bad")
    if outcomes is not None:
        known = known.unionByName(outcomes.select(host.alias("host"), F.col("bad").cast("int").alias("bad")))
    hosts = reputation(known).select("host", "low", ((F.col("low") > MOST_BAD) & (F.col("domain_n") > 0)).alias("bad_host"))
    judged = ruled.join(hosts, "host", "left")
    method = F.when(F.col("bad_host"), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "low")
