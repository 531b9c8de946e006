"""URL verdicts: rules first, else an empirical-Bayes reputation of the host, without Python.

Labelled page outcomes (1 good, 0 bad) are counted per host, registered domain and suffix.
Each level's rate is shrunk towards its parent's by a beta-binomial prior whose strength is
estimated from how the children's rates scatter: suffixes towards the rate of all labelled
pages, domains towards their suffix, hosts towards their domain.  A host is allowed when the
lower posterior bound of its rate reaches a threshold.
"""

from pyspark.sql import functions as F

from larder.llm.common import stored
from larder.operators.sizes import broadcast_if_small

# Suffixes under which anyone may register, an argument: x.y, *.y for all of a label, !x.y for an
# exception of it.  Where none fits, the last label is the suffix.
SUFFIXES = (
    "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "com.br", "co.jp", "co.in", "co.nz", "co.kr", "co.za",
    "com.cn", "com.mx", "com.tr", "github.io", "blogspot.com", "*.ck", "!www.ck",
)
MOST_SUFFIXES = 50_000
MOST_RULES = 5000
Z = 1.645
LEAST_RATE = 0.75
LEAST_STRENGTH, MOST_STRENGTH = 1.0, 1000.0


def url_parts(url):
    """(host, path) of a url; both are empty for null and where there is no ://.

    The host runs from the first :// to / ? # or the end, A-Z lower-cased; the path from
    there to ? # or the end.
    """
    begin = F.instr(url, "://")
    rest = F.coalesce(F.when(begin > 0, url.substr(begin + 3, F.length(url))), F.lit(""))
    host = F.translate(
        F.regexp_extract(rest, r"^[^/?#]*", 0),
        "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
        "abcdefghijklmnopqrstuvwxyz",
    )
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def with_parts(pages):
    """page_id, host, path of every page."""
    host, path = url_parts(F.col("url"))
    return pages.select("page_id", host.alias("host"), path.alias("path"))


def _last_labels(n):
    return F.call_function("substring_index", F.col("host"), F.lit("."), -n)


def with_domains(hosts, suffixes=SUFFIXES):
    """hosts (one row a host, further columns) with suffix and domain.

    The suffix is the longest rule that fits the host's end; an exception beats all others and
    stands for what follows its first label.  The domain is the suffix with one label more, or
    the host where there is none.  Ends of a host are joined to the rules, no longer than the
    longest rule, so a host of very many labels costs no more than others.
    """
    if len(suffixes) > MOST_SUFFIXES:
        raise ValueError(f"more than {MOST_SUFFIXES} suffixes are not broadcast")
    others = [c for c in hosts.columns if c != "host"]
    rules = hosts.sparkSession.createDataFrame([(s,) for s in set(suffixes)], "_rule string")
    longest = max((s.count(".") + 1 for s in suffixes), default=1)
    labels = F.split("host", r"\.")
    ends = hosts.select(
        "*", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.size(labels)))).alias("_length")
    )
    end = _last_labels(F.col("_length"))
    parent = _last_labels(F.col("_length") - 1)
    keys = F.array(end, F.concat(F.lit("*."), parent), F.concat(F.lit("!"), end))
    tried = ends.select("*", F.explode(keys).alias("_key"))
    exception = F.col("_rule").startswith("!")
    length = F.col("_length") - exception.cast("int")
    hit = F.when(F.col("_rule").isNotNull(), F.struct(exception.alias("exception"), length.alias("length")))
    found = tried.join(F.broadcast(rules), F.col("_key") == F.col("_rule"), "left").groupBy("host").agg(
        *[F.first(c).alias(c) for c in others], F.coalesce(F.max(hit)["length"], F.lit(1)).alias("_length")
    )
    return found.select(
        "host", *others,
        _last_labels(F.col("_length")).alias("suffix"),
        _last_labels(F.col("_length") + 1).alias("domain"),
    )


def rule_verdict(host, path, rules):
    """(rule, verdict) of the longest rule that fits, null where none does.

    rules: (verdict, host, path prefix).  A rule fits its host and subdomains when the path
    starts with the rule's.  Among equally long rules the first in code-point order wins.
    The list becomes one expression, so its length is bounded; more rules are refused.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, rule_host, prefix in sorted(
        rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]), reverse=True
    ):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(prefix)
        rule = F.when(fits, F.lit(rule_host + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _shrunk(children, key, parents, parent_key):
    """children (key, parent_key, n, good) with `rate`: their posterior mean and `strength`.

    The strength of the prior is the method of moments over all children: with parent rates
    m and observed rates p, the scatter beyond binomial noise, sum n (p - m)^2 against
    sum m (1 - m), gives rho, and the strength is 1 / rho - 1, kept within bounds.
    """
    joined = children.join(
        broadcast_if_small(parents.select(parent_key, F.col("rate").alias("prior"))), parent_key
    )
    noise = F.col("prior") * (1 - F.col("prior"))
    scatter = F.col("n") * F.pow(F.col("good") / F.col("n") - F.col("prior"), 2)
    moments = joined.where((F.col("n") > 0) & (noise > 0)).agg(
        F.sum(F.round(scatter - noise, 9).cast("decimal(38,9)")).cast("double").alias("extra"),
        F.sum(F.round((F.col("n") - 1) * noise, 9).cast("decimal(38,9)")).cast("double").alias("room"),
    )
    strength = F.when(
        (F.col("extra") > 0) & (F.col("room") > 0),
        F.least(
            F.lit(MOST_STRENGTH),
            F.greatest(F.lit(LEAST_STRENGTH), F.round(F.col("room") / F.col("extra") - 1, 6)),
        ),
    ).otherwise(MOST_STRENGTH)
    with_strength = joined.crossJoin(F.broadcast(moments.select(strength.alias("strength"))))
    return with_strength.withColumn(
        "rate",
        (F.col("good") + F.col("prior") * F.col("strength")) / (F.col("n") + F.col("strength")),
    )


def host_reputation(parts, outcomes, suffixes=SUFFIXES):
    """Per host: host, n, good, prior, strength, rate, bound.

    parts: page_id, host; outcomes: page_id, good (1 or 0; other values and
    null do not count, several of one page count each).  bound is the lower posterior bound
    of a beta distribution by its normal approximation.  Hosts without outcomes get their
    domain's rate and a wide bound; without any outcomes all rates are one half.
    """
    seen = outcomes.where(F.col("good").isin(0, 1)).groupBy("page_id").agg(
        F.count("*").alias("n"), F.sum("good").alias("good")
    )
    counted = parts.select("page_id", "host").join(seen, "page_id", "left")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "good")]
    # Each level is small beside the pages; written once, it is measured and joined from there.
    hosts = stored(with_domains(counted.groupBy("host").agg(*sums), suffixes), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(*sums)
    suffixes = domains.groupBy("suffix").agg(*sums).withColumn("root", F.lit(1))
    roots = suffixes.groupBy("root").agg(*sums).select(
        "root", ((F.col("good") + 0.5) / (F.col("n") + 1)).alias("rate")
    )
    rated = stored(_shrunk(suffixes, "suffix", roots, "root"), "suffixes")
    rated = stored(_shrunk(domains, "domain", rated, "suffix"), "domains")
    rated = stored(_shrunk(hosts, "host", rated, "domain"), "reputation")
    weight = F.col("n") + F.col("strength")
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (weight + 1))
    return rated.select(
        "host", "n", "good", "prior", "strength", "rate", (F.col("rate") - Z * spread).alias("bound")
    )


def judge(pages, outcomes, rules, least_rate=LEAST_RATE, suffixes=SUFFIXES):
    """Per row of pages: page_id, host, path, rule, verdict, rate, bound.

    The verdict is that of the longest rule that fits, else allow where the host's bound
    reaches least_rate and block below.  Pages without a url, or with none that has ://, share
    the empty host.  Pages are joined to their hosts' reputation, broadcast when its measured
    size allows it; else the join is shuffled and AQE splits hot hosts.
    """
    parts = with_parts(pages)
    known = host_reputation(parts, outcomes, suffixes).select("host", "rate", "bound")
    rule, verdict = rule_verdict(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("bound") >= least_rate, "allow").otherwise("block")
    return parts.join(broadcast_if_small(known), "host").select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, own).alias("verdict"),
        "rate",
        "bound",
    )
