"""URL filters by empirical-Bayes host reputation, in DataFrame functions only.

Rules (``host/path``, allow or block) decide what they fit.  The pages they decide are the
labelled outcomes of the method, and further outcomes may be given.  Blocked shares are shrunk
from host to registered domain to suffix to all pages through beta-binomial priors: a name's
prior mean is its parent's posterior mean over the *other* children's outcomes, so no outcome
counts twice, and the prior's strength is estimated for each level from the outcomes, by the
method of moments: the spread of children around their parents beyond binomial chance.  A page
that no rule fits is blocked when the lower bound of its host's posterior (mean less ``Z``
standard deviations) exceeds ``LIMIT``; a host without outcomes has its nearest relative's
posterior.

Only counts for each name are shuffled, aggregated before the shuffle; a host with a third of
all pages is one row, and hosts come back to their pages by a broadcast behind a count.

A suffix is the last label, or the last two where the last has two letters and the one before
is a usual second level (co.uk); a host that ends in digits (an address) has no relatives. User
names and ports don't count for a host's relatives.

Defined results: a null url, or one without ``://``, has empty host and path, and, like a
host without any labelled relative, is judged by all outcomes; without outcomes nothing is
blocked; of rules that fit the longest wins, of equally long ones the alphabetically first;
repeated rows are judged each time and their outcomes count each time; urls are read whole;
other columns of pages, of any name, are not read. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.kernel import materialize

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
#: Labels that make a suffix with a country's two letters after them.
SECOND = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
#: Least and largest strength of a prior in outcomes, and the one of a level that shows nothing.
WEAK, STRONG, UNSEEN = 1.0, 1000.0, 10.0
#: Outcomes (blocked, allowed) that stand above all pages: a uniform prior.
UNIFORM = (1.0, 1.0)
Z, LIMIT = 1.64, 0.5
#: Names of at most this many rows (about 60 MB) are broadcast; more are joined by a shuffle.
BROADCAST_NAMES = 500_000
LEVELS = ("suffix", "domain", "host")


def parts(url: str = "url") -> tuple[str, str]:
    """SQL for the host (A-Z lower-cased) and the path of a url."""
    there = f"coalesce(instr({url}, '://'), 0) > 0"
    rest = f"substring({url}, instr({url}, '://') + 3)"
    host = f"translate(regexp_extract({rest}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = f"regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1)"
    return f"if({there}, {host}, '')", f"if({there}, {path}, '')"


def fits(rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """Columns: the longest rule that fits (host, path), and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        host, slash, path = text.partition("/")
        ok = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(ok, text).otherwise(rule), F.when(ok, said).otherwise(verdict)
    return rule, verdict


def names() -> dict[str, Column]:
    """The suffix and the registered domain of ``host``."""
    bare = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    labels = F.split(bare, r"\.")
    last, size = F.element_at(labels, -1), F.size(labels)
    tail = lambda n: F.array_join(F.slice(labels, -F.least(size, F.lit(n)), n), ".")
    long = (size >= 2) & last.rlike("^[a-z][a-z]$") & F.try_element_at(labels, F.lit(-2)).isin(*SECOND)
    address = last.rlike("^[0-9]")
    suffix = F.when(address, F.col("host")).when(long, tail(2)).otherwise(last)
    return {"suffix": suffix, "domain": F.when(address, F.col("host")).when(long, tail(3)).otherwise(tail(2))}


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_NAMES else df


def strength(children: DataFrame, parent: list[str]) -> float:
    """The strength of the prior that children (k, n and parent columns) share: 1 / rho - 1 of a beta-binomial with a mean for each parent, by moments."""
    k, n = F.col("k"), F.col("n")
    sums = children.groupBy(*parent).agg(F.sum("k").alias("pk"), F.sum("n").alias("pn"), F.count("*").alias("c"), F.sum(k * k / n).alias("kk"), F.sum(n * n).alias("nn"))
    v, free = F.expr("pk / pn * (1 - pk / pn)"), F.col("c") - 1
    beyond = F.sum(F.expr("kk - pk * pk / pn") - v * free)
    room = F.sum(v * (F.expr("pn - nn / pn") - free))
    # One row of two numbers comes to the driver.
    over, most = sums.agg(beyond, room).first()
    if not most or most <= 0:
        return UNSEEN
    rho = over / most
    return round(min(STRONG, max(WEAK, 1 / rho - 1)), 6) if rho > 0 else STRONG


def reputation(outcomes: DataFrame) -> tuple[dict[str, DataFrame], tuple[float, float]]:
    """For each level a table (name, a, b) of posteriors, and that of all pages, from outcomes (host, blocked 0/1)."""
    own = outcomes.groupBy("host").agg(F.sum(F.col("blocked").cast("double")).alias("k"), F.count("blocked").cast("double").alias("n")).where("n > 0")
    host = materialize(own.withColumns(names()), "hosts")
    total = [F.sum("k").alias("k"), F.sum("n").alias("n")]
    domain = materialize(host.groupBy("domain", "suffix").agg(*total), "domains")
    suffix = materialize(domain.groupBy("suffix").agg(*total), "suffixes")
    k, n = suffix.agg(F.coalesce(F.sum("k"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    above = {"suffix": [], "domain": ["suffix"], "host": ["domain"]}
    tables = {"suffix": suffix, "domain": domain, "host": host}
    s = {level: strength(tables[level], above[level]) for level in LEVELS}
    mean = {"suffix": (F.lit(k) - F.col("k") + UNIFORM[0]) / (F.lit(n) - F.col("n") + sum(UNIFORM))}
    out: dict[str, DataFrame] = {}
    for level, parent in zip(LEVELS, (None, *LEVELS), strict=False):
        df = tables[level]
        if parent is not None:
            up = tables[parent].select(parent, F.col("k").alias("pk"), F.col("n").alias("pn"), F.col("m").alias("pm"))
            df = df.join(_small(up), parent)
            mean[level] = (F.col("pk") - F.col("k") + s[parent] * F.col("pm")) / (F.col("pn") - F.col("n") + s[parent])
        tables[level] = materialize(df.withColumn("m", mean[level]).select(*tables[level].columns, "m"), level)
        m = F.col("m")
        out[level] = tables[level].select(level, (F.col("k") + s[level] * m).alias("a"), (F.col("n") - F.col("k") + s[level] * (1 - m)).alias("b"))
    return out, (k + UNIFORM[0], n - k + UNIFORM[1])


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, outcomes: DataFrame | None = None) -> DataFrame:
    """The op8 row of every page (page_id, url): host, path, rule, verdict and the posterior bound; ``outcomes`` (host, blocked) are further labelled pages."""
    host, path = parts()
    rule, said = fits(rules)
    parsed = pages.select("page_id", "url").withColumns({"host": F.expr(host), "path": F.expr(path)}).withColumn("rule", rule).withColumn("said", said)
    labelled = parsed.where("said is not null").select("host", F.expr("cast(said = 'block' as int)").alias("blocked"))
    if outcomes is not None:
        labelled = labelled.union(outcomes.select("host", "blocked"))
    known, whole = reputation(labelled)
    # One row for each host: its own posterior, or that of its nearest labelled relative.
    hosts = parsed.select("host").distinct().withColumns(names())
    for level in LEVELS:
        hosts = hosts.join(_small(known[level].withColumnsRenamed({"a": f"a_{level}", "b": f"b_{level}"})), level, "left")
    a, b = (F.coalesce(*(F.col(f"{k}_{level}") for level in reversed(LEVELS)), F.lit(whole[i])) for i, k in enumerate("ab"))
    mean = F.col("a") / (F.col("a") + F.col("b"))
    bound = mean - Z * F.sqrt(mean * (1 - mean) / (F.col("a") + F.col("b") + 1))
    judged = materialize(hosts.select("host", a.alias("a"), b.alias("b")).select("host", F.round(bound, 9).alias("bound")), "judged")
    return parsed.join(_small(judged), "host").select(
        "page_id", "host", "path", "rule", F.coalesce("said", F.expr(f"if(bound > {LIMIT}, 'block', 'allow')")).alias("verdict"), "bound"
    )


def oracle() -> str:
    """DuckDB SQL for the op8 query."""
    second = ", ".join(f"'{x}'" for x in SECOND)
    rules = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '/{p}') THEN '{t}|{v}'" for t, v in sorted(RULES, key=lambda r: (-len(r[0]), r[0])) for h, _, p in [t.partition("/")]
    )

    def moments(table: str, group: str) -> str:
        inner = f"SELECT sum(k) AS pk, sum(n) AS pn, count(*) AS c, sum(k * k / n) AS kk, sum(n * n) AS nn FROM {table} {group}"
        sums = f"SELECT sum(kk - pk * pk / pn - v * (c - 1)) AS o, sum(v * (pn - nn / pn - (c - 1))) AS r FROM (SELECT *, pk / pn * (1 - pk / pn) AS v FROM ({inner}))"
        return f"SELECT CASE WHEN coalesce(r, 0) <= 0 THEN {UNSEEN} WHEN o <= 0 THEN {STRONG} ELSE round(least({STRONG}, greatest({WEAK}, r / o - 1)), 6) END AS s FROM ({sums})"

    return f"""
WITH u AS (SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, CASE WHEN rest IS NULL THEN '' ELSE translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
  CASE WHEN rest IS NULL THEN '' ELSE regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) END AS path FROM u),
r AS (SELECT *, CASE {rules} END AS hit FROM p),
h AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', ''), '.') AS l FROM (SELECT DISTINCT host FROM r)),
h2 AS (SELECT *, regexp_matches(l[-1], '^[0-9]') AS addr, len(l) >= 2 AND regexp_matches(l[-1], '^[a-z][a-z]$') AND l[-2] IN ({second}) AS long FROM h),
h3 AS (SELECT host, CASE WHEN addr THEN host WHEN long THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix,
  CASE WHEN addr THEN host WHEN long THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS dom FROM h2),
c AS (SELECT host, suffix, dom, sum(CASE WHEN hit LIKE '%|block' THEN 1.0 ELSE 0.0 END)::DOUBLE AS k, count(*)::DOUBLE AS n FROM r JOIN h3 USING (host) WHERE hit IS NOT NULL GROUP BY ALL),
d AS (SELECT dom, suffix, sum(k) AS k, sum(n) AS n FROM c GROUP BY ALL),
s AS (SELECT suffix, sum(k) AS k, sum(n) AS n FROM d GROUP BY ALL),
g AS (SELECT coalesce(sum(k), 0) AS k, coalesce(sum(n), 0) AS n FROM s),
ss AS ({moments('s', '')}), sd AS ({moments('d', 'GROUP BY suffix')}), sh AS ({moments('c', 'GROUP BY dom')}),
ms AS (SELECT s.*, (g.k - s.k + {UNIFORM[0]}) / (g.n - s.n + {sum(UNIFORM)}) AS m FROM s, g),
md AS (SELECT d.*, (ms.k - d.k + ss.s * ms.m) / (ms.n - d.n + ss.s) AS m FROM d JOIN ms USING (suffix), ss),
mh AS (SELECT c.*, (md.k - c.k + sd.s * md.m) / (md.n - c.n + sd.s) AS m FROM c JOIN md USING (dom), sd),
sp AS (SELECT suffix, k + s * m AS a, n - k + s * (1 - m) AS b FROM ms, ss),
dp AS (SELECT dom, k + s * m AS a, n - k + s * (1 - m) AS b FROM md, sd),
hp AS (SELECT host, k + s * m AS a, n - k + s * (1 - m) AS b FROM mh, sh),
j AS (SELECT h3.host, coalesce(hp.a, dp.a, sp.a, g.k + {UNIFORM[0]}) AS a, coalesce(hp.b, dp.b, sp.b, g.n - g.k + {UNIFORM[1]}) AS b
  FROM h3 LEFT JOIN hp USING (host) LEFT JOIN dp USING (dom) LEFT JOIN sp USING (suffix) CROSS JOIN g),
q AS (SELECT host, round(a / (a + b) - {Z} * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)), 9) AS bound FROM j)
SELECT page_id, host, path, nullif(split_part(hit, '|', 1), '') AS rule,
  CASE WHEN hit IS NOT NULL THEN split_part(hit, '|', 2) WHEN bound > {LIMIT} THEN 'block' ELSE 'allow' END AS verdict, bound
FROM r JOIN q USING (host)"""
