"""URL filtering: explicit rules first, else the reputation of the host, shrunk by empirical Bayes.

Labelled page outcomes are counted per host, registered domain (last two labels) and suffix (last label). At each level
a beta-binomial prior is centred on the level above; its strength follows from how much the groups of that level differ
(method of moments). A host is blocked where even the upper posterior bound of its share of good pages is too low.

Null urls and urls without ``://`` have an empty host and path and are judged by the prior of all pages; null or
unlabelled outcomes count nothing; an id labelled twice counts twice; repeated rows are judged alike; without any label
every prior is 1/2; an empty table gives no rows; urls are read whole, however long. Only named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.llm.common import stored

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), LETTERS, LETTERS.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; of equally long ones a blocking one.

    A rule is ``(verdict, "host/path")``: it fits its host and all subdomains where the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def _strength(groups: DataFrame, n: str, good: str, name: str) -> DataFrame:
    """One row: how many outcomes the prior of this level weighs, from the spread of the groups' shares."""
    sums = groups.where(F.col(n) > 0).agg(
        F.count("*").cast("double").alias("g"), F.sum(n).cast("double").alias("n"), F.sum(good).cast("double").alias("s"),
        F.sum(F.col(n) * F.col(n)).cast("double").alias("nn"), F.sum(F.col(good) * F.col(good) / F.col(n)).alias("ss"))
    m = F.col("s") / F.col("n")
    spread = F.col("ss") - F.col("s") * m
    scale = m * (1 - m)
    room = F.col("n") - F.col("nn") / F.col("n") - (F.col("g") - 1)
    rho = (spread - scale * (F.col("g") - 1)) / (scale * room)
    usable = (F.col("g") > 1) & (scale > 0) & (room > 1e-9)
    bounded = F.when(usable, F.greatest(F.lit(0.001), F.least(F.lit(0.9), rho))).otherwise(0.001)
    return sums.select((1 / bounded - 1).alias(name))


def host_reputation(pages: DataFrame, outcomes: DataFrame, z: float = 1.645) -> DataFrame:
    """``host, posterior, upper`` for every host of ``pages``; ``outcomes`` has ``page_id`` and ``good`` (0 or 1)."""
    hosts = pages.select("page_id", host_of(F.col("url")).alias("host"))
    labels = outcomes.where(F.col("good").isin(0, 1)).groupBy("page_id").agg(
        F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"))
    summed = hosts.join(labels, "page_id", "left").groupBy("host").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    # seven steps read the hosts: they are worked out once
    by_host = stored(summed, "hosts").withColumns(
        {"domain": F.substring_index("host", ".", -2), "suffix": F.substring_index("host", ".", -1)})
    by_domain = by_host.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("good").alias("dg"))
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dg").alias("sg"))
    overall = by_suffix.agg(((F.coalesce(F.sum("sg"), F.lit(0)) + 1) / (F.coalesce(F.sum("sn"), F.lit(0)) + 2)).alias("m"))
    one = F.broadcast(  # four numbers
        overall.join(_strength(by_suffix, "sn", "sg", "ks")).join(_strength(by_domain, "dn", "dg", "kd"))
        .join(_strength(by_host, "n", "good", "kh")).withColumn("one", F.lit(1)))
    levels = (
        by_host.join(by_domain, ["domain", "suffix"]).join(by_suffix, "suffix").withColumn("one", F.lit(1)).join(one, "one"))
    suffix = (F.col("sg") + F.col("ks") * F.col("m")) / (F.col("sn") + F.col("ks"))
    domain = (F.col("dg") + F.col("kd") * suffix) / (F.col("dn") + F.col("kd"))
    a = F.col("good") + F.col("kh") * domain
    b = F.col("n") - F.col("good") + F.col("kh") * (1 - domain)
    return levels.select("host", (a / (a + b)).alias("posterior"), (
        a / (a + b) + z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))).alias("upper"))


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], least: float = 0.5) -> DataFrame:
    """Host, path, fitting rule and verdict of every page; without a rule, block where ``upper < least``.

    Hosts are summed per task before they are shuffled. A host that holds a large share of the pages is a skewed join
    key, which adaptive execution splits; only four numbers are broadcast.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("upper") < least, "block").otherwise("allow")
    return parsed.join(host_reputation(pages, outcomes), "host").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"),
        F.round("posterior", 6).alias("good_share"))
