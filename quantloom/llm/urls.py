"""URL filter: rules first, then a character language-model ratio. Native DataFrame functions only.

Two smoothed variable-order Markov models of characters, one of the URLs that the rules allow and one of those they block,
are interpolated from order `order` down to none (Witten-Bell): p(c | context) = (n(context c) + t(context) p(c | shorter))
/ (n(context) + t(context)), t being the number of different characters seen after the context; an unseen context passes
to the shorter one. The mean over a URL's characters of log p_allowed - log p_blocked is its score; the threshold lies
between the two classes' mean scores, at as many of their standard deviations from either.

All orders come from one count of (order + 1)-grams by class, pre-aggregated before its shuffle. The tables after that hold
different grams, not URLs, and a gram's log ratio is computed once for the collection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialize

# (host, path, verdict); the longest rule that fits wins.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
ORDER = 3
PAD, END = "\u0002", "\u0003"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(pages: DataFrame) -> DataFrame:
    """pages(page_id, url) -> page_id, url, host, path."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.substring(F.col("url"), at + 3, F.length("url"))).otherwise("")
    parts = pages.select("page_id", "url", F.coalesce(rest, F.lit("")).alias("_rest"))
    host = F.regexp_extract("_rest", r"^[^/?#]*", 0)
    tail = F.substring(F.col("_rest"), F.length(host) + 1, F.length("_rest"))
    return parts.select("page_id", "url", F.translate(host, _UPPER, _LOWER).alias("host"), F.regexp_extract(tail, r"^[^?#]*", 0).alias("path"))


def with_rule(parts: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """parts(host, path, ...) -> with rule and rule_verdict, null where no rule fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return parts.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def with_grams(urls: DataFrame, n: int) -> DataFrame:
    """A row for each character of url and its end mark: the n-gram that ends there. Outer, so that Spark does not infer a
    filter on the array and evaluate it below the projections once more."""
    letters = urls.withColumn("_c", F.split(F.concat(F.lit(PAD * (n - 1)), F.coalesce("url", F.lit("")), F.lit(END)), ""))
    grams = F.transform(F.sequence(F.lit(0), F.size("_c") - n), lambda i: F.concat(*[F.get(F.col("_c"), i + j) for j in range(n)]))
    return letters.select(*urls.columns, F.explode_outer(grams).alias("gram"))


def log_ratios(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """counts(gram, allow, block): of every gram of order + 1 characters -> gram, ratio."""
    table = counts
    for c in ("allow", "block"):
        # From no context up: the probability of a gram's last character after its last k characters of context.
        letters = counts.groupBy(F.substring("gram", order + 1, 1).alias("s")).agg(F.sum(c).alias("n"))
        # Every character of the collection may occur: one part more for any other.
        size = letters.agg((F.count("*") + 1).alias("a"), F.sum("n").alias("all"), F.sum((F.col("n") > 0).cast("int")).alias("t")).first()
        total, kinds = size["all"] or 0, size["t"] or 0
        p = letters.select("s", ((F.col("n") + kinds / size["a"]) / (total + kinds) if total else F.lit(1 / size["a"])).alias("p"))
        for k in range(1, order + 1):
            grams = counts.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("s")).agg(F.sum(c).alias("n"))
            contexts = grams.groupBy(F.substring("s", 1, k).alias("ctx")).agg(F.sum("n").alias("all"), F.sum((F.col("n") > 0).cast("int")).alias("t"))
            lower = p.select(F.col("s").alias("shorter"), F.col("p").alias("p0"))
            both = grams.withColumn("ctx", F.substring("s", 1, k)).withColumn("shorter", F.substring("s", 2, k)).join(contexts, "ctx").join(lower, "shorter")
            p = both.select("s", F.when(F.col("all") > 0, (F.col("n") + F.col("t") * F.col("p0")) / (F.col("all") + F.col("t"))).otherwise(F.col("p0")).alias("p"))
        table = table.join(p.select(F.col("s").alias("gram"), F.log("p").alias(f"log_{c}")), "gram")
    return table.select("gram", (F.col("log_allow") - F.col("log_block")).alias("ratio"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, score; a row for a row of pages.

    verdict: the rule's, else allow where score >= the calibrated threshold and block below it. A null URL is an empty one.
    If the rules allow no URL or block none, there is no ratio to calibrate and URLs without a rule are allowed. Rows that
    repeat a page_id or have none are judged one by one. Empty pages give an empty result; other columns are ignored.
    """
    parts = with_rule(split_url(pages.select("page_id", "url")), rules)
    # Equal URLs are scored once.
    urls = parts.groupBy(F.coalesce("url", F.lit("")).alias("url")).agg(F.count("*").alias("times"), F.first("rule_verdict").alias("rule_verdict"))
    # Dealt by number: a URL becomes a row for each of its characters, which few bytes do not show.
    spark = pages.sparkSession
    urls = materialize(urls.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))), "urls-distinct")
    grams = with_grams(urls, order + 1)
    n = {c: F.sum(F.when(F.col("rule_verdict") == c, F.col("times")).otherwise(0)).alias(c) for c in ("allow", "block")}
    counts = materialize(grams.groupBy("gram").agg(n["allow"], n["block"]), "urls-grams")
    ratios = materialize(log_ratios(counts, order), "urls-ratios")
    long = with_grams(urls, order + 1).join(broadcast_if_small(ratios, 64), "gram")
    scored = materialize(long.groupBy("url", "rule_verdict", "times").agg(F.round(F.avg("ratio"), 9).alias("score")), "urls-scored")
    t, s = F.col("times"), F.col("score")
    facts = {}
    for c in ("allow", "block"):
        mine = F.col("rule_verdict") == c
        facts |= {f"n_{c}": F.sum(F.when(mine, t)), f"m_{c}": F.sum(F.when(mine, t * s)), f"q_{c}": F.sum(F.when(mine, t * s * s))}
    f = scored.agg(*[v.alias(k) for k, v in facts.items()]).first()
    threshold = float("-inf")
    if f["n_allow"] and f["n_block"]:
        mean = {c: f[f"m_{c}"] / f[f"n_{c}"] for c in ("allow", "block")}
        sd = {c: max(f[f"q_{c}"] / f[f"n_{c}"] - mean[c] ** 2, 0) ** 0.5 for c in ("allow", "block")}
        spread = sd["allow"] + sd["block"]
        threshold = (mean["allow"] * sd["block"] + mean["block"] * sd["allow"]) / spread if spread else (mean["allow"] + mean["block"]) / 2
    own = parts.join(scored.select(F.col("url").alias("_url"), "score"), F.coalesce("url", F.lit("")) == F.col("_url"))
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return own.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
