"""URL filters by association rules, in DataFrame operations only.

Spark's FP-growth mines combinations of URL tokens together with the label of the page; rules "tokens -> bad" that
pass confidence and support are kept and matched through an inverted index from token to rules. Given rules of
host and path, the longest that fits decides instead.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veldspar.llm.common import LOWER, spread_join, store, table

#: Host and path rules: (host, path, verdict).
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
BAD = "label:bad"
BROADCAST_RULES = 20_000


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end, A-Z in lower case; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), *LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to a question mark, hash or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest host and path rule that fits, null without one.

    A rule fits its host and the hosts under it, where the path starts with the rule's path. Rules are a short literal list.
    """
    rule = verdict = F.lit(None).cast("string")
    for name, start, decided in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        rule = F.when(fits, F.lit(name + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(decided)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: scheme, host and each domain above, words of the path by depth (numbers by their length), ending, query keys, fragment."""
    parts = F.split(host, r"\.")
    domains = F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda i: i <= F.size(parts)), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    steps = F.filter(F.split(path, r"[/._-]+"), lambda x: F.length(x) > 0)
    named = F.transform(steps, lambda x, i: F.concat(F.lit("path"), i.cast("string"), F.lit(":"), F.when(x.rlike(r"^[0-9]+$"), F.concat(F.lit("#"), F.length(x).cast("string"))).otherwise(F.lower(x))))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), 1), lambda x: F.concat(F.lit("key:"), F.lower(x)))
    rest = F.array(
        F.concat(F.lit("scheme:"), F.lower(F.substring_index(F.coalesce(url, F.lit("")), ":", 1))),
        F.when(path.endswith("/"), F.lit("slash")).otherwise(F.lit("no slash")),
        F.when(F.coalesce(url, F.lit("")).contains("#"), F.lit("fragment")).otherwise(F.lit("no fragment")),
    )
    return F.array_distinct(F.concat(domains, named, keys, rest))


_RULES = "rule long, n int, confidence double, support double, classes array<string>"


def mine(marked: DataFrame, support: float = 0.001, confidence: float = 0.8, least_rows: int = 10) -> tuple[DataFrame, DataFrame]:
    """Rules (rule, n, confidence, support, classes) with the consequent BAD, and the members (class, token) of the classes, from rows (tokens, bad).

    Tokens that are in exactly the same rows form a class, named by its least token: rules over any of them have the same
    support and confidence, so only classes are mined, and a rule matches where each of its classes has a token. A class
    in all rows can't change a rule's figures and is a rule by itself at most. Rules need ``support`` of the rows, and at
    least ``least_rows`` bad ones, behind them; they may be of any length. Nested but unequal token sets are mined as they
    are. Without bad rows there are no rules.
    """
    spark = marked.sparkSession
    rows = store(marked.select(F.monotonically_increasing_id().alias("b"), "tokens", "bad").where(F.size("tokens") > 0), "baskets")
    total, bad_rows = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("bad").cast("int")), F.lit(0))).first()
    none = spark.createDataFrame([], _RULES), spark.createDataFrame([], "class string, token string")
    if not bad_rows:
        return none
    least = max(float(least_rows), support * total)
    pairs = rows.select("b", "bad", F.explode(F.array_distinct("tokens")).alias("token"))
    # A rule "tokens -> BAD" counts rows with all its tokens, so only tokens that are frequent among bad rows can be in one.
    often = pairs.groupBy("token").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("bad").cast("int")).alias("n_bad"),
        F.sum(F.xxhash64("b").cast("decimal(38,0)")).alias("s1"), F.bit_xor(F.xxhash64("b", F.lit(1))).alias("s2"),
    ).where((F.col("n_bad") >= least) & F.col("token").isNotNull())
    same = Window.partitionBy("n", "s1", "s2")
    members = store(often.select(F.min("token").over(same).alias("class"), "token", "n", "n_bad"), "classes")
    names = members.where((F.col("token") == F.col("class")) & (F.col("n") < total)).select("token")
    small = members.count() <= BROADCAST_RULES
    chosen = pairs.join(F.broadcast(names), "token") if small else spread_join(store(pairs, "tokens"), names, ["token"])
    items = chosen.groupBy("b", "bad").agg(F.collect_list("token").alias("items"))
    items = store(items.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items")), "items")
    whole = members.where((F.col("token") == F.col("class")) & (F.col("n") == total))
    found = whole.select(F.array("class").alias("classes"), F.col("n").alias("freq"), F.col("n_bad").alias("both"))
    if not items.isEmpty():
        sets = FPGrowth(itemsCol="items", minSupport=min(1.0, least / items.count()), minConfidence=confidence).fit(items).freqItemsets
        sets = store(sets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
        with_bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("both"))
        found = found.unionByName(with_bad.join(sets, "items").select(F.col("items").alias("classes"), "freq", "both"))
    rules = found.withColumn("confidence", F.col("both") / F.col("freq")).where((F.col("confidence") >= confidence) & (F.col("both") >= least))
    rules = rules.select(F.xxhash64("classes").alias("rule"), F.size("classes").alias("n"), "confidence", (F.col("both") / total).alias("support"), "classes")
    return store(rules, "rules"), members.select("class", "token")


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, **options: float) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row of ``pages``.

    A page is labelled bad if ``labels`` marks its id as of quality 0 or toxic. Verdict: of the longest host and path
    rule; else block if a mined rule matches (score: its greatest confidence), else allow. A null url or one
    without :// has empty host and path; null ids and repeated rows get a row each; without labels nothing is
    mined and only the given rules block. Other columns are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rows = pages.select(F.col("page_id"), F.col("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("tokens", tokens_of(F.col("url"), F.col("host"), F.col("path"))).withColumn("_row", F.monotonically_increasing_id())
    rows = store(rows.drop("url"), "urls")
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    found, members = mine(rows.join(marks.where(F.col("bad").isNotNull()), "page_id").select("tokens", "bad"), **options)
    index = store(found.select("rule", "n", "confidence", F.explode("classes").alias("class")).join(members, "class"), "index")
    probes = rows.select("_row", F.explode("tokens").alias("token"))
    if index.count() <= BROADCAST_RULES:
        hits = probes.join(F.broadcast(index), "token")
    else:
        hits = spread_join(store(probes, "probes"), index, ["token"])
    hits = hits.groupBy("_row", "rule", "class").agg(F.first("n").alias("_n"), F.first("confidence").alias("_c"))
    hits = hits.groupBy("_row", "rule").agg(F.count(F.lit(1)).alias("_m"), F.first("_n").alias("_n"), F.first("_c").alias("_c"))
    matched = hits.where(F.col("_m") == F.col("_n")).groupBy("_row").agg(F.max("_c").alias("score"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    out = rows.drop("tokens").join(matched, "_row", "left")
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score").isNotNull(), "block").otherwise("allow")).alias("verdict"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))
