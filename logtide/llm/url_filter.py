"""URL filters by a sort-merge range join over reversed-host keys.

A rule (host, path) fits its host and all subdomains where the URL's path starts
with the rule's.  Under the key "reversed host labels, then path", that makes
each rule an interval of keys: every URL has one key for each level of its host,
and a rule covers exactly the keys of its own level that lie between its prefix
and the end of that prefix.  Intervals of one level nest or are disjoint, so a
sweep over the sorted keys keeps the open rules as a stack; a rule's end pops
back to the rule around it.  The longest rule that fits decides.

URLs are first collapsed to (host, path cut to the longest rule path), which
decides every rule; the sweep runs over those keys at the levels that have rules, in
windows salted by the number of keys so that no host gathers in one task, with each
rule's two events copied to every salt.

Defined results: a null URL or one without ``://`` has empty host and path, and
gets the default verdict; repeated rows are judged alike; an empty table gives an
empty result; other columns are ignored; of two rules with equal host and path
the first listed counts, and of two rules of equal length that fit the one with the
longer host, which is the only other case of a tie; an empty rule list leaves the
default to all.  Rules are arguments of ``judge``.

All of it is DataFrame expressions; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.common import lower_ascii, table

# Fixed values: (verdict, host, path).
BASE_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The method's own rules, asked only where no base rule fits, and the verdict where none of these fits either.
MORE_RULES = (("block", "casino-win.example.net", ""),)
DEFAULT = "allow"
#: Keys of one level that a salt is to hold at most, about; and the most salts.
KEYS_PER_SALT, MOST_SALTS = 50_000, 4096


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def reversed_host(host: Column) -> Column:
    """Labels of a host, outermost first."""
    return F.reverse(F.split(host, r"\."))


def _rules(spark, rules, weight: int) -> DataFrame:
    """Rules with their key, and the innermost rule around each (null: none) by looking up all shorter prefixes."""
    first: dict = {}
    for verdict, host, path in rules:
        first.setdefault((host, path), verdict)
    rows = F.array(*(F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("rule_host"), F.lit(p).alias("rule_path"), F.lit(weight).alias("weight")) for (h, p), v in first.items()))
    df = spark.range(1).select(F.inline(rows))  # literals: no rows pass through Python
    return df.select(
        F.concat_ws(".", reversed_host(F.col("rule_host"))).alias("level"),
        "rule_path",
        F.struct("weight", F.length(F.concat("rule_host", "rule_path")).alias("len"), F.length("rule_host").alias("host_len"), F.concat("rule_host", "rule_path").alias("rule"), "verdict", "rule_path").alias("top"),
    )


def _events(rules: DataFrame) -> DataFrame:
    """Sweep events: at a rule's prefix it becomes the top of the stack, past its last key the rule around it does."""
    shorter = rules.select("level", "rule_path", F.explode(F.transform(F.sequence(F.lit(0), F.length("rule_path")), lambda k: F.substring("rule_path", F.lit(1), k))).alias("outer")).where("outer <> rule_path")
    outer = rules.select("level", F.col("rule_path").alias("outer"), F.col("top").alias("around"))
    around = shorter.join(outer, ["level", "outer"]).groupBy("level", "rule_path").agg(F.max_by("around", F.length("outer")).alias("around"))
    both = rules.join(around, ["level", "rule_path"], "left")
    at = F.col("rule_path").cast("binary")
    push = both.select("level", at.alias("at"), F.struct("top").alias("event"))
    # no UTF-8 text has the byte FF, so prefix + FF sorts behind all that start with the prefix
    pop = both.select("level", F.concat(at, F.lit(b"\xff")).alias("at"), F.struct(F.col("around").alias("top")).alias("event"))
    return push.unionByName(pop)


def _sweep(keys: DataFrame, rules: DataFrame, depth: int, salts: int) -> DataFrame:
    """For every (host, short_path) the longest rule that fits, from one sorted pass over each level."""
    labels = F.slice(reversed_host(F.col("host")), 1, depth)
    levels = keys.withColumn("labels", labels).withColumn("i", F.explode(F.sequence(F.lit(1), F.size("labels"))))
    salt = F.pmod(F.xxhash64("host", "short_path"), F.lit(salts)).cast("int")
    urls = levels.select(F.concat_ws(".", F.slice("labels", F.lit(1), F.col("i"))).alias("level"), salt.alias("salt"), F.col("short_path").cast("binary").alias("at"), "host", "short_path", F.lit(1).alias("url"))
    # only levels that have a rule at all go into the sweep
    urls = urls.join(F.broadcast(rules.select("level").distinct()), "level", "left_semi")
    events = _events(rules).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = urls.unionByName(events.withColumn("url", F.lit(0)), allowMissingColumns=True)
    w = Window.partitionBy("level", "salt").orderBy("at", "url").rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.withColumn("on", F.last("event", ignorenulls=True).over(w)).where("url = 1")
    hits = swept.select("host", "short_path", F.col("on.top").alias("top")).where(F.col("top").isNotNull() & F.col("short_path").startswith(F.col("top.rule_path")))
    return hits.groupBy("host", "short_path").agg(F.max("top").alias("top"))


def judge(pages: DataFrame, rules=BASE_RULES, more_rules=MORE_RULES, default: str = DEFAULT) -> DataFrame:
    """Host, path, deciding rule and verdict of every row of ``pages`` (page_id, url)."""
    spark = pages.sparkSession
    every = (*rules, *more_rules)
    cut = max((len(p) for _, _, p in every), default=0)
    depth = max((h.count(".") + 1 for _, h, _ in every), default=1)
    urls = pages.select(pages["page_id"].alias("page_id"), host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    urls = urls.withColumn("short_path", F.substring("path", 1, cut))
    keys = table(urls.select("host", "short_path").distinct(), "url-keys")
    salts = min(MOST_SALTS, max(1, -(-keys.count() // KEYS_PER_SALT), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    swept = [_sweep(keys, _rules(spark, r, weight), depth, salts) for weight, r in ((1, rules), (0, more_rules)) if r]
    out = urls
    for i, s in enumerate(swept):
        out = out.join(s.withColumnRenamed("top", f"top{i}"), ["host", "short_path"], "left")
    top = F.coalesce(*(F.col(f"top{i}") for i in range(len(swept)))) if swept else None
    if top is None:
        return out.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return out.select(
        "page_id",
        "host",
        "path",
        F.when(top["weight"] == 1, top["rule"]).alias("rule"),
        F.coalesce(top["verdict"], F.lit(default)).alias("verdict"),
    )
