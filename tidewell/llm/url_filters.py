"""URL filters by a sort-merge range join over reversed-host keys (DataFrame functions only).

A rule is (host, path, verdict). Its host, label by label from the right and closed
by a dot ("example.com" -> "com.example."), is a prefix of the keys of that host and
of all its subdomains, so a rule covers one interval of the sorted keys. Two such
intervals nest or are apart. A sweep over the sorted keys therefore keeps a stack of
the active rules: at every rule's start its chain of enclosing rules is known, and a
key finds its stack as the chain of the last start before it, less the rules whose
interval has ended. The sweep runs over distinct hosts, range-partitioned; each range
takes over the chain that is open at its first key. URLs then meet their host's stack
in an equi-join and the longest rule whose path begins the URL's path decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_CHAIN = "array<struct<key:string,hi:string,rule:string,path:string,verdict:string,len:int>>"


def url_host(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, _SPLIT, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """From the host's end up to '?', '#' or end; empty without '://'."""
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def reversed_key(host: Column) -> Column:
    """'www.example.com' -> 'com.example.www.'"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _rule_chains(rules: DataFrame) -> DataFrame:
    """One row per rule host: its key and all rules that enclose it or are its own, shortest first."""
    r = (
        rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
        .select(F.translate("host", _UPPER, _LOWER).alias("host"), "path", "verdict")
        .groupBy("host", "path")
        .agg(F.max("verdict").alias("verdict"))  # one verdict for repeated rules: block wins
        .withColumn("key", reversed_key(F.col("host")))
    )
    own = r.select(
        "key",
        F.struct(
            "key", F.concat(F.expr("substr(key, 1, length(key) - 1)"), F.lit("/")).alias("hi"), F.concat("host", "path").alias("rule"), "path", "verdict",
            F.length(F.concat("host", "path")).alias("len"),
        ).alias("r"),
    )
    # a key's enclosing keys are its label prefixes: as many rows as the key has labels
    prefixes = r.select("key").distinct().withColumn("up", F.expr("explode(transform(sequence(1, size(split(key, '[.]')) - 1), i -> concat(substring_index(key, '.', i), '.')))"))
    return (
        prefixes.join(own.withColumnRenamed("key", "up"), "up")
        .groupBy("key")
        .agg(F.sort_array(F.collect_list("r")).cast(_CHAIN).alias("chain"))
    )


def host_stacks(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, stack) for each distinct ``host``, by the sorted sweep."""
    chains = _rule_chains(rules)
    keys = hosts.select(reversed_key(F.col("host")).alias("key"), "host", F.lit(1).alias("kind"), F.lit(None).cast(_CHAIN).alias("chain"))
    starts = chains.select("key", F.lit(None).cast("string").alias("host"), F.lit(0).alias("kind"), "chain")
    parts = int(hosts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written once, so that the ranges stay as they are if an executor is lost
    dealt = cut(keys.unionByName(starts).repartitionByRange(parts, "key").withColumn("range", F.spark_partition_id()))
    # what is open at the start of each range: the last rule that started before it (one row per range)
    opened = dealt.groupBy("range").agg(F.max_by("chain", F.when(F.col("kind") == 0, F.col("key"))).alias("last"))
    carried = opened.withColumn("carry", F.last("last", True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    sweep = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.join(carried, "range").withColumn("active", F.coalesce(F.last("chain", True).over(sweep), "carry"))
    return swept.where("kind = 1").select(
        "host", F.filter(F.coalesce("active", F.array().cast(_CHAIN)), lambda r: (F.col("key") >= r["key"]) & (F.col("key") < r["hi"])).alias("stack")
    )


def url_filter(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to ``pages``.

    The longest fitting rule decides; without one, rule is null and verdict is
    ``default``. A null url, or one without '://', has an empty host and path. Rules
    with a null host or path are left out; repeated rules count once (block wins).
    Columns named host, path, rule or verdict are replaced.
    """
    p = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url)), "path": url_path(F.col(url))})
    stacks = host_stacks(p.select("host").distinct(), rules)
    fits = F.filter("stack", lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["len"].alias("len"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return (
        p.join(stacks, "host", "left")
        .withColumn("_best", best)
        .withColumns({"rule": F.col("_best.rule"), "verdict": F.coalesce(F.col("_best.verdict"), F.lit(default))})
        .drop("_best", "stack")
    )


#: The rules of the query op1.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rules_frame(spark) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages, rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH p AS (
  SELECT page_id,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE
      translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS host,
    CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE
      regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END AS path
  FROM pages),
r(rhost, rpath, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, v,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS n
  FROM p LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE n = 1
"""
