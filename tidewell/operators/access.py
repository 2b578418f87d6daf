"""Role checks over access tuples with ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Roles by rank, and the least role that an action needs.
RANKS = {"reader": 1, "writer": 2, "admin": 3}
ACTIONS = {"read": "reader", "search": "reader", "write": "writer", "delete": "writer", "export": "reader", "admin": "admin"}


def check(requests: DataFrame, tuples: DataFrame, parents: DataFrame, depth: int = 3) -> DataFrame:
    """(request, allowed): for requests (request, subject, action, resource) by tuples (subject, relation, resource),
    whose relation is a role or 'deny:' and a role, on the resource and its ancestors (parents: resource, parent).

    A denial of the role needed, or of a higher one, wins anywhere on the way up; else the highest
    role granted on the way must reach the one needed. Unknown actions are denied.
    """
    rank = F.create_map(*[x for k, v in RANKS.items() for x in (F.lit(k), F.lit(v))])
    needed = F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.lit(RANKS[v]))])
    up = parents.groupBy("resource").agg(F.min("parent").alias("parent"))
    chain = level = requests.select("request", "subject", F.try_element_at(needed, F.col("action")).alias("needed"), F.col("resource").alias("node"))
    for _ in range(depth):  # a resource has no more than ``depth`` ancestors
        level = level.join(up.select(F.col("resource").alias("node"), "parent"), "node").select("request", "subject", "needed", F.col("parent").alias("node"))
        chain = chain.union(level.select(*chain.columns))
    role = F.regexp_replace("relation", "^deny:", "")
    known = tuples.select("subject", F.col("resource").alias("node"), F.col("relation").startswith("deny:").alias("denies"), F.try_element_at(rank, role).alias("role")).where("role is not null").distinct()
    met = chain.join(known, ["subject", "node"], "left").groupBy("request", "needed").agg(
        F.max(F.when(F.col("denies"), F.col("role"))).alias("denied"), F.max(F.when(~F.col("denies"), F.col("role"))).alias("granted")
    )
    ok = (F.col("granted") >= F.col("needed")) & F.coalesce(F.col("denied") < F.col("needed"), F.lit(True))
    return met.select("request", F.coalesce(ok, F.lit(False)).alias("allowed"))
