"""Filters as predicates, listings and index maintenance."""

from __future__ import annotations

import functools
import operator
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names under which a scope may be asked for.
ALIASES = {
    "notes": ("global_notes", "project_notes"),
    "global": ("global_notes",),
    "project": ("project_notes",),
    "raw": ("raw_document", "raw_eval"),
    "wiki": ("wiki",),
    "sources": ("sources",),
}


def compile(wanted: dict) -> Column:
    """One predicate for a request's filters: path_prefix, paths, tags (all of), session_ids (any of), scope, project,
    date_from and date_to (rows without a date fail). Catalyst pushes what it can to the scan."""
    tests = [F.lit(True)]
    if wanted.get("path_prefix"):
        tests.append(F.col("path").startswith(wanted["path_prefix"]))
    if wanted.get("paths"):
        tests.append(F.col("path").isin(wanted["paths"]))
    if wanted.get("tags"):
        tests.append(F.size(F.array_except(F.array(*[F.lit(t) for t in wanted["tags"]]), "tags")) == 0)
    if wanted.get("session_ids"):
        tests.append(F.col("session_id").isin(wanted["session_ids"]))
    if wanted.get("scope"):
        scope = wanted["scope"]
        known = scope in ALIASES
        test = F.col("scope").isin(*ALIASES.get(scope, (scope,)))
        tests.append(test | (F.coalesce("scope", F.lit("")) == "") if known else test)  # a row without scope passes a known name
    if wanted.get("project"):
        tests.append((F.col("scope") == "global_notes") | (F.col("project") == wanted["project"]))
    if wanted.get("date_from"):
        tests.append(F.coalesce(F.col("modified") >= F.lit(wanted["date_from"]).cast("date"), F.lit(False)))
    if wanted.get("date_to"):
        tests.append(F.coalesce(F.col("modified") <= F.lit(wanted["date_to"]).cast("date"), F.lit(False)))
    return functools.reduce(operator.and_, tests)


def project_at_index(project: str, scope: str) -> Column:
    """The index layer's rule: global rows pass only if notes are asked for."""
    own = F.col("project") == project
    return own | (F.col("scope") == "global_notes") if scope == "notes" else own


def superseded() -> Column:
    return F.trim(F.coalesce("superseded_by", F.lit(""))) != ""


def field(value: Column, op: str, want) -> Column:
    """eq, ne, in, nin, gt, gte, lt, lte on a JSON value; numbers compare with numbers only, and a value of another type fails."""
    numbers = [want] if not isinstance(want, list) else want
    typed = value.try_cast("double") if all(isinstance(x, (int, float)) for x in numbers) else value
    tests = {
        "eq": lambda: typed == want, "ne": lambda: typed != want, "in": lambda: typed.isin(want), "nin": lambda: ~typed.isin(want),
        "gt": lambda: typed > want, "gte": lambda: typed >= want, "lt": lambda: typed < want, "lte": lambda: typed <= want,
    }
    return F.coalesce(tests[op](), F.lit(False))


def walk(rows: DataFrame, prefix: str) -> DataFrame:
    """Markdown files under a prefix whose name does not begin with '_'."""
    name = F.substring_index("path", "/", -1)
    return rows.where(F.col("path").startswith(prefix) & F.col("path").endswith(".md") & ~name.startswith("_"))


def list_flat(rows: DataFrame, folder: str) -> DataFrame:
    """One row for each entry right under ``folder``: a file, or a folder with the number of files below it."""
    rest = F.expr(f"substr(path, {len(folder) + 1})")
    under = rows.where(F.col("path").startswith(folder)).select(rest.alias("rest"))
    entry = F.concat(F.lit(folder), F.substring_index("rest", "/", 1))
    return under.groupBy(entry.alias("path")).agg(F.bool_or(F.instr("rest", "/") > 0).alias("is_dir"), F.count("*").alias("n"))


def glob(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows whose file name fits a glob of *, ? and [..]."""
    parts = re.findall(r"\[[^\]]*\]|.", pattern, re.S)
    regex = "".join("[^/]*" if p == "*" else "." if p == "?" else p if p.startswith("[") and len(p) > 1 else re.escape(p) for p in parts)
    return rows.where(F.substring_index("path", "/", -1).rlike(f"^{regex}$"))


def index_changes(now: DataFrame, indexed: DataFrame) -> DataFrame:
    """(path, action) that bring an index up to date: delete, insert or update by checksum."""
    old = indexed.select("path", F.col("checksum").alias("was"), F.lit(True).alias("known"))
    new = now.select("path", F.col("checksum"), F.lit(True).alias("there"))
    action = F.when(F.col("there").isNull(), "delete").when(F.col("known").isNull(), "insert").when(F.col("checksum") != F.col("was"), "update")
    return new.join(old, "path", "full").select("path", action.alias("action")).where("action is not null")


def upsert_latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the highest version for each key."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), version).alias("_best")).select("_best.*")


def staleness(on_disk: DataFrame, indexed: DataFrame, least: float = 0.5) -> DataFrame:
    """One row (indexed, on_disk, stale): an index that holds less than ``least`` of the ids on disk is built anew."""
    held = on_disk.join(indexed.select("id").distinct().withColumn("_held", F.lit(1)), "id", "left")
    return held.agg(F.count("_held").alias("indexed"), F.count("*").alias("on_disk")).withColumn("stale", F.col("indexed") < least * F.col("on_disk"))


def drift(now: DataFrame, stored: DataFrame) -> DataFrame:
    """(id, status) by checksum: missing (not stored), stale (no longer there), changed or fresh."""
    both = now.select("id", F.col("checksum").alias("is"), F.lit(True).alias("there")).join(stored.select("id", F.col("checksum").alias("was"), F.lit(True).alias("held")), "id", "full")
    return both.select("id", F.when(F.col("held").isNull(), "missing").when(F.col("there").isNull(), "stale").when(F.col("is") != F.col("was"), "changed").otherwise("fresh").alias("status"))


def index_rows(rows: DataFrame) -> DataFrame:
    """What the index holds of each row: keys, scope, checksum and the words of its date."""
    f = lambda p: F.date_format("modified", p)
    words = F.when(F.col("modified").isNull(), F.array().cast("array<string>")).otherwise(F.array(f("yyyy-MM-dd"), f("yyyy/MM/dd"), f("yyyy"), F.lower(f("EEEE")), F.lower(f("MMMM"))))
    return rows.select("chunk_id", "path", "scope", F.lower("title").alias("title_key"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("checksum"), words.alias("date_tokens"))
