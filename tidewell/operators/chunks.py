"""Sentence-bounded chunks of documents, heading paths and transcript blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

MOST, LEAST = 1800, 120
_HEADING = re.compile(r"(?m)^(?=#{1,6} )")


def sentence_cut(text: str, most: int = MOST) -> int:
    """Where to cut a text that is longer than ``most``: after the last blank line of its final two fifths, else after
    the last '. ', '! ' or '? ', in this order, else at ``most``."""
    low = most * 3 // 5
    for mark, keep in (("\n\n", 2), (". ", 2), ("! ", 2), ("? ", 2)):
        at = text.rfind(mark, low, most)
        if at >= 0:
            return at + keep
    return most


def split_long(text: str, most: int = MOST) -> list[str]:
    out = []
    while len(text) > most:
        at = sentence_cut(text, most)
        out.append(text[:at])
        text = text[at:]
    return [*out, text] if text else out


def segment(text: str, most: int = MOST, least: int = LEAST) -> list[str]:
    """Sections by heading, long ones cut at sentences, and pieces of fewer than ``least`` characters put to the one before."""
    out: list[str] = []
    for section in _HEADING.split(text):
        for piece in split_long(section, most):
            if not piece.strip():
                continue
            piece = piece.strip()
            if out and len(piece) < least:
                out[-1] += "\n\n" + piece
            else:
                out.append(piece)
    return out


@F.pandas_udf(ArrayType(StringType()))
def _segments(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield batch.map(lambda t: segment(t) if t else [])


def segments(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, chunk) of every document."""
    return rows.select(key, F.posexplode(_segments(F.col(text))).alias("ordinal", "chunk"))


def heading_paths(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ordinal, path, section): texts split at headings, each part with the headings above it, joined by ' > '.

    A heading closes those of its own and deeper levels.
    """
    parts = F.split(F.coalesce(F.col(text), F.lit("")), r"(?m)(?=^#{1,6} )")
    head = lambda s: F.regexp_extract(s, r"(?m)\A(#{1,6}) +(.*)$", 1)
    name = lambda s: F.trim(F.regexp_extract(s, r"(?m)\A(#{1,6}) +(.*)$", 2))
    start = F.struct(F.array().cast("array<struct<level:int,name:string>>").alias("open"), F.array().cast("array<struct<path:string,section:string>>").alias("done"))

    def add(state: Column, part: Column) -> Column:
        level = F.length(head(part))
        above = F.when(level > 0, F.concat(F.filter(state["open"], lambda h: h["level"] < level), F.array(F.struct(level.alias("level"), name(part).alias("name"))))).otherwise(state["open"])
        path = F.array_join(F.transform(above, lambda h: h["name"]), " > ")
        return F.struct(above.alias("open"), F.concat(state["done"], F.array(F.struct(path.alias("path"), F.trim(part).alias("section")))).alias("done"))

    kept = F.filter(F.aggregate(parts, start, add)["done"], lambda x: x["section"] != "")
    return rows.select(key, F.posexplode(kept).alias("ordinal", "x")).select(key, "ordinal", "x.path", "x.section")


def message_blocks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, role, said) of transcripts whose blocks begin with '[role]: '."""
    parts = F.filter(F.split(F.col(text), r"(?m)(?=^\[\w+\]: )"), lambda p: p.rlike(r"^\[\w+\]: "))
    return rows.select(key, F.posexplode(parts).alias("pos", "p")).select(key, "pos", F.regexp_extract("p", r"^\[(\w+)\]: ", 1).alias("role"), F.trim(F.regexp_replace("p", r"^\[\w+\]: ", "")).alias("said"))


def recall_snippet(rows: DataFrame, key: str, text: str, words: list[str], before: int = 4, after: int = 12) -> DataFrame:
    """(key, line, snippet): the line with the most of ``words`` (the first of equals) and the lines about it."""
    lines = F.split(F.col(text), "\n")
    hits = F.transform(lines, lambda x, i: F.struct(sum(F.lower(x).contains(w).cast("int") for w in words).alias("n"), (-i).alias("at")))
    best = F.array_max(hits)
    found = rows.select(key, lines.alias("lines"), best["n"].alias("n"), (-best["at"]).alias("line")).where("n > 0")
    first = F.greatest(F.lit(1), F.col("line") + 1 - before)
    return found.select(key, "line", F.array_join(F.slice("lines", first, F.col("line") + 1 + after - first + 1), "\n").alias("snippet"))
