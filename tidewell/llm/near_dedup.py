"""Near-duplicate classes by ProbMinHash signatures, banding and verification.

Each distinct five-word shingle of a text arrives by a Poisson process whose rate is the
shingle's weight; each arrival picks one of the signature's registers, and a register
keeps the shingle that arrives first. A shingle stops once its next arrival is later than
the last of all registers. The chance that two texts agree in a register is their
probability Jaccard similarity; every distinct shingle of a text has weight 1 here,
whatever its count, so that this is the Jaccard similarity of the shingle sets. Bands of
registers give buckets.

A bucket of any size is spread over many tasks and never paired with itself. Its texts
are compared with its leader; exact Jaccard similarities that reach the threshold are
links, and what links connect needs no further comparison. Where a bucket still holds
several components, each text outside the largest is compared with those that could
still be linked to it. Exact bounds of what two texts can share say which could: neither
shares the shingles that no other text of the open buckets has, nor those of the leader
that the other has lost; and by the triangle inequality of the Jaccard distance both are
about as far from the leader.
Every candidate pair is thus verified, known to be connected, or
proved to be below the threshold.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, null_safe_text, steps

WORDS, THRESHOLD = 5, 0.8
#: At similarity 0.8, one pair in 38,000 shares none of 20 bands of four registers.
BANDS, ROWS = 20, 4
#: Characters of one text that are hashed at once, and shingles that a worker keeps; bound its RAM.
PIECE, KEPT = 1_000_000, 2_000_000
#: Columns with the bits of what a text has lost of its leader.
LOST = ["lost0", "lost1", "lost2", "lost3"]
#: Rounding that a bound must allow for.
EPS = 1e-9
_BREAK = re.compile(r"\W")
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal inputs, equal well-spread outputs."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(1)
def _word_characters() -> np.ndarray:
    """Of each code point, whether it is a letter, a digit or '_'."""
    every = np.arange(0x110000, dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    out = np.zeros(0x110000, dtype=bool)
    for m in re.finditer(r"\w+", every):
        out[m.start() : m.end()] = True
    return out


@functools.lru_cache(8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (int(_GOLD), pow(int(_GOLD), -1, 1 << 64)):
        x = np.full(n, np.uint64(base), dtype=np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``text`` and where they start: a rolling hash of code points."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    edge = np.flatnonzero(np.diff(_word_characters()[points].view(np.int8), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    up, down = _powers(1 << max(16, len(points).bit_length()))
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(mix(points + _GOLD) * up[: len(points)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64)), start


def _pieces(text: str) -> list[str]:
    """A text cut between words into pieces of about PIECE characters."""
    out, a = [], 0
    while len(text) - a > PIECE:
        cut_at = _BREAK.search(text, a + PIECE)
        if cut_at is None:
            break
        out.append(text[a : cut_at.start()])
        a = cut_at.start()
    return [*out, text[a:]]


def shingle_sets(texts: list[str], n: int = WORDS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the sorted distinct shingle hashes of lower-cased words and their counts; a
    text of fewer words, but not none, is one shingle."""
    texts = [t.lower() for t in texts]
    if len(texts) == 1:
        per_text = [np.concatenate([_word_hashes(p)[0] for p in _pieces(texts[0])])]
    else:
        hashes, start = _word_hashes("\n".join(texts))
        ends = np.cumsum([len(t) + 1 for t in texts])
        per_text = np.split(hashes, np.searchsorted(start, ends[:-1]))
    out = []
    for h in per_text:
        k = min(n, len(h))
        if not k:
            out.append((np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            continue
        x = np.full(len(h) - k + 1, np.uint64(k), dtype=np.uint64)
        for i in range(k):
            x = mix(x * _GOLD + h[i : len(h) - k + 1 + i])
        x.sort()
        head = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        out.append((x[head], np.diff(head, append=len(x))))
    return out


def shingles(text: str, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets([text], n)[0]


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """ProbMinHash signatures of non-empty weighted sets, one row each; the weight of a shingle is 1 + ln(count)."""
    sizes = np.array([len(s) for s, _ in sets], dtype=np.int64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    item = np.concatenate([s for s, _ in sets])
    rate = 1.0 + np.log(np.concatenate([c for _, c in sets]).astype(np.float64))
    first, label = np.full(len(sets) * registers, np.inf), np.full(len(sets) * registers, np.iinfo(np.uint64).max, dtype=np.uint64)
    # most registers are taken long before the last shingle has arrived: only a shingle whose
    # arrival is before its set's horizon is placed, and sets with a free register look further
    total = np.bincount(doc, weights=rate, minlength=len(sets))
    horizon = registers * (np.log(registers) + 4.0) / total
    clock, turn = np.zeros(len(item)), 0
    while len(item):
        turn += 1
        draw = mix(item + np.uint64(turn * int(_GOLD) & (1 << 64) - 1))
        clock = clock - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        live = clock < horizon[doc]
        doc, item, rate, clock, draw = doc[live], item[live], rate[live], clock[live], draw[live]
        place = doc * registers + (mix(draw ^ _M1) % np.uint64(registers)).astype(np.int64)
        before = first[place]
        np.minimum.at(first, place, clock)
        won = np.flatnonzero((clock < before) & (clock == first[place]))
        label[place[won]] = np.iinfo(np.uint64).max
        np.minimum.at(label, place[won], item[won])
        horizon = np.minimum(horizon, first.reshape(len(sets), registers).max(axis=1))
        live = clock < horizon[doc]
        doc, item, rate, clock = doc[live], item[live], rate[live], clock[live]
    open_sets = np.flatnonzero(np.isinf(first.reshape(len(sets), registers).max(axis=1)))
    label = label.reshape(len(sets), registers)
    if len(open_sets):
        label[open_sets] = _patient([sets[i] for i in open_sets], registers)
    return label


def _patient(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """As signatures(), without a horizon, for the few sets that one left with free registers."""
    out = np.zeros((len(sets), registers), dtype=np.uint64)
    for n, (item, count) in enumerate(sets):
        rate = 1.0 + np.log(count.astype(np.float64))
        clock, first, turn = np.zeros(len(item)), np.full(registers, np.inf), 0
        while len(item):
            turn += 1
            draw = mix(item + np.uint64(turn * int(_GOLD) & (1 << 64) - 1))
            clock = clock - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            place = (mix(draw ^ _M1) % np.uint64(registers)).astype(np.int64)
            for i in np.argsort(clock, kind="stable"):
                if clock[i] < first[place[i]]:
                    first[place[i]], out[n, place[i]] = clock[i], item[i]
            live = clock < first.max()
            item, rate, clock = item[live], rate[live], clock[live]
    return out


def _bands(batches):
    """id and _text -> id, bands (array<long>) and size (distinct shingles); texts without words give no row."""
    salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for pdf in batches:
        texts = pdf["_text"]
        for a, b in steps(texts, map(len, texts), 1_000_000):
            # each distinct shingle weighs the same: registers then agree with the chance of the Jaccard similarity that _similar verifies
            sets = [(s, np.ones(len(s), np.int64)) for s, _ in shingle_sets(texts.iloc[a:b].tolist())]
            some = [i for i, (s, _) in enumerate(sets) if len(s)]
            if not some:
                continue
            sig = signatures([sets[i] for i in some], BANDS * ROWS).reshape(len(some), BANDS, ROWS)
            h = np.broadcast_to(salt, (len(some), BANDS))
            for r in range(ROWS):
                h = mix(h * _GOLD + sig[:, :, r])
            yield pd.DataFrame({"id": pdf["id"].iloc[a:b].to_numpy()[some], "bands": list(h.astype(np.int64)), "size": [len(sets[i][0]) for i in some]})


def _shingle_rows(batches):
    """id and _text -> id and shingle, a row for each distinct shingle."""
    for pdf in batches:
        texts = pdf["_text"]
        for a, b in steps(texts, map(len, texts), 1_000_000):
            sets = [s for s, _ in shingle_sets(texts.iloc[a:b].tolist())]
            yield pd.DataFrame({"id": np.repeat(pdf["id"].iloc[a:b].to_numpy(), [len(s) for s in sets]), "shingle": np.concatenate(sets).view(np.int64)})


def _similar(x: np.ndarray, y: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct numbers."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0.0
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def _verify(batches):
    last: dict[int, np.ndarray] = {}
    held = 0
    for pdf in batches:
        out = []
        for a, b, t, u in zip(pdf["a"], pdf["b"], pdf["text_a"], pdf["text_b"]):
            if held > KEPT:
                last, held = {}, 0
            for i, text in ((a, t), (b, u)):
                if i not in last:
                    last[i] = shingles(text)[0]
                    held += len(last[i])
            out.append((a, b, _similar(last[a], last[b]), *_lost(last[b], last[a])))
        yield pd.DataFrame(out, columns=["a", "b", "similarity", *LOST])


def _lost(x: np.ndarray, y: np.ndarray) -> list[int]:
    """Bits of the hashes of what ``x`` has and ``y`` has not."""
    gone = mix(x[y[np.minimum(np.searchsorted(y, x), len(y) - 1)] != x]) & np.uint64(64 * len(LOST) - 1)
    bits = np.zeros(len(LOST), dtype=np.uint64)
    np.bitwise_or.at(bits, (gone >> np.uint64(6)).astype(np.int64), np.uint64(1) << (gone & np.uint64(63)))
    return bits.view(np.int64).tolist()


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of the distinct pairs, a > b, by their texts' shingle sets, and bits of what a lacks of b."""
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for x in "ab":
        pairs = pairs.join(texts.select(F.col("id").alias(x), F.col("_text").alias(f"text_{x}")), x)
    return pairs.mapInPandas(_verify, f"a long, b long, similarity double, {', '.join(f'{c} long' for c in LOST)}")


def components(links: DataFrame) -> DataFrame:
    """(id, label): the smallest id of each connected component of the links (a, b).

    Every round gives each node the smallest label beside it and then its label's own
    label, so that a path of n nodes takes about log n rounds.
    """
    edges = cut(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")))
    while True:
        beside = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(beside, "id", "left").select("id", F.least("label", F.coalesce("near", "label")).alias("new"), F.col("label").alias("old"))
        # hook: the old label's node learns the smallest label among those that carry it
        hooks = step.groupBy(F.col("old").alias("id")).agg(F.min("new").alias("hook"))
        step = step.join(hooks, "id", "left").select("id", "old", F.least("new", F.coalesce("hook", "new")).alias("new"))
        jump = step.select(F.col("id").alias("new"), F.col("new").alias("jump"))
        step = cut(step.join(jump, "new", "left").select("id", "old", F.least("new", F.coalesce("jump", "new")).alias("label")))
        labels = step.select("id", "label")
        if step.where("label <> old").isEmpty():
            return labels


def still_open(pairs: DataFrame, sims: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, a, leader, leader_s, lost, label, minor) of the members, besides the leader, of buckets where
    these have several components; minor: not of the bucket's most frequent one."""
    beside = pairs.where("a <> leader").join(sims.select("a", F.col("b").alias("leader"), F.col("similarity").alias("leader_s"), *LOST), ["a", "leader"])
    beside = beside.join(labels.select(F.col("id").alias("a"), "label"), "a", "left").withColumn("label", F.coalesce("label", "a"))
    mixed = beside.groupBy("band").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("band")
    beside = beside.join(mixed, "band")
    most = beside.groupBy("band", "label").agg(F.count("*").alias("n")).groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    return beside.join(most, "band").select("band", "a", "leader", "leader_s", *LOST, "label", (F.col("label") != F.col("most")).alias("minor"))


def could_link(rest: DataFrame, texts: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components within the buckets of ``rest`` that the bounds leave.

    Similar texts x, y share at least t / (1 + t) (|x| + |y|) shingles. Of x they cannot
    share what x alone has, nor what of the leader y has lost and x has not; a text with
    the first of these is similar to none larger than (|x| - (1 + t) alone(x)) / t.
    """
    ids = rest.select(F.col("a").alias("id")).union(rest.select("leader")).distinct()
    once = texts.join(ids, "id", "left_semi").select("id", "_text").mapInPandas(_shingle_rows, "id long, shingle long")
    once = once.groupBy("shingle").agg(F.count("*").alias("n"), F.min("id").alias("a")).where("n = 1")
    alone = once.groupBy("a").agg(F.count("*").alias("alone"))
    known = rest.drop("leader").join(sizes.select(F.col("id").alias("a"), "size"), "a").join(alone, "a", "left")
    known = known.withColumn("most", F.col("size") - F.coalesce("alone", F.lit(0))).drop("alone")
    known = known.withColumn("reach", ((1 + threshold) * F.col("most") - threshold * F.col("size")) / threshold + EPS)
    # a text whose reach is below all sizes of its bucket, or whose size is above all reaches, can be linked to none there
    ends = known.groupBy("band").agg(F.min("size").alias("least"), F.max("reach").alias("furthest"))
    known = cut(known.join(ends, "band").where((F.col("reach") >= F.col("least")) & (F.col("size") <= F.col("furthest"))).drop("least", "furthest"))
    x, y = (known.select("band", *[F.col(c).alias(f"{c}_{s}") for c in known.columns if c != "band"]) for s in "xy")
    share = lambda a, b: F.col(f"most_{a}") - sum(F.bit_count(F.col(f"{c}_{b}").bitwiseAND(F.bitwise_not(f"{c}_{a}"))) for c in LOST)
    enough = F.least(share("x", "y"), share("y", "x")) >= threshold / (1 + threshold) * (F.col("size_x") + F.col("size_y")) - EPS
    pairs = x.where("minor_x").join(y, "band").where((F.col("label_x") != F.col("label_y")) & (F.col("size_x") <= F.col("reach_y")) & (F.col("size_y") <= F.col("reach_x")) & enough)
    pairs = pairs.where((F.abs(F.col("leader_s_x") - F.col("leader_s_y")) <= 1 - threshold + EPS) & ~(F.col("minor_y") & (F.col("a_x") < F.col("a_y"))))
    return pairs.select(F.col("a_x").alias("a"), F.col("a_y").alias("b"))


def near_links(rows: DataFrame, ids: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Links (a, b, similarity) that connect each component of the texts of ``rows`` (id, _text) whose id is in
    ``ids``, and the component labels of the linked. Rows that repeat an id count with their smallest text."""
    signed = cut(rows.mapInPandas(_bands, "id long, bands array<long>, size long").join(ids, "id", "left_semi"))
    bands = signed.select(F.col("id").alias("a"), F.explode("bands").alias("band"))
    lead = bands.groupBy("band").agg(F.min("a").alias("leader"), F.max("a").alias("most")).where("leader <> most").drop("most")
    pairs = cut(bands.join(lead, "band").distinct())
    texts = cut(rows.join(pairs.select(F.col("a").alias("id")).distinct(), "id", "left_semi").groupBy("id").agg(F.min("_text").alias("_text")))
    sims = cut(verified(pairs.where("a <> leader").select("a", F.col("leader").alias("b")), texts))
    links = sims.where(F.col("similarity") >= threshold).select("a", "b", "similarity")
    labels = components(links)
    rest = cut(still_open(pairs, sims, labels))
    if rest.isEmpty():
        return links, labels
    sizes = signed.groupBy("id").agg(F.min("size").alias("size"))
    late = cut(verified(could_link(rest, texts, sizes, threshold), texts).where(F.col("similarity") >= threshold).select("a", "b", "similarity"))
    if late.isEmpty():
        return links, labels
    # the late links join components: only the components' labels are labelled again
    named = late
    for x in "ab":
        named = named.join(labels.select(F.col("id").alias(x), "label"), x, "left").withColumn(x, F.coalesce("label", x)).drop("label")
    joined = components(named).withColumnRenamed("label", "joined")
    known = labels.join(joined.select(F.col("id").alias("label"), "joined"), "label", "left").select("id", F.coalesce("joined", "label").alias("label"))
    return links.union(late), cut(known.union(joined.join(labels.select("id"), "id", "left_anti")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: doc_id, class_id (the smallest doc_id of its class), copy_of
    (the smallest doc_id with the same text), and linked_to and similarity, the link by which it belongs to its class.

    That link is, for a copy, to copy_of (1.0); for the first of a text the most similar smaller id among the links that
    were verified, ties to the smallest; null where its links lead to larger ids only, or it has none. The links of a class connect it; they
    are not all of its pairs, whose number grows with the square of a class.

    Equal texts are one text with the smallest of their ids; only distinct texts are
    compared. Texts without a word, and nulls, are classes of their own, and so are rows
    with a null doc_id (class null). A class is what links connect. Rows that share a
    doc_id but not a text are compared by their smallest text.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), null_safe_text(text).alias("_text"))
    keyed = rows.select("doc_id", F.sha2("_text", 256).alias("key"), F.col("_text").rlike(r"[\p{L}\p{N}_]").alias("wordy"))
    # only texts of several ids need a first one; a very frequent text is spread by salt
    salts = 16
    copies = keyed.where("wordy and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first <> last")
    copies = copies.select("key", "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    member = keyed.join(copies, ["key", "salt"], "left").select("doc_id", F.when(F.col("wordy"), F.coalesce("first", "doc_id")).otherwise(F.col("doc_id")).alias("copy_of"))
    member = cut(member)
    firsts = member.where("copy_of = doc_id").select(F.col("doc_id").alias("id")).distinct()
    links, labels = near_links(rows.where("doc_id is not null").withColumnRenamed("doc_id", "id"), firsts, threshold)
    best = links.groupBy(F.greatest("a", "b").alias("id")).agg(F.max(F.struct("similarity", (-F.least("a", "b")).alias("other"))).alias("best"))
    known = labels.join(best, "id", "left").select(F.col("id").alias("copy_of"), "label", "best")
    found = member.join(known, "copy_of", "left")
    copy = F.col("copy_of") != F.col("doc_id")
    return found.select(
        "doc_id",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "copy_of")).alias("class_id"),
        "copy_of",
        F.when(copy, F.col("copy_of")).otherwise(-F.col("best.other")).alias("linked_to"),
        F.when(copy, 1.0).otherwise(F.col("best.similarity")).alias("similarity"),
    )


def op9_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP9_SQL = None  # SQL would compare all pairs; tested against brute force on a small fixture
