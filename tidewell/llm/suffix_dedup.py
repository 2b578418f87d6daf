"""Removal of repeated 100-byte strings with two-stage suffix sorting.

Every 100-byte window of a text has an anchor, the window's 24-byte string of smallest
hash; equal windows have equal anchors in equal places. Neighbouring windows with one
anchor form a segment. Segments are dealt by anchor: where segments of an anchor are
equal, all but the first are gone; where they differ, their bytes are sorted as
suffixes to depth 100, in two stages: suffixes smaller than their successors are sorted
directly, the others are induced from them by scans of the buckets; windows that share
100 bytes with their neighbour in that order are equal, and all but the first of them
are gone. Only segments whose anchor occurs twice are moved with their bytes. Tasks
drop their own repeated segments first, so that a passage of very many documents
reaches its anchor's task a few times.

Segments of a frequent anchor are dealt by their contents instead, and what must be compared is
dealt by more of its bytes than the anchor: a window holds 62 bytes from the anchor's
start on, or 63 up to its end, and equal windows hold the same. A sample of the documents says
which anchors are frequent; that decides where rows go, not what is found.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, null_safe_text, steps
from .near_dedup import mix

LENGTH, GRAM = 100, 24
#: Bytes of text that a task hashes, and of segments that it sorts, at once.
HASH_BYTES, SORT_BYTES = 1_000_000, 1_000_000
#: One of so many documents is looked at for frequent anchors: those with more segments than these there, the most frequent first, so many at most.
SAMPLED, FREQUENT, HELD_ANCHORS = 16, 60, 200_000
#: Bytes that a window holds from its anchor's start on at least, or else up to its end (one more).
FROM_START = (LENGTH + GRAM) // 2
_B = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _power(base: int, e: int) -> np.uint64:
    return np.uint64(pow(base, e, 1 << 64))


@functools.lru_cache(1)
def _table() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


@functools.lru_cache(2)
def _powers(n: int, inverse: bool) -> np.ndarray:
    base = pow(_B, -1, 1 << 64) if inverse else _B
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(v: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all substrings of ``n`` symbols, by doubling."""
    out, size, parts, at = v, 1, None, 0
    while True:
        if n & size:
            piece = out
            parts = piece if parts is None else parts[: len(piece) - at] * _power(_B, size) + piece[at : at + len(parts)]
            at += size
        if size * 2 > n:
            return parts
        out = out[:-size] * _power(_B, size) + out[size:]
        size *= 2


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def segments(pieces: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
    """The segments of (doc_id, offset, bytes) pieces: k (anchor hash), c (content hash), doc_id, s0 (first window's start), n (windows), o (the anchor's offset from s0)."""
    sizes = np.array([len(b) for _, _, b in pieces], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    buf = np.frombuffer(b"".join(b for _, _, b in pieces), dtype=np.uint8)
    total = len(buf)
    v = _table()[buf]
    grams = mix(gram_hashes(v, GRAM))
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(key, LENGTH - GRAM + 1)
    valid = np.zeros(total + 1, dtype=np.int8)
    np.add.at(valid, base, 1)
    np.add.at(valid, base + np.maximum(sizes - LENGTH + 1, 0), -1)
    starts = np.flatnonzero(np.cumsum(valid[:-1], dtype=np.int8))
    anchor = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.diff(anchor, prepend=-1))
    s = starts[head]
    n = np.diff(np.append(head, len(starts)))
    size = 1 << max(20, int(total).bit_length())
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(v * _powers(size, False)[:total], dtype=np.uint64)])
    c = mix((prefix[s + n + LENGTH - 1] - prefix[s]) * _powers(size, True)[s] + n.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))
    piece = np.searchsorted(base, s, side="right") - 1
    ids, offsets = np.array([p[0] for p in pieces], dtype=np.int64), np.array([p[1] for p in pieces], dtype=np.int64)
    return {"k": grams[anchor[head]].view(np.int64), "c": c.view(np.int64), "doc_id": ids[piece], "s0": s - base[piece] + offsets[piece], "n": n, "o": anchor[head] - s}


def _pieces(rows: Iterable[tuple[int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (doc_id, offset, bytes) of about HASH_BYTES; a long text is cut, its pieces sharing LENGTH - 1 bytes."""
    got, total = [], 0
    for i, data in rows:
        for at in range(0, max(0, len(data) - LENGTH + 1), HASH_BYTES):
            part = data[at : at + HASH_BYTES + LENGTH - 1]
            got.append((i, at, part))
            total += len(part)
            if total >= HASH_BYTES:
                yield got
                got, total = [], 0
    if got:
        yield got


def _segment_rows(frequent):
    """doc_id and _text -> the segments, each with g, by which it is dealt."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: np.ndarray = frequent.value
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("_text")
            for pieces in _pieces((i, texts[r].as_buffer().to_pybytes()) for r, i in enumerate(ids)):
                s = segments(pieces)
                order = np.lexsort((s["s0"], s["doc_id"], s["c"], s["k"]))
                s = {k: x[order] for k, x in s.items()}
                again = np.zeros(len(order), dtype=bool)
                again[1:] = (s["k"][1:] == s["k"][:-1]) & (s["c"][1:] == s["c"][:-1])
                often = known[np.minimum(np.searchsorted(known, s["k"]), len(known) - 1)] == s["k"] if len(known) else np.zeros(len(order), dtype=bool)
                # a repeated segment needs no anchor any more: it goes anywhere; that of a frequent one goes by its contents
                own = mix(s["doc_id"].astype(np.uint64) * np.uint64(_B) + s["s0"].astype(np.uint64)).view(np.int64)
                contents = mix(s["c"].view(np.uint64) + s["k"].view(np.uint64)).view(np.int64)
                g = np.where(again, own, np.where(often, contents, s["k"]))
                yield pa.RecordBatch.from_pydict({"g": g, "c": s["c"], "doc_id": s["doc_id"], "s0": s["s0"], "no": (s["n"] * 128 + s["o"]).astype(np.int32), "again": again, "often": often})

    return rows


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("_text")
        for pieces in _pieces((i, texts[r].as_buffer().to_pybytes()) for r, i in enumerate(ids)):
            s = segments(pieces)
            order = np.lexsort((s["c"], s["k"]))
            k, c = s["k"][order], s["c"][order]
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])
            k, n = np.unique(k[new], return_counts=True)
            yield pa.RecordBatch.from_pydict({"k": k, "n": n})


def frequent_anchors(rows: DataFrame) -> np.ndarray:
    """Sorted hashes of anchors that have many different segments in the sampled documents."""
    some = rows.where(F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(SAMPLED)) == 0)
    counts = some.mapInArrow(_anchors, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") > FREQUENT)
    return np.sort(np.array([r["k"] for r in counts.orderBy(F.desc("n"), "k").limit(HELD_ANCHORS).collect()], dtype=np.int64))


# -- two-stage suffix sorting -------------------------------------------------


def _packed(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Seven nine-bit symbols from each position, as one number."""
    out = np.zeros(len(at), dtype=np.uint64)
    for j in range(7):
        out = (out << np.uint64(9)) | t[at + j]
    return out


def sort_directly(t: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions ``at`` ordered by their first ``depth`` symbols; ``t`` is followed by depth + 7 zeros."""
    order = at[np.argsort(_packed(t, at), kind="stable")]
    key = _packed(t, order)
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    d = 7
    while d < depth:
        size = np.bincount(group)
        tied = np.flatnonzero(size[group] > 1)
        if not len(tied):
            break
        key = _packed(t, order[tied] + d)
        by = np.lexsort((key, group[tied]))
        order[tied] = order[tied][by]
        key, g = key[by], group[tied]
        step = np.zeros(len(order), dtype=np.int64)
        step[tied[1:]] = (key[1:] != key[:-1]) & (g[1:] == g[:-1])
        step[np.flatnonzero(group[1:] != group[:-1]) + 1] = 1
        group = np.cumsum(step)
        d += 7
    return order


def suffix_array(t: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """All positions of ``t`` (symbols 0 to 256, the last one 0) ordered by at least ``depth`` symbols.

    First the suffixes smaller than their successors are sorted directly. A larger one
    is its symbol before its successor's place: scanning the buckets of first symbols
    upwards, each suffix puts the one before it, if that is larger, next into its bucket.
    """
    n = len(t)
    padded = np.concatenate([t, np.zeros(depth + 7, dtype=t.dtype)]).astype(np.uint64)
    # larger[i]: suffix i > suffix i + 1; equal symbols are as their run's end is
    change = np.flatnonzero(np.append(t[1:] != t[:-1], True))
    run_end = change[np.searchsorted(change, np.arange(n))]
    larger = padded[run_end] > padded[run_end + 1]
    larger[t == 0] = False  # ends of segments: ordered directly, as all of them are alike
    direct = sort_directly(padded, np.flatnonzero(~larger), depth)
    symbols = int(t.max()) + 1
    of = t[direct]
    bounds = np.searchsorted(of, np.arange(symbols + 1))  # directly sorted suffixes are in bucket order
    waiting: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    out = []
    for s in range(symbols):
        induced = waiting[s]
        i = 0
        while i < len(induced):  # larger suffixes of this bucket, also those that are induced within it
            _induce(t, larger, induced[i], s, waiting)
            i += 1
        smaller = direct[bounds[s] : bounds[s + 1]]
        _induce(t, larger, smaller, s, waiting)
        out += [*induced, smaller]
    return np.concatenate(out)


def _induce(t: np.ndarray, larger: np.ndarray, suffixes: np.ndarray, s: int, waiting: list) -> None:
    before = suffixes[suffixes > 0] - 1
    before = before[larger[before]]
    if not len(before):
        return
    first = t[before]
    order = np.argsort(first, kind="stable")
    before, first = before[order], first[order]
    cuts = np.flatnonzero(np.diff(first)) + 1
    for part in np.split(before, cuts):
        waiting[int(t[part[0]])].append(part)


def equal_windows(t: np.ndarray, sa: np.ndarray, ok: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The positions with ``ok`` in the order ``sa``, and the number of each one's group of
    equal windows: neighbours whose common prefix reaches ``length``."""
    at = sa[ok[sa]]
    same = np.ones(max(0, len(at) - 1), dtype=bool)
    live = np.arange(len(same))
    for d in range(length):  # the common prefix of neighbours grows symbol by symbol
        hit = t[at[live] + d] == t[at[live + 1] + d]
        same[live[~hit]] = False
        live = live[hit]
        if not len(live):
            break
    return at, np.cumsum(np.concatenate([[0], ~same])) if len(at) else np.zeros(0, np.int64)


def repeated_windows(rows: list[tuple[int, int, bytes]]) -> list[tuple[int, int, int]]:
    """(doc_id, start, end) of the windows of (doc_id, s0, bytes) segments that also start earlier, in runs."""
    sizes = np.array([len(b) for _, _, b in rows], dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]).astype(np.int64)
    t = np.zeros(int(sizes.sum()) + len(rows), dtype=np.int64)
    for (_, _, b), s in zip(rows, base):
        t[s : s + len(b)] = np.frombuffer(b, dtype=np.uint8).astype(np.int64) + 1
    ok = np.zeros(len(t) + 1, dtype=np.int64)
    np.add.at(ok, base, 1)
    np.add.at(ok, base + np.maximum(sizes - LENGTH + 1, 0), -1)
    ok = np.cumsum(ok)[:-1] > 0
    at, group = equal_windows(t, suffix_array(t), ok)
    row = np.searchsorted(base, at, side="right") - 1
    ids, s0 = np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)
    start = at - base[row] + s0[row]
    order = np.lexsort((start, ids[row], group))
    late = order[1:][group[order][1:] == group[order][:-1]]
    # one window may stand in two pieces of its own document: it is not its own repeat
    firsts = order[np.concatenate([[True], group[order][1:] != group[order][:-1]])] if len(order) else order
    first_of = np.zeros(int(group.max()) + 1 if len(group) else 0, dtype=np.int64)
    first_of[group[firsts]] = firsts
    late = late[(ids[row[late]] != ids[row[first_of[group[late]]]]) | (start[late] != start[first_of[group[late]]])]
    return runs(ids[row[late]], start[late], np.full(len(late), LENGTH))


def runs(doc: np.ndarray, start: np.ndarray, size: np.ndarray) -> list[tuple[int, int, int]]:
    """Overlapping or touching (doc, start, start + size) joined."""
    out: list[list[int]] = []
    order = np.lexsort((start, doc))
    for d, a, b in zip(doc[order].tolist(), start[order].tolist(), (start + size)[order].tolist()):
        if out and out[-1][0] == d and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([d, a, b])
    return [tuple(x) for x in out]


# -- stages -------------------------------------------------------------------


def _lists(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Where each row's list of structs begins (and the last ends) in the arrays of its fields; a null list is empty."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
    flat = column.flatten()
    return np.concatenate([[0], ends]).astype(np.int64), {f.name: flat.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(flat.type)}


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the segments that must be compared, out of their documents' texts.

    Of a frequent anchor's segment the windows that hold FROM_START bytes from the anchor on go by these, the others by the
    FROM_START + 1 bytes up to the anchor's end; other segments go by the anchor.
    """
    for batch in batches:
        ids, texts = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("_text")
        at, seg = _lists(batch.column("segs"))
        row = np.repeat(np.arange(len(ids)), np.diff(at))
        some = np.flatnonzero(~seg["gone"].astype(bool))
        n, o = seg["no"] // 128, seg["no"] % 128
        sizes = (n[some] + LENGTH - 1).tolist()
        for a, b in steps(sizes, sizes, 2 * SORT_BYTES):
            keys, docs, starts, bodies, last, data = [], [], [], [], -1, b""
            for i in some[a:b].tolist():
                if row[i] != last:
                    last = row[i]
                    data = texts[int(last)].as_buffer().to_pybytes()
                s0, end = int(seg["s0"][i]), int(seg["s0"][i] + n[i])
                if not seg["often"][i]:
                    parts = [(int(seg["g"][i]), s0, end)]
                else:
                    p = s0 + int(o[i])
                    split = min(max(s0, p + FROM_START - LENGTH), end)
                    parts = [(_context(data[p : p + FROM_START], 1), split, end), (_context(data[p + GRAM - FROM_START - 1 : p + GRAM], 2), s0, split)]
                for key, x, y in parts:
                    if x < y:
                        keys.append(key)
                        docs.append(ids[last])
                        starts.append(x)
                        bodies.append(data[x : y + LENGTH - 1])
            yield pa.RecordBatch.from_pydict({"k": pa.array(keys, pa.int64()), "doc_id": pa.array(docs, pa.int64()), "s0": pa.array(starts, pa.int64()), "body": pa.array(bodies, pa.binary())})


def _context(data: bytes, side: int) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, salt=bytes([side])).digest(), "little", signed=True)


def _sorted_groups(batches):
    """Rows in the order of k: whole anchors are gathered up to SORT_BYTES and sorted together."""
    rows, total, last = [], 0, None
    for pdf in batches:
        for k, i, s0, body in zip(pdf["k"], pdf["doc_id"], pdf["s0"], pdf["body"]):
            if k != last and total >= SORT_BYTES:
                yield pd.DataFrame(repeated_windows(rows), columns=["doc_id", "start", "end"])
                rows, total = [], 0
            rows.append((i, s0, body))
            total, last = total + len(body), k
    if rows:
        yield pd.DataFrame(repeated_windows(rows), columns=["doc_id", "start", "end"])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("_text")
        at, seg = _lists(batch.column("segs"))
        near, span = _lists(batch.column("spans"))
        sizes = pc.binary_length(texts).to_pylist()
        for a, b in steps(sizes, sizes):
            out = []
            for r in range(a, b):
                data = np.frombuffer(texts[r].as_buffer(), dtype=np.uint8)
                mark = np.zeros(len(data) + 1, dtype=np.int64)
                mine, late = slice(at[r], at[r + 1]), slice(near[r], near[r + 1])
                np.add.at(mark, seg["s0"][mine], 1)
                np.add.at(mark, seg["s0"][mine] + seg["no"][mine] // 128 + LENGTH - 1, -1)
                np.add.at(mark, span["start"][late], 1)
                np.add.at(mark, span["end"][late], -1)
                gone = np.cumsum(mark[:-1]) > 0
                if gone.any():
                    # a character that loses a byte goes whole from the text
                    character = np.cumsum((data & 0xC0) != 0x80) - 1
                    text = data[np.bincount(character, weights=gone)[character] == 0].tobytes().decode()
                    spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                    out.append((ids[r], hashlib.sha256(data.tobytes()).hexdigest(), int(gone.sum()), spans, data[~gone].tobytes(), text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["doc_id", "whole", "n_removed", "n_spans", "kept", "kept_text"])


def repeated_bytes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, whole (SHA-256 of the text), n_removed, n_spans, kept (the remaining bytes) and kept_text (the
    remaining characters: one that is cut in two goes whole) of the documents that lose bytes: those covered by a 100-byte string that also starts earlier, in a
    smaller doc_id or earlier in the same document.

    Nulls and texts under 100 bytes lose nothing, and rows with a null doc_id take no part.
    Rows that share a doc_id are one document; if their texts differ, the smallest counts.
    """
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), null_safe_text(text).alias("_text"))
    if not rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        rows = rows.groupBy("doc_id").agg(F.min("_text").alias("_text"))
    rows = rows.where(F.octet_length("_text") >= LENGTH)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_anchors(rows))  # HELD_ANCHORS numbers at most
    segs = rows.mapInArrow(_segment_rows(shared), "g long, c long, doc_id long, s0 long, no int, again boolean, often boolean")
    group, ordered = Window.partitionBy("g"), Window.partitionBy("g").orderBy("c", "doc_id", "s0")
    seen = segs.withColumn("gone", F.col("again") | F.coalesce(F.lag("c").over(ordered) == F.col("c"), F.lit(False)))
    seen = seen.withColumns({"lo": F.min("c").over(group), "hi": F.max("c").over(group)})
    found = seen.where("gone or often or lo <> hi").select("doc_id", F.struct("g", "s0", "no", "gone", "often").alias("s"))
    by_doc = found.groupBy("doc_id").agg(F.collect_list("s").alias("segs"))  # no more than the document's own bytes
    affected = cut(rows.join(by_doc, "doc_id"))
    compared = affected.where(F.exists("segs", lambda s: ~s["gone"]))
    bodies = compared.mapInArrow(_bodies, "k long, doc_id long, s0 long, body binary").repartition(F.col("k")).sortWithinPartitions("k")
    spans = bodies.mapInPandas(_sorted_groups, "doc_id long, start long, end long")
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    gone = F.transform(F.filter("segs", lambda s: s["gone"]), lambda s: F.struct(s["s0"].alias("s0"), s["no"].alias("no")))
    return affected.select("doc_id", "_text", gone.alias("segs")).join(spans, "doc_id", "left").mapInArrow(_removed, "doc_id long, whole string, n_removed long, n_spans long, kept binary, kept_text string")


def op5_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    removed = repeated_bytes(docs).select("doc_id", "whole", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    text = null_safe_text()
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    return rows.join(removed, ["doc_id", "whole"], "left").select(
        "doc_id", "n_bytes", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans")], F.coalesce("kept_sha256", "whole").alias("kept_sha256")
    )


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple[int, int, int, int, str]]:
    """op5's rows for (doc_id, text) rows with distinct ids, by a table of all windows."""
    seen: set[bytes] = set()
    out = []
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for s in range(len(data) - LENGTH + 1):
            w = data[s : s + LENGTH]
            if w in seen:
                gone[s : s + LENGTH] = b"\x01" * LENGTH
            seen.add(w)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


OP5_SQL = None  # tested against brute force
