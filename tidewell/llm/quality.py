"""A quality classifier: a small convolutional network over the bytes of a document, in numpy.

A document is cut into overlapping chunks of bytes that cover all of it. Bytes have learned
vectors; learned filters slide over a chunk, and of each filter the largest response of the
chunk counts. A hidden layer follows, whose units are averaged over the document's chunks,
and one probability comes out. The network learns from a bounded sample of labelled rows in
one task; a document that is scored is read whole, piece by piece.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import null_safe_text, with_columns
from .language_id import held_out

#: Bounds of the sample that the network learns from: rows of each label, and chunks of a row (evenly spread over its text).
SAMPLE_ROWS, SAMPLE_CHUNKS = 1_200, 8
#: Bytes of a chunk, of which CHUNK - STEP also stand in the next.
CHUNK, STEP = 512, 448
#: Bytes under a filter, the step of filters, and sizes of the layers.
SPAN, STRIDE, BYTE_SIZE, FILTERS, HIDDEN = 6, 2, 8, 32, 16
#: Chunks that are scored at once, characters that a task turns into chunks at once.
BATCH, PIECE = 128, 1_000_000
EPOCHS, DOCS_A_STEP, RATE = 24, 24, 0.004
#: Score from which a document counts as good (a fixed value).
GOOD = 0.7
_PAD = 256  # after the end of a text


def chunk_starts(size: int) -> range:
    """Where the chunks of a text of so many bytes begin; an empty text has one chunk."""
    return range(0, max(1, size - (CHUNK - STEP)), STEP)


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The chunks of the texts (one a row, filled with _PAD), and the number of each one's text."""
    starts = [chunk_starts(len(t)) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    out = np.full((len(owner), CHUNK), _PAD, dtype=np.int16)
    row = 0
    for t, at in zip(texts, starts):
        data = np.frombuffer(t, np.uint8)
        for a in at:
            part = data[a : a + CHUNK]
            out[row, : len(part)] = part
            row += 1
    return out, owner


def _windows(codes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """What stands under a filter at each of its places: (chunk, place, SPAN * BYTE_SIZE)."""
    seen = np.ascontiguousarray(vectors[codes])
    places = (codes.shape[1] - SPAN) // STRIDE + 1
    a, b, c = seen.strides
    return np.lib.stride_tricks.as_strided(seen, (len(seen), places, SPAN * BYTE_SIZE), (a, STRIDE * b, c))


class Network:
    """vectors of bytes, filters, the hidden layer, the last one, and an offset for the shares of the labels."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        some = lambda *shape, by: (r.standard_normal(shape) / math.sqrt(by)).astype(np.float32)
        self.p = {
            "vectors": some(257, BYTE_SIZE, by=4),
            "filters": some(SPAN * BYTE_SIZE, FILTERS, by=SPAN * BYTE_SIZE / 4),
            "bias": np.zeros(FILTERS, np.float32),
            "hidden": some(FILTERS, HIDDEN, by=FILTERS / 2),
            "hidden_bias": np.zeros(HIDDEN, np.float32),
            "last": some(HIDDEN, by=HIDDEN),
            "last_bias": np.zeros(1, np.float32),
        }
        self.offset = 0.0

    def pooled(self, codes: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest response of each filter in each chunk, and where it is."""
        out = np.empty((len(codes), FILTERS), np.float32)
        at = np.empty((len(codes), FILTERS), np.int64) if places else None
        for a in range(0, len(codes), BATCH):
            w = _windows(codes[a : a + BATCH], self.p["vectors"])
            found = (w.reshape(-1, SPAN * BYTE_SIZE) @ self.p["filters"]).reshape(len(w), -1, FILTERS)
            if places:
                at[a : a + BATCH] = found.argmax(axis=1)
            out[a : a + BATCH] = found.max(axis=1)
        return out + self.p["bias"], at

    def units(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(np.maximum(pooled, 0) @ self.p["hidden"] + self.p["hidden_bias"], 0)

    def scores(self, codes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the hidden units over the chunks of each of ``n`` texts, and the numbers of chunks."""
        total = np.zeros((n, HIDDEN))
        np.add.at(total, owner, self.units(self.pooled(codes)[0]))
        return total, np.bincount(owner, minlength=n)

    def probability(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = (total / n[:, None]) @ self.p["last"].astype(np.float64) + float(self.p["last_bias"][0]) + self.offset
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))

    def gradients(self, codes: np.ndarray, owner: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of the texts with these chunks; only the places that were largest carry any back."""
        p, n = self.p, np.bincount(owner, minlength=len(label)).astype(np.float32)
        pooled, at = self.pooled(codes, places=True)
        live = np.maximum(pooled, 0)
        units = self.units(pooled)
        total = np.zeros((len(label), HIDDEN), np.float32)
        np.add.at(total, owner, units)
        mean = total / n[:, None]
        x = mean @ p["last"] + p["last_bias"]
        back = ((1 / (1 + np.exp(-np.clip(x, -50, 50))) - label) / len(label)).astype(np.float32)
        g = {"last": mean.T @ back, "last_bias": back.sum(keepdims=True)}
        to_units = (back / n)[owner][:, None] * p["last"] * (units > 0)
        g["hidden"], g["hidden_bias"] = live.T @ to_units, to_units.sum(axis=0)
        to_pooled = (to_units @ p["hidden"].T) * (pooled > 0)
        g["bias"] = to_pooled.sum(axis=0)
        row, under = np.arange(len(codes))[:, None, None], at[:, :, None] * STRIDE + np.arange(SPAN)
        seen = codes[row, under]  # chunk, filter, the bytes under it
        carried = p["vectors"][seen].reshape(len(codes), FILTERS, -1)
        g["filters"] = np.einsum("cfw,cf->wf", carried, to_pooled)
        to_bytes = (to_pooled[:, :, None] * p["filters"].T).reshape(-1, BYTE_SIZE)
        g["vectors"] = np.stack([np.bincount(seen.ravel(), to_bytes[:, j], 257) for j in range(BYTE_SIZE)], axis=1).astype(np.float32)
        return g


def train(texts: list[list[bytes]], labels: list[int], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """A network trained on texts, each given by some of its chunks, by Adam steps over DOCS_A_STEP texts."""
    net, r = Network(seed), np.random.default_rng(seed)
    codes = np.full((sum(map(len, texts)), CHUNK), _PAD, dtype=np.int16)
    row = 0
    for c in (c for t in texts for c in t):
        codes[row, : len(c)] = np.frombuffer(c, np.uint8)
        row += 1
    ends = np.cumsum([0, *map(len, texts)])
    y = np.array(labels, dtype=np.float32)
    first = {k: np.zeros_like(v) for k, v in net.p.items()}
    second = {k: np.zeros_like(v) for k, v in net.p.items()}
    step, steps = 0, epochs * math.ceil(len(texts) / DOCS_A_STEP)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for a in range(0, len(order), DOCS_A_STEP):
            some = order[a : a + DOCS_A_STEP]
            rows = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in some])
            owner = np.repeat(np.arange(len(some)), ends[some + 1] - ends[some])
            step += 1
            rate = RATE * min(1.0, step / 20) * (1 - 0.95 * step / steps)
            for k, g in net.gradients(codes[rows], owner, y[some]).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                net.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, quality, _text -> doc_id, quality and at most SAMPLE_CHUNKS chunks of each text, evenly spread."""
    for batch in batches:
        texts, out = batch.column("_text"), []
        for r in range(batch.num_rows):
            data = texts[r].as_buffer().to_pybytes()
            at = chunk_starts(len(data))
            if len(at) > SAMPLE_CHUNKS:
                at = [at[i * (len(at) - 1) // (SAMPLE_CHUNKS - 1)] for i in range(SAMPLE_CHUNKS)]
            out.append([data[a : a + CHUNK] for a in at])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(out, pa.list_(pa.binary()))], names=["doc_id", "quality", "chunks"])


def _trained(sample: pd.DataFrame) -> pd.DataFrame:
    sample = sample.assign(all=[b"".join(c) for c in sample["chunks"]]).sort_values(["doc_id", "quality", "all"])  # the same network from the same rows
    net = train([list(c) for c in sample["chunks"]], sample["quality"].tolist())
    return pd.DataFrame({"net": [pickle.dumps(net.p)]})


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network | float:
    """A network from at most ``rows`` labelled documents of each quality, drawn by a hash of doc_id; where only one
    quality (or none) is labelled, that share of label 1 (0.5 if none).

    Labels other than 0 and 1 and null ids teach nothing; a document with both labels teaches both. Of rows that
    share a doc_id the smallest text counts. Only the network, of fixed size, reaches the driver.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    share = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}  # two rows at most
    if len(share) < 2:
        return float(next(iter(share), 0.5))
    draw = F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(1 << 30))
    least = F.element_at(F.create_map(*[F.lit(x) for q, n in share.items() for x in (q, 3.0 * rows / n)]), F.col("quality"))
    best = Window.partitionBy("quality").orderBy("draw", "doc_id")  # about three times the rows wanted
    chosen = known.withColumn("draw", draw).where(F.col("draw") < least * float(1 << 30)).withColumn("place", F.row_number().over(best)).where(F.col("place") <= rows).select("doc_id", "quality")
    # at most 2 * rows ids: the texts are cut to chunks within the scan
    found = docs.select("doc_id", null_safe_text().alias("_text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "_text")
    few = found.mapInArrow(_sampled, "doc_id long, quality int, chunks array<binary>").groupBy("doc_id", "quality").agg(F.min("chunks").alias("chunks"))
    net = Network()
    net.p = pickle.loads(few.groupBy(F.lit(1).alias("one")).applyInPandas(_trained, "net binary").first()["net"])
    taught = {q: min(rows, n) for q, n in share.items()}
    net.offset = math.log(share[1] / share[0]) - math.log(taught[1] / taught[0])
    return net


def score(docs: DataFrame, model: Network | float, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from GOOD on) to ``docs``, from all bytes of each text; null texts are empty ones.

    Columns of those names are replaced; without ``keep_text`` the text stays behind.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def make():
        net = shared.value

        def judge(texts: list[str]) -> list[list]:
            if isinstance(net, float):
                found = [net] * len(texts)
            else:
                found = scored(net, [t.encode() for t in texts]).tolist()
            return [found, [int(x >= GOOD) for x in found]]

        return judge

    return with_columns(docs, text, "score double, predicted int", make, PIECE, keep_text)


def scored(net: Network, texts: list[bytes]) -> np.ndarray:
    """The score of each text; a long one passes in pieces of whole chunks."""
    total, n = np.zeros((len(texts), HIDDEN)), np.zeros(len(texts), dtype=np.int64)
    held, size = [], 0

    def flush() -> None:
        if held:
            codes, owner = chunks([b for _, b in held])
            t, k = net.scores(codes, owner, len(held))
            np.add.at(total, [i for i, _ in held], t)
            np.add.at(n, [i for i, _ in held], k)
            held.clear()

    whole = STEP * (PIECE // STEP)
    for i, t in enumerate(texts):
        # a piece of k steps has k chunks, those of the whole text
        for a in range(0, max(1, len(t) - (CHUNK - STEP)), whole):
            held.append((i, t[a : a + whole + CHUNK - STEP]))
            size += len(held[-1][1])
            if size >= PIECE:
                flush()
                size = 0
    flush()
    return net.probability(total, n)


def op12_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out())
    return score(docs.withColumn("held_out", held_out()), fit(docs, labels), keep_text=False)


OP12_SQL = None  # a trained model; tested by held-out accuracy and against plain loops
