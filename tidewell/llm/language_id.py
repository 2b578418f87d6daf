"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes, counted on a bounded
sample of labelled rows and then frozen. A byte costs what its longest seen context
gives it; a byte that a context has not seen costs the context's escape (method C:
as many chances as the context has distinct bytes) and then what the next shorter
context gives it, down to eight bits. A text's exact code length under each language
is the sum over its bytes, and the shortest wins.

The trees are compiled into one table of costs by context and byte, so that scoring is
two look-ups a byte for all languages together.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import steps, with_columns

#: Bound of the labelled sample, in rows for each language.
SAMPLE_ROWS = 400
#: Bytes that are scored at once; bounds a worker's RAM.
PIECE = 250_000
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")
_START = b"\n\n\n"  # a text begins as if after line ends


class Model:
    """Frozen statistics: languages, the class of each byte, the row of each three-byte context, and cost[row, class, language] in bits."""

    def __init__(self, counts: pd.DataFrame, max_contexts: int | None = None):
        """counts: lang, code (four bytes as a number) and n. All contexts of the sample are kept; ``max_contexts``,
        for samples of very many languages, keeps only so many contexts of three bytes, the most frequent."""
        self.languages = sorted(counts["lang"].unique())
        n_l = len(self.languages)
        if not n_l:
            return
        code = counts["code"].to_numpy(np.int64)
        n = counts["n"].to_numpy(np.float64)
        lang = counts["lang"].map({x: i for i, x in enumerate(self.languages)}).to_numpy(np.int64)
        known = np.unique(np.concatenate([np.frombuffer(_START, np.uint8), np.unique(code & 255)]))
        self.of_byte = np.zeros(256, dtype=np.int64)  # class 0: bytes never seen
        self.of_byte[known] = np.arange(1, len(known) + 1)
        a = self.size = len(known) + 1
        b0, b1, b2, s = (self.of_byte[(code >> k) & 255] for k in (24, 16, 8, 0))
        cost = np.full((1, a, n_l), 8.0)  # below all contexts
        cost, _ = self._order(np.zeros(len(s), np.int64), s, lang, n, cost, np.zeros(1, np.int64), 1)
        one, rows1 = self._order(b2, s, lang, n, cost, np.zeros(a, np.int64), a)
        # contexts of two bytes, then the most frequent of three; each row falls back on its shorter context's
        keys2 = np.unique(b1 * a + b2)
        two, _ = self._order(np.searchsorted(keys2, b1 * a + b2), s, lang, n, one, keys2 % a, len(keys2))
        ctx3 = (b0 * a + b1) * a + b2
        keys3, inverse = np.unique(ctx3, return_inverse=True)
        weight = np.bincount(inverse, weights=n)
        kept = np.sort(np.lexsort((keys3, -weight))[:max_contexts])
        keys3 = keys3[kept]
        at = np.searchsorted(keys3, ctx3)
        hit = keys3[np.minimum(at, len(keys3) - 1)] == ctx3
        three, _ = self._order(at[hit], s[hit], lang[hit], n[hit], two, np.searchsorted(keys2, keys3 % (a * a)), len(keys3))
        self.cost = np.concatenate([one, two, three]).astype(np.float32)
        row = np.tile(np.arange(a, dtype=np.int32), a * a)
        by_two = np.arange(a, dtype=np.int64)[:, None] * (a * a) + keys2[None, :]
        row[by_two.ravel()] = np.tile(a + np.arange(len(keys2), dtype=np.int32), a)
        row[keys3] = a + len(keys2) + np.arange(len(keys3), dtype=np.int32)
        self.row = row

    def _order(self, context, symbol, lang, n, shorter, shorter_row, rows):
        """Costs of one order: cost[context, class, language]."""
        seen = np.zeros((rows, self.size, len(self.languages)))
        np.add.at(seen, (context, symbol, lang), n)
        total, distinct = seen.sum(axis=1, keepdims=True), (seen > 0).sum(axis=1, keepdims=True)
        below = shorter[shorter_row]
        with np.errstate(divide="ignore", invalid="ignore"):
            here = -np.log2(seen / (total + distinct))
            escape = -np.log2(distinct / (total + distinct))
        cost = np.where(total == 0, below, np.where(seen > 0, here, escape + below))
        return cost, None

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text under each language: an exact sum over all its bytes, a long text piece by piece."""
        out = np.zeros((len(texts), len(self.languages)))
        pieces = [(i, t[at - 3 : at] if at else _START, t[at : at + PIECE]) for i, t in enumerate(texts) for at in range(0, len(t), PIECE)]
        for a, b in steps(pieces, (len(p[2]) for p in pieces), PIECE):
            some = pieces[a:b]
            sizes = np.array([len(p[2]) for p in some], dtype=np.int64)
            buf = np.frombuffer(b"".join(x + y for _, x, y in some), dtype=np.uint8)
            c = self.of_byte[buf]
            context = (c[:-3] * self.size + c[1:-2]) * self.size + c[2:-1]
            first = np.concatenate([[0], np.cumsum(sizes + 3)[:-1]])
            last = first + sizes
            bits = self.cost[self.row[context], c[3:]]
            # between two texts stand three places that count for none
            sums = np.add.reduceat(bits, np.stack([first, np.minimum(last, len(bits) - 1)], axis=1).ravel(), axis=0, dtype=np.float64)[::2]
            sums[-1] = bits[first[-1] :].sum(axis=0, dtype=np.float64)
            np.add.at(out, [p[0] for p in some], sums)
        return out


def fourgrams(batches):
    """lang and _text -> lang, code and n: bytes with the three before them."""
    for pdf in batches:
        for lang, texts in pdf.groupby("lang", sort=False)["_text"]:
            values = texts.tolist()
            for a, b in steps(values, map(len, values)):
                parts = [t.encode() for t in values[a:b]]
                x = np.frombuffer(b"".join(_START + t for t in parts), dtype=np.uint8).astype(np.int64)
                code = (x[:-3] << 24) | (x[1:-2] << 16) | (x[2:-1] << 8) | x[3:]
                ends = np.cumsum([len(t) + 3 for t in parts])[:-1] - 3
                code = np.delete(code, np.add.outer(ends, np.arange(3)).ravel())  # the bytes before a text are no bytes of it
                code, n = np.unique(code, return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": code, "n": n})


def fit(labelled: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", rows: int = SAMPLE_ROWS) -> Model:
    """A model of the languages of ``labelled``, from at most ``rows`` whole texts of each, drawn by a hash of ``key``.

    Rows with a null language or text teach nothing. Only counts reach the driver.
    """
    known = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("_text"))
    # first a share of each language that holds three times the rows wanted, then the rows by rank
    share = known.groupBy("lang").agg((F.lit(3.0 * rows) / F.count("*")).alias("share"))
    draw = F.pmod(F.xxhash64(F.lit(11), F.col("key")), F.lit(1 << 30))
    # share has one row a language, as the model has; broadcast, it filters within the scan, and only about 3 * rows texts of a language are moved
    near = known.withColumn("draw", draw).join(F.broadcast(share), "lang").where(F.col("draw") < F.col("share") * float(1 << 30))
    best = Window.partitionBy("lang").orderBy("draw", "key", F.xxhash64("_text"))
    sample = near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= rows).select("lang", "_text")
    counts = sample.mapInPandas(fourgrams, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    return Model(counts.toPandas())


def predict(docs: DataFrame, model: Model, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Add lang_pred and score to ``docs``.

    lang_pred is the language with the shortest code, ties to the smaller name; score is
    its posterior under equal priors. Null texts and texts without a letter are 'und'
    with score 0, and so is every text if nothing was learned. Columns of those names
    are replaced; without ``keep_text`` the text stays behind.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def make():
        m: Model = shared.value

        def guess(texts: list[str]) -> list[list]:
            names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            some = [i for i, t in enumerate(texts) if m.languages and _LETTER.search(t)]
            if some:
                bits = m.code_lengths([texts[i].encode() for i in some])
                sure = 1.0 / np.exp2(bits.min(axis=1, keepdims=True) - bits).sum(axis=1)
                for i, best, score in zip(some, bits.argmin(axis=1).tolist(), sure.tolist()):
                    names[i], scores[i] = m.languages[best], score
            return [names, scores]

        return guess

    return with_columns(docs, text, "lang_pred string, score double", make, PIECE, keep_text)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), model, keep_text=False)


OP2_SQL = None  # a trained model; tested by held-out accuracy and against a plain PPM
