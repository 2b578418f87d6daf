import pandas as pd
import numpy as np

from tests.llm.test_near_dedup import classes
from tidewell.llm import near_dedup as N


def pairs(n, repeats):
    """Texts of 60 words, and the same followed by a line of ten words many times: 56 of 70 shingles are shared."""
    out = []
    for g in range(n):
        base = " ".join(f"g{g}w{i}" for i in range(60))
        out += [(2 * g, base), (2 * g + 1, base + f" {' '.join(f'g{g}r{i}' for i in range(10))}" * repeats)]
    return out


def test_a_repeated_line_does_not_hide_a_link(spark):
    rows = pairs(40, 1000)
    got = {(x.doc_id, x.class_id) for x in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == classes(rows) == {(i, i - i % 2) for i, _ in rows}


def test_bands_agree_as_the_verified_similarity():
    """A band is four registers, each of which agrees with the chance of the similarity."""
    rows = pairs(100, 1000)
    bands = [x for pdf in N._bands([pd.DataFrame(rows, columns=["id", "_text"])]) for x in pdf["bands"]]
    assert abs(np.mean([(a == b).mean() for a, b in zip(bands[::2], bands[1::2])]) - 0.8**4) < 0.04
