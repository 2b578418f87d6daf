import hashlib
import random
import struct

import pytest
import tiktoken

from tidewell.llm import bpe as B

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    return B.codec(PATH, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=B.load_ranks(PATH), special_tokens={})


def test_equals_the_library(both):
    codec, library = both
    r = random.Random(5)
    alphabet = "abcdehinorst '  \n\t\x1c\x85\xa0éüñß漢字カナ🙂한국123٣.,!?-_’sdtm"
    any_char = [chr(c) for c in (r.randrange(32, 0x2FFFF) for _ in range(3000)) if not 0xD800 <= c < 0xE000]
    texts = ["".join(r.choice(alphabet if i % 3 else any_char) for _ in range(r.randrange(60))) for i in range(4000)]
    texts += ["", "<|endoftext|>", "a" * 5000, "ab" * 3000, " " * 300 + "x", "the " * 4000, "can't WON'T 'S"]
    for t in texts:
        ids = library.encode_ordinary(t)
        assert codec.encode(t) == struct.pack(f"<{len(ids)}I", *ids), t[:80]
        assert "".join(codec.decode(codec.parts(t), chunk=3)) == t


def test_segments_and_resets(both, monkeypatch):
    codec, library = both
    text = "The quick brown fox isn't, as 12 say, über  alles \n\n" * 40
    ids = library.encode_ordinary(text)
    for name, value in (("SEGMENT", 37), ("MAX_STATES", 50), ("MAX_PIECES", 5), ("MAX_PAIRS", 10), ("MAX_EDGES", 10), ("MAX_MOVES", 70), ("KEPT_PIECE", 3)):
        monkeypatch.setattr(B, name, value)
    assert B.Codec(PATH, P.PATTERN).encode(text) == struct.pack(f"<{len(ids)}I", *ids)


def test_tokens_are_emitted_after_bounded_lookahead(both, monkeypatch):
    """Within one long piece too, and with states that are forgotten on the way."""
    codec, library = both
    r = random.Random(3)
    for name, value in (("LOOKAHEAD", 16), ("MAX_STATES", 40)):
        monkeypatch.setattr(B, name, value)
    t = codec.transducer
    longest = max(t.sizes.values())
    for piece in ("a" * 3000, "".join(r.choice("etaoinshr") for _ in range(3000)), "漢字仮名" * 500, "é" * 1000, "ab" * 1500):
        data, out, read = piece.encode(), [], 0
        for part in t.emit(data):
            out += part
            read += 16
            assert sum(t.sizes[i] for i in out) >= min(read, len(data)) - 2 * longest
        assert out == library.encode_ordinary(piece) and len(t.live) <= 40 + 17


def test_utf8_stream():
    data = "aé漢🙂".encode() * 3
    for size in (1, 2, 3, 5):
        s = B.Utf8Stream()
        assert "".join(s.feed(data[i : i + size]) for i in range(0, len(data), size)) + s.feed(b"", True) == data.decode()
    s = B.Utf8Stream()
    assert s.feed(b"\xf0\x9f") + s.feed(b"", True) == "�"


def test_frame(spark):
    df = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "é the", 7), (3, "é the", 7)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id, r.n_tokens, r.decoded_sha256, len(r.ids)) for r in B.bpe(df, PATH, P.PATTERN, with_ids=True).collect())
    empty = hashlib.sha256(b"").hexdigest()
    assert got[:2] == [(1, 0, empty, 0), (2, 0, empty, 0)] and got[2] == got[3]
    assert got[2][2] == hashlib.sha256("é the".encode()).hexdigest() and got[2][3] == 4 * got[2][1]
    assert B.bpe(df.limit(0), PATH, P.PATTERN).count() == 0
