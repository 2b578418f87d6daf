"""Byte-level BPE by a lazily determinised finite-state transducer.

A token sequence is the BPE encoding of its bytes exactly if every two neighbours stay
as they are when they are merged alone. Encoding is thus a walk of a nondeterministic
transducer whose states are (last token, bytes read since); a token is completed where
its bytes are read and it may follow the last one. The subset construction runs lazily,
a state for each set of live hypotheses, and a transition tells the one token that can
end there. Tokens before the place where all live hypotheses part are certain and are
emitted after every LOOKAHEAD bytes of a piece, so that only the open end is held. No
hypothesis lives longer than the longest token. States and transitions are kept and
shared by all texts of a worker, up to stated numbers.

Decoding maps ids to bytes and feeds them to an incremental UTF-8 state machine that
holds back an incomplete character until its rest arrives.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import with_columns

#: Bounds of a worker's RAM: states of the transducer, its transitions, pairs and edges of tokens, and pieces whose ids are kept;
#: code points of a piece that is kept and of a segment.
MAX_STATES, MAX_MOVES, MAX_PAIRS, MAX_EDGES, MAX_PIECES = 160_000, 400_000, 300_000, 60_000, 400_000
KEPT_PIECE, SEGMENT = 64, 1_000_000
#: Bytes of a piece after which tokens that are certain are emitted.
LOOKAHEAD = 512


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int], parts: int = 1) -> list[bytes]:
    """Plain BPE: merge the leftmost pair of lowest rank until none is left or ``parts`` remain."""
    got = [piece[i : i + 1] for i in range(len(piece))]
    while len(got) > parts:
        rank, at = min(((ranks.get(got[i] + got[i + 1], 1 << 60), i) for i in range(len(got) - 1)), default=(1 << 60, 0))
        if rank == 1 << 60:
            break
        got[at : at + 2] = [got[at] + got[at + 1]]
    return got


class Transducer:
    """States are numbers; ``live[state]`` is the longest bytes read since a token, then (last
    token, number of bytes) of each hypothesis, most bytes first, as one flat tuple.
    ``moves[state << 8 | byte]`` is next state << 20 | the token that can end there."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.sizes = {v: len(k) for k, v in ranks.items()}
        self.prefixes = {t[:i] for t in ranks for i in range(1, len(t))}
        self.pairs: dict[int, bool] = {}
        self.edges: dict[tuple[bytes, int], tuple] = {}
        self._reset()

    def _reset(self, state: int = 0) -> int:
        """Forget all states but the first and ``state``, whose new number is returned."""
        known = self.live[state] if state else ()
        self.numbers: dict[tuple, int] = {}
        self.live: list[tuple] = []
        self.moves: dict[int, int] = {}
        self._state((b"", -1, 0))
        return self._state(known) if known else 0

    def _state(self, live: tuple) -> int:
        got = self.numbers.get(live)
        if got is None:
            got = self.numbers[live] = len(self.live)
            self.live.append(live)
        return got

    def _edge(self, token: bytes, side: int) -> tuple:
        """The tokens that stand at one edge while ``token`` is merged, each with the rank that ends its time; None if merging never makes it."""
        key = (token, side)
        if key not in self.edges:
            chain, cur, until = [], token, 1 << 60
            while True:
                chain.append((cur, until))
                if len(cur) == 1:
                    break
                two = merge(cur, self.ranks, 2)
                if len(two) != 2 or two[0] + two[1] not in self.ranks:
                    chain = None
                    break
                until, cur = self.ranks[cur], two[side]
            if len(self.edges) > MAX_EDGES:
                self.edges.clear()
            self.edges[key] = chain
        return self.edges[key]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the tokens a, b are what merging their bytes gives."""
        if a < 0:
            return self._edge(self.bytes_of[b], 0) is not None
        key = a << 20 | b
        got = self.pairs.get(key)
        if got is None:
            left, right = self._edge(self.bytes_of[a], 1), self._edge(self.bytes_of[b], 0)
            got = left is not None and right is not None and not self._crossed(left, right)
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            self.pairs[key] = got
        return got

    def _crossed(self, left: list, right: list) -> bool:
        """Whether a pair across two tokens merges before either side is done with it."""
        ranks = self.ranks
        for x, x_until in left:
            for y, y_until in right:
                m = ranks.get(x + y)
                if m is not None and m < x_until and m <= y_until:
                    return True
        return False

    def _step(self, state: int, byte: bytes) -> int:
        """The next state, and the one token that can end here."""
        known = self.live[state]
        read = known[0] + byte
        n, ended, longest, live = len(read) - 1, -1, b"", []
        for i in range(1, len(known), 2):
            last, size = known[i], known[i + 1]
            mine = read[n - size :]
            if ended < 0:
                rank = self.ranks.get(mine)
                if rank is not None and self.may_follow(last, rank):
                    ended = rank
            if mine in self.prefixes:
                if not live:
                    longest = mine
                live += (last, size + 1)
        to = self._state((longest, *live, ended, 0))
        self.moves[state << 8 | byte[0]] = move = to << 20 | ended
        return move

    def emit(self, piece: bytes) -> Iterator[list[int]]:
        """The ids of one piece, in parts: a part is emitted once it is certain, at most LOOKAHEAD bytes and the open end later.

        Every prefix has one encoding; a transition tells its last token. The encodings of
        the places where live hypotheses began are one up to where they part.
        """
        state, ends = 0, []
        for at in range(0, len(piece), LOOKAHEAD):
            if len(self.live) > MAX_STATES or len(self.moves) > MAX_MOVES:
                state = self._reset(state)
            moves = self.moves
            for byte in piece[at : at + LOOKAHEAD]:
                move = moves.get(state << 8 | byte)
                if move is None:
                    move = self._step(state, bytes((byte,)))
                state = move >> 20
                ends.append(move & 0xFFFFF)
            sure = len(ends) if at + LOOKAHEAD >= len(piece) else self._parting(state, ends)
            out, i, sizes = [], sure, self.sizes
            while i:
                token = ends[i - 1]
                out.append(token)
                i -= sizes[token]
            del ends[:sure]
            out.reverse()
            yield out

    def _parting(self, state: int, ends: list[int]) -> int:
        """The last place that the encodings of all live hypotheses share."""
        starts = {len(ends) - size for size in self.live[state][2::2]}
        while len(starts) > 1:
            last = max(starts)
            starts.remove(last)
            starts.add(last - self.sizes[ends[last - 1]])
        return starts.pop()

    def encode(self, piece: bytes) -> bytes:
        """The ids of one piece as little-endian unsigned 32-bit integers."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return struct.pack("<I", whole)
        return b"".join([struct.pack(f"<{len(part)}I", *part) for part in self.emit(piece)])


class Utf8Stream:
    """Incremental UTF-8: text of the bytes fed so far, less an incomplete last character."""

    def __init__(self, errors: str = "replace"):
        self.held, self.errors = b"", errors

    def feed(self, data: bytes, final: bool = False) -> str:
        data = self.held + data
        self.held = b""
        if not final:
            for back in range(1, min(3, len(data)) + 1):
                b = data[-back]
                if b >= 0xC0:  # a lead byte: how many bytes does its character have?
                    if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4):
                        data, self.held = data[:-back], data[-back:]
                    break
                if b < 0x80:
                    break
        return data.decode("utf-8", self.errors)


@functools.lru_cache(1)
def _classes() -> tuple[str, str, str]:
    """Character classes for re, which is faster: letters, numbers and white space as
    the tiktoken library's pattern engine knows them (Unicode versions differ)."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([i]): i for i in range(256)}

    def members(pattern: str) -> str:
        found = tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
        codes = np.frombuffer(bytes(found).decode("utf-8").encode("utf-32-le"), dtype="<u4")
        first = np.flatnonzero(np.diff(codes, prepend=-2) != 1)
        last = np.append(first[1:], len(codes)) - 1
        return "".join(f"{re.escape(chr(codes[a]))}-{re.escape(chr(codes[b]))}" for a, b in zip(first, last))

    return members(r"\p{L}"), members(r"\p{N}"), members(r"\s")


def split_pattern(pattern: str) -> re.Pattern:
    """``pattern`` with its Unicode classes spelled out."""
    letters, numbers, white = _classes()
    p = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{white}{letters}{numbers}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]")
    return re.compile(p.replace(r"\S", f"[^{white}]").replace(r"\s", f"[{white}]"))


class _Pieces(dict):
    def __init__(self, transducer: Transducer):
        self.transducer = transducer

    def __missing__(self, piece: str) -> bytes:
        got = self.transducer.encode(piece.encode())
        if len(piece) <= KEPT_PIECE:
            if len(self) >= MAX_PIECES:
                self.clear()
            self[piece] = got
        return got


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(load_ranks(path))
        self.pieces, self.pattern = _Pieces(self.transducer), split_pattern(pattern)
        self.cut = re.compile(f"[{_classes()[0]}](?= [{_classes()[0]}])")  # between these two a piece always ends
        self.table = self.transducer.bytes_of

    def forget(self) -> None:
        """Drop what texts have left: a worker that waits holds the ranks and the pattern only."""
        self.pieces.clear()
        for known in (self.transducer.pairs, self.transducer.edges):
            known.clear()
        self.transducer._reset()

    def segments(self, text: str):
        at = 0
        while len(text) - at > SEGMENT:
            m = self.cut.search(text, at + SEGMENT)
            if m is None:
                break
            yield text[at : m.end()]
            at = m.end()
        yield text[at:] if at else text

    def parts(self, text: str) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, in parts of some pieces."""
        for segment in self.segments(text):
            pieces = (m[0] for m in self.pattern.finditer(segment)) if len(segment) > 2 * SEGMENT else iter(self.pattern.findall(segment))
            while part := list(islice(pieces, 1 << 16)):
                yield b"".join(map(self.pieces.__getitem__, part))

    def encode(self, text: str) -> bytes:
        return b"".join(self.parts(text))

    def decode(self, parts: Iterable[bytes], chunk: int = 4096) -> Iterator[str]:
        """The text of packed ids, in parts."""
        stream, table = Utf8Stream(), self.table
        for ids in parts:
            for at in range(0, len(ids), 4 * chunk):
                part = np.frombuffer(ids[at : at + 4 * chunk], dtype="<u4").tolist()
                yield stream.feed(b"".join([table[i] for i in part]))
        yield stream.feed(b"", final=True)


@functools.lru_cache(1)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def bpe(docs: DataFrame, path: str, pattern: str, text: str = "text", with_ids: bool = False, keep_text: bool = True) -> DataFrame:
    """Add n_tokens, ids_sha256, decoded_sha256 (and ids: binary, if asked) to ``docs``.

    The whole of every text is encoded, a null as an empty one, and the ids are decoded
    again. Columns of those names are replaced; without ``keep_text`` the text stays behind.
    """
    added = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def row(c: Codec, text: str) -> tuple:
        n, forth, back, held = 0, hashlib.sha256(), hashlib.sha256(), []

        def seen(parts):
            nonlocal n
            for part in parts:
                n += len(part) // 4
                forth.update(part)
                if with_ids:
                    held.append(part)
                yield part

        for part in c.decode(seen(c.parts(text))):
            back.update(part.encode())
        return (n, forth.hexdigest(), back.hexdigest(), *([b"".join(held)] if with_ids else []))

    def make():
        c = codec(path, pattern)
        return lambda texts: list(zip(*[row(c, t) for t in texts]))

    return with_columns(docs, text, added, make, keep_text=keep_text, release=lambda: codec(path, pattern).forget())


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return bpe(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_text=False)


OP3_SQL = None  # not expressible; tested against the tiktoken library and by the exact round trip
