"""Byte-level BPE encoding and decoding with the merges of a rank file, in time linear in the text.

Merging pair by pair costs the square of a piece's length in the plain form. Here a piece is covered from the left: at
each position the longest token that starts there is tried, then the longest token that is a prefix of it, and so on, and
a token is taken if it may stand beside the one before it. Two tokens may if the merges of their joint bytes give exactly
these two; that is decided by undoing the later merge of the two at a time and looking for a pair at the seam that would
have been merged earlier. A sequence whose neighbours are all compatible is what the merges give, and there is only one,
so the cover is exact. Where no token fits, the last one taken is given up and its end is marked as dead: no position is
entered from more than once, and as tokens have a bounded length the work is linear. Compatibility of pairs is remembered.

The longest token at a position comes from the automaton of all tokens: bytes are mapped to the Latin-1 characters of the
same number for it, and only the positions that a cover reaches are looked up.

Vocabularies whose merges do not reproduce each of their tokens in the order of the ranks are refused with a ValueError:
for these, neighbours alone do not decide. Special tokens are ordinary text.

Memory. A text is cut into the pattern's pieces as they are needed, so beside the text and its ids only a bounded number of
pieces is held; the memos of pieces and pairs are emptied when full.

Defined results: a null text counts as empty; an empty text has no ids; bytes that are not UTF-8 are read as U+FFFD;
repeated rows and null ids are kept; an empty table gives an empty result; columns besides doc_id and text are ignored.
Unknown ids, or ids cut in the middle, are a ValueError when decoding.
"""

from __future__ import annotations

import base64
import re
import struct
from functools import lru_cache
from itertools import islice

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Pieces and pairs that a task remembers, the longest piece (in characters) that is, and the pieces held at a time.
PIECES, PAIRS, PIECE, HELD = 250_000, 300_000, 48, 200_000
#: Rows whose texts, ids and bytes a task holds at a time.
ROWS = 1000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def pack(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids) if len(ids) <= PIECE else np.array(ids, "<u4").tobytes()


class _Pieces(dict):
    """Packed ids by piece, made when first asked for. When full it becomes the last generation, from which pieces that are asked
    for again come back, and starts anew: what is frequent stays, and there are two generations at most."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec = codec
        self.last: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.last.get(piece)
        if ids is None:
            ids = pack(self.codec.piece_ids(piece.encode()))
        if len(piece) <= PIECE:
            if len(self) >= PIECES:
                self.last = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one vocabulary. Ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN):
        if not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        self.ranks, self.bytes = ranks, {r: t for t, r in ranks.items()}
        self.base = max(self.bytes) + 1
        self.sizes = [len(self.bytes.get(r, b"")) for r in range(self.base)]
        self.longest = max(map(len, ranks))
        #: The longest other token that is a prefix of a token, -1 without one.
        self.shorter = [-1] * self.base
        for token, rank in ranks.items():
            self.shorter[rank] = next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), -1)
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        #: Remembered answers by left * base + right.
        self.beside: dict[int, bool] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self._split(token, rank)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        #: The longest token at the start of a node's string, for every node of the automaton.
        self.within: dict[str, int] = {}
        for token, rank in sorted(ranks.items()):
            chars = token.decode("latin-1")
            self.automaton.add_word(chars, rank)
            for k in range(1, len(chars) + 1):
                if chars[:k] not in self.within:
                    self.within[chars[:k]] = rank if k == len(chars) else self.within[chars[: k - 1]]
        self.split, self.unlike, self.split_like = _patterns(pattern)
        self.split_ascii = _ascii(pattern)
        self.pieces = _Pieces(self)

    def _split(self, token: bytes, rank: int) -> None:
        """Finds the last merge that makes a token: the one pair of earlier tokens that may stand side by side."""
        if len(token) == 1:
            self.parts[rank] = (rank, rank)
            return
        left = self.shorter[rank]
        while left >= 0:
            right = self.ranks.get(token[self.sizes[left] :])
            if right is not None and left < rank and right < rank and self._compatible(left, right):
                self.merged[left, right], self.parts[rank] = rank, (left, right)
                return
            left = self.shorter[left]
        raise ValueError(f"the merges do not make token {rank}")

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both gives exactly these two tokens: no pair at the seam, of the tokens as they were
        before any of their merges, comes before the merge that took it away. Of two equal ranks, that on the left is merged
        first."""
        limit = 1 << 40
        while True:
            if self.merged.get((left, right), limit) < limit:
                return False
            if left > right:  # the merge that made left is the later one: undo it
                limit, last = left, left
                left = self.parts[left][1]
                if left != last:
                    continue
                if self.sizes[right] == 1:
                    return True
                limit, right = right + 1, self.parts[right][0]
            else:
                limit, last = right + 1, right
                right = self.parts[right][0]
                if right != last:
                    continue
                if self.sizes[left] == 1:
                    return True
                limit, left = left, self.parts[left][1]

    def compatible(self, left: int, right: int) -> bool:
        """The same, remembered."""
        if len(self.beside) >= PAIRS:
            self.beside.clear()
        known = self.beside[left * self.base + right] = self._compatible(left, right)
        return known

    def piece_ids(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        chars, sizes, shorter, longest, n = piece.decode("latin-1"), self.sizes, self.shorter, self.longest, len(piece)
        reach, within, known, base = self.automaton.longest_prefix, self.within, self.beside.get, self.base
        dead, out, last, at = set(), [], -1, 0
        ahead = chars[:longest]
        token = within[ahead[: reach(ahead)]]
        while True:
            fits = last < 0 or known(last * base + token)
            if fits is None:
                fits = self.compatible(last, token)
            end = at + sizes[token]
            if fits and end not in dead:
                out.append(token)
                if end == n:
                    return out
                at, last, ahead = end, token, chars[end : end + longest]
                token = within[ahead[: reach(ahead)]]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:  # nothing fits here: give the last token up and never come back to this position
                dead.add(at)
                token = out.pop()
                at -= sizes[token]
                last = out[-1] if out else -1

    def encode(self, text: str) -> bytes:
        if text.isascii():
            rx = self.split_ascii
        else:
            plain = not self.unlike[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")].any()
            rx = self.split if plain else self.split_like
        get = self.pieces.__getitem__
        if len(text) <= HELD:
            return b"".join(map(get, rx.findall(text)))
        found, out = (m[0] for m in rx.finditer(text)), []
        while some := list(islice(found, HELD)):
            out.append(b"".join(map(get, some)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return unpack(self.bytes, ids)


def unpack(tokens: dict[int, bytes], ids: bytes) -> bytes:
    """The bytes of packed ids."""
    if len(ids) % 4:
        raise ValueError("the ids are cut")
    try:
        return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    except KeyError as e:
        raise ValueError(f"unknown id {e}") from None


def _matched(pattern: str) -> frozenset[str]:
    """Characters that tiktoken's regular expressions take for a class: those of all code points that it does not skip."""
    single = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    return frozenset(single.decode_bytes(single.encode_ordinary(every)).decode())


def _ascii(pattern: str):
    """The pattern for texts of ASCII alone, with the classes spelled out: the standard library is faster on these."""
    spelled, out, inside, i = {r"\p{L}": "A-Za-z", r"\p{N}": "0-9", r"\s": r"\t-\r\x20", r"\S": r"\x00-\x08\x0e-\x1f\x21-\x7f"}, "", False, 0
    while i < len(pattern):
        name = next((k for k in spelled if pattern.startswith(k, i)), None)
        if name:
            out += spelled[name] if inside else f"[{spelled[name]}]"
            i += len(name)
            continue
        step = 2 if pattern[i] == "\\" else 1
        inside = pattern[i] == "[" or (inside and pattern[i] != "]") if step == 1 else inside
        out, i = out + pattern[i : i + step], i + step
    return re.compile(out)


def _spelled(chars: list[str]) -> str:
    """Sorted characters as the ranges of a class."""
    starts = [c for i, c in enumerate(chars) if i == 0 or ord(chars[i - 1]) + 1 < ord(c)]
    ends = [c for i, c in enumerate(chars) if i + 1 == len(chars) or ord(c) + 1 < ord(chars[i + 1])]
    return "".join(f"\\U{ord(a):08x}-\\U{ord(b):08x}" for a, b in zip(starts, ends))


@lru_cache(4)
def _patterns(pattern: str):
    """The compiled pattern; a flag for each code point for which the two libraries' tables of letters and numbers differ, being
    of different versions of Unicode; and the pattern with these code points taken out of the classes."""
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    unlike = {k: sorted(set(regex.findall(k, every)) ^ _matched(k)) for k in (r"\p{L}", r"\p{N}")}
    if any(not regex.match(k, c) for k, cs in unlike.items() for c in cs):
        raise RuntimeError("regex has older Unicode tables than tiktoken")
    both = sorted({c for cs in unlike.values() for c in cs})
    flags = np.zeros(0x110000, bool)
    flags[[ord(c) for c in both]] = True
    if not both:
        return regex.compile(pattern), flags, regex.compile(pattern)
    spelled = {k: _spelled(cs) for k, cs in unlike.items()}
    own = pattern.replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\p{L}\p{N}]|[%s])" % "".join(spelled.values()))
    for k, chars in spelled.items():
        own = own.replace(f" ?{k}+", f" ?(?:(?![{chars}]){k})+" if chars else f" ?{k}+")
    return regex.compile(pattern), flags, regex.compile(own)


@lru_cache(2)
def token_bytes(path: str = VOCABULARY) -> dict[int, bytes]:
    """Token bytes by id: all that decoding needs."""
    return {r: t for t, r in read_ranks(path).items()}


@lru_cache(2)
def codec(path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> Codec:
    """One codec a process: tasks of the same worker share it."""
    return Codec(read_ranks(path), pattern)


def _encoded(batches, path: str, pattern: str):
    """Batches (doc_id, text as bytes) to (doc_id, n_tokens, ids)."""
    own = codec(path, pattern)
    for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
        ids = [own.encode(str(t, "utf-8", "replace")) if t else b"" for t in b.column(1).to_pylist()]
        yield pa.record_batch([b.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])


def _decoded(batches, path: str):
    """Batches (doc_id, n_tokens, ids) with the bytes of the ids."""
    tokens = token_bytes(path)
    for b in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
        made = pa.array([unpack(tokens, i) if i else b"" for i in b.column(2).to_pylist()], pa.binary())
        yield pa.record_batch([*b.columns, made], names=["doc_id", "n_tokens", "ids", "decoded"])


def _texts(docs: DataFrame) -> tuple[DataFrame, str]:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")), f"doc_id {kind}, n_tokens long, ids binary"


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens long, ids binary): the ids of each whole text, little-endian unsigned 32-bit integers."""
    texts, schema = _texts(docs)
    return texts.mapInArrow(lambda batches: _encoded(batches, path, pattern), schema)


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded binary): the bytes of each row's ids."""
    kind = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "n_tokens", "ids").mapInArrow(lambda batches: _decoded(batches, path), f"doc_id {kind}, n_tokens long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of the ids of each text, and of the bytes they decode to. Encoding
    and decoding share a worker, so texts cross to it once."""
    texts, schema = _texts(docs)
    both = texts.mapInArrow(lambda batches: _decoded(_encoded(batches, path, pattern), path), f"{schema}, decoded binary")
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
