"""Byte-pair encoding and decoding with forced boundaries.

A byte pair that occurs inside no token of the vocabulary can never be merged, so
the text may be cut there and the fragments encoded independently: their ids,
concatenated, are those of the whole text. The pairs are read off the vocabulary, and
cuts are made in two steps. Across the text, where the pre-tokenizer divides as well
whatever stands around: before an ASCII space or line feed that follows a character
which is no white space. These parts repeat a lot, so that a worker encodes most of
them once. Then each pre-token of a part is cut at every forced pair, between bytes
of a character as well, and its fragments are merged each by itself.

Defined results: a null text counts as empty; an empty text has no ids. Strings of
special tokens inside a text become those tokens, as in the library. Ids decode to
exactly the text. Null ids, repeated rows and further columns pass through; an
empty table gives an empty result. Texts are encoded whole.
"""

from __future__ import annotations

import functools
import json
import re
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Most fragments a worker remembers.
MEMORY = 500_000
#: Ids that are decoded at a time.
BLOCK = 100_000
#: White space in the widest sense of any library; a cut follows none of it.
WIDE_SPACE = "\t-\r\x1c-\x20\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_RUN = re.compile(f"[{WIDE_SPACE}][{WIDE_SPACE}]")
#: White space other than the four that all libraries agree on.
_ODD = re.compile(f"[{WIDE_SPACE}]".replace("\t-\r", "\x0b\x0c").replace("\x1c-\x20", "\x1c-\x1f"))


def byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: printable bytes of
    Latin-1 stand for themselves, the others for the code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary, from its public JSON file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.special = special
        self.tokens: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in data["model"]["vocab"].items() if t not in special}
        self.bytes_of = dict(self.tokens) | {i: t.encode() for t, i in special.items()}
        inside = np.zeros((256, 256), bool)
        for t in self.tokens.values():
            if len(t) > 1:
                b = np.frombuffer(t, np.uint8)
                inside[b[:-1], b[1:]] = True
        #: [a, b]: the pair never occurs inside a token
        self.forced = ~inside
        self._forced = self.forced.astype(np.uint8).tobytes()
        ids = {t: i for i, t in self.tokens.items()}
        # ranks are the order of merges: the single bytes, then each merge's product
        single = sorted((bytes([b]) for b in range(256)), key=ids.__getitem__)
        merged = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        products = [bytes(letters[c] for c in a + b) for a, b in merged]
        order = list(dict.fromkeys([*single, *products]))
        self._ids = None if all(ids[t] == r for r, t in enumerate(order)) else [ids[t] for t in order]
        coder = tiktoken.Encoding("fragments", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: r for r, t in enumerate(order)}, special_tokens={})
        self._ordinary, self._single = coder._core_bpe.encode_ordinary, coder._core_bpe.encode_single_piece
        self._pieces = regex.compile(public_tokenizers.PATTERN).findall
        self._split = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        # parts that are left to the library: other white space, special tokens
        self._other = re.compile("|".join([_ODD.pattern, *map(re.escape, special)]))
        # characters whose last byte does occur before a space or a line feed inside a token
        kept = {b for b in range(256) if not (self.forced[b, 32] and self.forced[b, 10])}
        ascii_kept = {b for b in kept if b < 128}
        # (those beyond the basic plane all count as such: one range, quickly matched)
        wide = "".join(re.escape(chr(c)) for c in range(128, 0x10000) if 128 + c % 64 in kept and not 0xD800 <= c < 0xE000) + "\U00010000-\U0010ffff"
        own = wide + "".join(re.escape(chr(b)) for b in sorted(ascii_kept))
        self._held = re.compile(f"[{own}](?=[ \n])")
        self._cut = re.compile(f"(?<![{WIDE_SPACE}{own}])(?<!^)(?=[ \n])")
        self._memory = _Fragments(self)
        # [id]: place and length of a token's bytes in one table of all of them
        top = max(self.bytes_of) + 1
        rows = [self.bytes_of.get(i, b"") for i in range(top)]
        self._lengths = np.array([len(r) for r in rows], np.int64)
        self._places = np.cumsum(self._lengths) - self._lengths
        self._table = np.frombuffer(b"".join(rows), np.uint8)

    def encode_whole(self, text: str) -> list[int]:
        """Ids of a text, without any cut."""
        parts = self._split.split(text) if self._split and self._split.search(text) else [text]
        out: list[int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                ranks = self._ordinary(part)
                out += ranks if self._ids is None else [self._ids[r] for r in ranks]
        return out

    def forced_parts(self, piece: bytes) -> list[bytes]:
        """A pre-token, cut at every byte pair that is inside no token."""
        table = self._forced
        cuts = [k for k, (a, b) in enumerate(zip(piece, piece[1:]), 1) if table[a << 8 | b]]
        return [piece[i:j] for i, j in zip([0, *cuts], [*cuts, len(piece)])] if cuts else [piece]

    def encode_part(self, part: str) -> list[int]:
        """Ids of a part, its pre-tokens cut at their forced boundaries."""
        if self._other.search(part):
            return self.encode_whole(part)
        single, ranks = self._single, []
        for piece in self._pieces(part):
            for x in self.forced_parts(piece.encode()):
                ranks += single(x)
        return ranks if self._ids is None else [self._ids[r] for r in ranks]

    def fragments(self, text: str) -> list[str]:
        """The text, cut at its forced boundaries."""
        if "\0" in text or "\1" in text or _RUN.search(text):
            return [x for x in self._cut.split(text) if x]
        # no white space beside white space: each space and line feed is a cut but after a held character
        text = self._held.sub("\\g<0>\1", text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").replace("\1\0", "").split("\0")

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([*map(self._memory.__getitem__, self.fragments(text))]), np.int32)

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Texts of lists of ids that lie end to end in ``ids``, some lists at a time."""
        parts, a = [], 0
        while a < len(offsets) - 1:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + BLOCK, "right")) - 1)
            parts.append(self._decode_block(ids[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            a = b
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    def _decode_block(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        lengths = self._lengths[ids]
        ends = np.r_[0, np.cumsum(lengths)]
        at = np.repeat(self._places[ids] - ends[:-1], lengths) + np.arange(ends[-1])
        data = self._table[at]
        bounds = ends[offsets]
        starts = bounds[:-1][bounds[:-1] < len(data)]
        if (data[starts] & 0xC0 == 0x80).any() or not _is_utf8(data):
            return pa.array([data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:])], pa.string())
        return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])

    def decode(self, ids: list[int]) -> str:
        """Text of ids; a cut through a character shows as U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class _Fragments(dict):
    """Bytes of the ids of fragments met so far."""

    def __init__(self, owner: Vocabulary) -> None:
        self._owner = owner

    def __missing__(self, fragment: str) -> bytes:
        ids = array("i", self._owner.encode_part(fragment)).tobytes()
        if len(self) >= MEMORY:
            self.clear()
        if len(fragment) <= 64:
            self[fragment] = ids
        return ids


def _is_utf8(data: np.ndarray) -> bool:
    try:
        data.tobytes().decode()
    except UnicodeDecodeError:
        return False
    return True


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _arrays(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def encoder(path: str) -> Callable[[Column], Column]:
    """A Column function: text to array<int> of ids."""

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        v = vocabulary(path)
        # a few texts at a time as Python strings, and their ids as one array
        done = [_arrays([v.encode(x.as_py() or "") for x in texts.slice(k, 64)]) for k in range(0, len(texts), 64)]
        return pa.concat_arrays(done) if done else _arrays([])

    return encode


def decoder(path: str) -> Callable[[Column], Column]:
    """A Column function: array<int> of ids to text; null stays null."""

    @F.arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        v = vocabulary(path)
        filled = pc.fill_null(ids, [])
        out = v.decode_all(filled.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(pc.list_value_length(filled).to_numpy(zero_copy_only=False))])
        return pc.if_else(ids.is_valid(), out, None)

    return decode


def op7_bpe_forced_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = docs.select("doc_id", encoder(path)(F.col("text")).alias("ids"))
    back = coded.select("doc_id", "ids", decoder(path)(F.col("ids")).alias("decoded"))
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
