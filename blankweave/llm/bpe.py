"""Byte-level BPE with chunks that are encoded once.

A rolling hash over the bytes of a text marks content-defined cuts, so passages that
documents share are cut alike. Each distinct chunk a task meets is encoded once and kept,
up to a bound of bytes. A cut may fall inside a token or a pre-token. Therefore a chunk
keeps only the ids between its first and its last certain bound, a place where the
pre-tokeniser splits whatever stands around it (a blank between two characters that
aren't white space, the second a letter); the loose ends on both sides of a cut are joined and
encoded together, over as many chunks as have no such bound. So the ids agree with
those of the whole text; joins are kept like chunks.

The vocabulary is read from the tokenizer's JSON file, whose path is a parameter; merge
order is id order there. Strings of special tokens in a text become those tokens, as the
tokenizers library does.

Defined results: null or empty text has no ids and decodes to empty text; very long texts
without any bound are encoded whole; rows of a repeated doc_id are encoded row by row; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

CHUNK_BYTES, WINDOW = 256, 16
CACHE_BYTES = 24 << 20

#: Fixed value: the pre-tokeniser's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BOUND = regex.compile(r"(?<=\S)(?= \p{L})")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(0x100 + i): b for i, b in enumerate(rest)}}


class Codec:
    """Encoder and decoder of one vocabulary file, with the chunks met so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.library = tiktoken.Encoding("chunks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.special = {k.encode(): v for k, v in special.items()}
        self.pieces = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for token, i in [*ranks.items(), *self.special.items()]:
            self.pieces[i] = token
        self.splitter = regex.compile(b"(" + b"|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + b")") if special else None
        self.kept: dict[bytes, tuple] = {}
        self.joined: dict[bytes, bytes] = {}
        self.size = 0

    def ids(self, text: str) -> bytes:
        return array("I", self.library.encode_ordinary(text)).tobytes()

    def _room(self, n: int) -> None:
        self.size += n
        if self.size > CACHE_BYTES:
            self.kept.clear()
            self.joined.clear()
            self.size = n

    def chunk(self, raw: bytes) -> tuple:
        """(head, ids between the first and the last bound, tail), or (None, b"", text) without a bound."""
        got = self.kept.get(raw)
        if got is None:
            text = raw.decode()
            first = _BOUND.search(text)
            if first is None:
                got = (None, b"", text)
            else:
                last = first.start()
                for m in _BOUND.finditer(text, max(last, len(text) - 64)):
                    last = m.start()
                got = (text[: first.start()], self.ids(text[first.start() : last]), text[last:])
            self.kept[raw] = got
            self._room(len(raw) * 3 + len(got[1]) + 300)
        return got

    def join(self, text: str) -> bytes:
        if len(text) > 4 * CHUNK_BYTES:
            return self.ids(text)
        got = self.joined.get(text)
        if got is None:
            got = self.joined[text] = self.ids(text)
            self._room(len(text) + len(got) + 200)
        return got

    def plain(self, raw: bytes, cuts: list[int]) -> bytes:
        """The ids, as little-endian 32-bit numbers, of a text without special tokens, cut at ``cuts``."""
        out, loose, at = [], [], 0
        for cut in [*cuts, len(raw)]:
            head, ids, tail = self.chunk(raw[at:cut])
            at = cut
            if head is not None:
                loose.append(head)
                out += [self.join("".join(loose)), ids]
                loose = []
            loose.append(tail)
        out.append(self.join("".join(loose)))
        return b"".join(out)

    def encode(self, raw: bytes, cuts: np.ndarray) -> bytes:
        if self.splitter is None or not any(s in raw for s in self.special):
            return self.plain(raw, cuts.tolist())
        out, at = [], 0
        for part in self.splitter.split(raw):
            if part in self.special:
                out.append(array("I", [self.special[part]]).tobytes())
            elif part:
                own = cuts[(cuts > at) & (cuts < at + len(part))] - at
                out.append(self.plain(part, own.tolist()))
            at += len(part)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        pieces = self.pieces
        return b"".join([pieces[i] for i in array("I", ids)]).decode("utf-8", "replace")


def content_cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of all texts of a slice by a rolling hash of WINDOW bytes, and the number of each text's first cut."""
    if len(data) <= WINDOW:
        return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    rolled = np.zeros(len(data) - WINDOW + 1, np.uint32)
    for i in range(WINDOW):
        rolled *= np.uint32(0x01000193)
        rolled += data[i : len(data) - WINDOW + 1 + i]
    rolled ^= rolled >> np.uint32(15)
    rolled *= np.uint32(0x2C1B3C6D)
    marks = np.flatnonzero((rolled >> np.uint32(8)) % np.uint32(CHUNK_BYTES) == 0) + WINDOW
    marks = marks[marks < len(data)]
    marks = marks[(data[marks] & 0xC0) != 0x80]
    # The window must lie in one text.
    own = np.searchsorted(offsets, marks, "right") - 1
    marks = marks[marks - offsets[own] >= WINDOW]
    return marks, np.searchsorted(marks, offsets)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each worker and vocabulary."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_documents(docs: DataFrame, path: str, text: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every document; with ``digests`` SHA-256 of the last two instead."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_or_empty(text).alias("text"))
    outputs = (("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())) if digests else (("ids", T.ArrayType(T.IntegerType())), ("decoded", T.StringType()))
    schema = shared.fields(("doc_id", T.LongType()), ("n_tokens", T.LongType()), *outputs)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for part in shared.slices(batches):
            data, offsets = shared.text_bytes(part.column("text"))
            cuts, first = content_cuts(data, offsets)
            coded = [own.encode(data[offsets[i] : offsets[i + 1]].tobytes(), cuts[first[i] : first[i + 1]] - offsets[i]) for i in range(len(offsets) - 1)]
            decoded = [own.decode(ids) for ids in coded]
            if digests:
                last = [pa.array([hashlib.sha256(x).hexdigest() for x in coded]), pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded])]
            else:
                last = [pa.array([np.frombuffer(x, np.uint32).astype(np.int32) for x in coded], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in coded], pa.int64()), *last], names=schema.names)

    return source.mapInArrow(encode, schema)
