"""Fingerprints that keep edit distance: shared random walks over characters.

All texts are read by one random walk: at step t the walk writes the character it stands
on and then moves on or stays, as a random bit for (t, character) says. Two walks that an
insertion or deletion has parted meet again soon, so few edits change few of the steps
written, and edit distance becomes Hamming distance. The steps fall into blocks of STEPS
steps. A fixed random order over all blocks picks the PLACES first ones that a text of its
length has, so texts of nearly the same length are compared at the same blocks. A
fingerprint is the numbers of these blocks with a 16-bit sample of what the walk wrote in
each; likeness is the share of places of the one that the other has alike.

Near texts: the places of a fingerprint, in the shared order, are sampled into BANDS bands of
BAND_PLACES; texts that share a band meet, and the edit distance of the whole texts verifies
them, in the groups and blocks of the near-duplicate search.

Defined results: null or empty text has the empty fingerprint, and two empty texts are
alike; equal texts have equal fingerprints; of rows with one doc_id the one with the lesser
text comes first; a table of one row is its own next document; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near_dedup, shared

STEPS, PLACES = 8, 64
BANDS, BAND_PLACES = 32, 2
#: Rows that are read together, in characters, and rows of one range of ids.
SLICE_CHARS, RANGE_ROWS = 12 << 20, 4000
#: Ranges at most: what the driver holds and all tasks get is one number for each.
MOST_RANGES = 16384
_ALPHABET = 64
_TURNS = 4096


def _moves() -> np.ndarray:
    """The walk's random bits, for step modulo _TURNS and letter; on the mark after the end it stays."""
    bits = np.random.default_rng(77).integers(0, 2, (_TURNS, _ALPHABET + 1)).astype(np.int64)
    bits[:, _ALPHABET] = 0
    return bits


_MOVES = _moves()


def block_count(size: int) -> int:
    """Blocks a text may need: two steps for a character, and room for slow walks."""
    return -(-(2 * size + 6 * math.isqrt(size) + 16) // STEPS) if size else 0


def _picked(blocks: int, order: np.ndarray) -> np.ndarray:
    """The first PLACES blocks below ``blocks`` in the shared random order, by number."""
    return np.sort(order[order < blocks][:PLACES])


def walk(texts: list[np.ndarray]) -> list[np.ndarray]:
    """(block number << 16 | sample) of the picked blocks of each text, given as letters; blocks after its end are left out."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(texts)
    by_size = sorted((i for i in range(len(texts)) if len(texts[i])), key=lambda i: -len(texts[i]))
    if not by_size:
        return out
    size = np.array([len(texts[i]) for i in by_size], np.int64)
    blocks = np.array([block_count(int(n)) for n in size], np.int64)
    order = np.argsort(shared.mix(np.arange(blocks[0], dtype=np.uint64) + np.uint64(0x51ED270B)), kind="stable")
    wanted = {int(n): _picked(int(n), order) for n in np.unique(blocks)}
    mark = np.full(1, _ALPHABET, np.uint8)
    data = np.concatenate([x for i in by_size for x in (texts[i], mark)])
    end = np.cumsum(size + 1) - 1
    place = end - size
    # The texts that picked each block, as one table by block.
    text_of = np.repeat(np.arange(len(by_size)), [len(wanted[int(n)]) for n in blocks])
    block_of = np.concatenate([wanted[int(n)] for n in blocks])
    by_block = np.argsort(block_of, kind="stable")
    text_of, block_of = text_of[by_block], block_of[by_block]
    value = np.full(len(text_of), -1, np.int64)
    first = np.searchsorted(block_of, np.arange(int(blocks[0]) + 1))
    live = np.searchsorted(-blocks, -np.arange(int(blocks[0])), "left")
    for block in range(int(blocks[0])):
        n, own = int(live[block]), slice(first[block], first[block + 1])
        at = place[:n]
        seen = text_of[own]
        started = at[seen] < end[seen]
        written_here = np.zeros(n if len(seen) else 0, np.uint32)
        for t in range(block * STEPS, (block + 1) * STEPS):
            letter = data[at]
            if len(seen):
                written_here *= np.uint32(0x01000193)
                written_here += letter
            at += _MOVES[t % _TURNS][letter]
        if len(seen):
            sample = written_here[seen] + np.uint32(block & 0xFFFFFFFF)
            sample ^= sample >> np.uint32(15)
            sample *= np.uint32(0x2C1B3C6D)
            sample ^= sample >> np.uint32(12)
            value[own] = np.where(started, (block << 16) | (sample & np.uint32(0xFFFF)).astype(np.int64), -1)
    back = np.argsort(text_of, kind="stable")
    ends = np.cumsum(np.bincount(text_of, minlength=len(by_size)))
    for i, part in enumerate(np.split(value[back], ends[:-1])):
        out[by_size[i]] = part[part >= 0]
    return out


def letters_of(text: str) -> np.ndarray:
    """Characters hashed to the walk's alphabet."""
    return ((np.frombuffer(text.encode("utf-32-le"), np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.uint8)


def written(places: np.ndarray) -> str:
    """A fingerprint as text: block and sample in hexadecimal."""
    return " ".join(f"{int(p) >> 16:x}:{int(p) & 0xFFFF:04x}" for p in places)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float(np.isin(a, b, assume_unique=True).sum() / max(len(a), len(b)))


def bands_of(places: np.ndarray, number: int) -> np.ndarray:
    """BANDS keys: runs of places in the shared order; where there are too few, keys that no other text has."""
    order = np.argsort(shared.mix((places >> 16).astype(np.uint64) + np.uint64(0x51ED270B)), kind="stable")
    ranked = places[order].astype(np.uint64)
    keys = shared.mix(np.arange(BANDS, dtype=np.uint64) + np.uint64(number % (1 << 40)) * np.uint64(BANDS) + np.uint64(1 << 62))
    runs = min(BANDS, len(ranked) // BAND_PLACES)
    if runs:
        keys[:runs] = shared.window_hashes(shared.mix(ranked), BAND_PLACES)[: runs * BAND_PLACES : BAND_PLACES]
    elif len(ranked):
        keys[0] = shared.mix(ranked).sum(dtype=np.uint64)
    return keys.view(np.int64)


def edit_distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Insertions, deletions and replacements that turn ``a`` into ``b``; None if there are more than ``most``."""
    n = min(len(a), len(b))
    same = np.flatnonzero(a[:n] != b[:n])
    head = int(same[0]) if len(same) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(same[0]) if len(same) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if abs(len(a) - len(b)) > most:
        return None
    if not len(a) or not len(b):
        return max(len(a), len(b))
    # Row i holds the cells of columns i - most .. i + most.
    far, width = len(a) + len(b) + 1, 2 * most + 1
    shift = np.arange(width)
    columns = shift - most
    row = np.where((columns >= 0) & (columns <= len(b)), columns, far)
    for i in range(1, len(a) + 1):
        columns = columns + 1
        inside = (columns >= 1) & (columns <= len(b))
        cost = b[np.clip(columns - 1, 0, len(b) - 1)] != a[i - 1]
        new = np.where(inside, np.minimum(row + cost, np.append(row[1:], far) + 1), far)
        new[columns == 0] = i
        # Insertions: the least of what stands to the left, one more for each column.
        row = np.where((columns >= 0) & (columns <= len(b)), np.minimum.accumulate(new - shift) + shift, far)
        if row.min() > most:
            return None
    found = int(row[len(b) - len(a) + most])
    return found if found <= most else None


class TextBlock(near_dedup._Block):
    """A block whose items are the characters of texts; linked are texts of at least ``percent`` likeness by edits."""

    def linked(self, other: np.ndarray, among: np.ndarray, percent: int) -> np.ndarray:
        out = []
        for i in among:
            longest = max(int(self.sizes[i]), len(other))
            most = longest * (100 - percent) // 100
            if longest and edit_distance(self.set(i), other, most) is not None:
                out.append(i)
        return np.array(out, np.int64)


def _text_keys(texts: list[str]) -> np.ndarray:
    return np.frombuffer(b"".join(hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts), np.int64).reshape(-1, 2)


def _characters(texts: DataFrame) -> DataFrame:
    """(node, items): the code points of every text under its class."""
    schema = shared.fields(("key_a", T.LongType()), ("key_b", T.LongType()), ("n", T.LongType()), ("items", T.ArrayType(T.LongType())))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.slices(batches):
            rows = part.column("text").to_pylist()
            keys = _text_keys(rows)
            items = [np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.int64) for t in rows]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([len(t) for t in rows], pa.int64()), pa.array(items, pa.list_(pa.int64()))], names=schema.names
            )

    return texts.mapInArrow(read, schema).select(near_dedup.node_of().alias("node"), "items")


def near_texts(docs: DataFrame, percent: int = 90) -> DataFrame:
    """(doc_id, n_chars, component_id, kept): texts of which at least ``percent`` of the longer one's characters stay under edits.

    The embedding keeps few edits apart from many: bands find texts with some edits in a
    hundred characters, and those that share no band with any other of their group are missed.
    An empty text is linked with nothing; equal texts are one class and never become pairs.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_or_empty().alias("text"))
    schema = shared.fields(("doc_id", T.LongType()), ("n", T.LongType()), ("key_a", T.LongType()), ("key_b", T.LongType()), ("bands", T.ArrayType(T.LongType())))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.slices(batches, most=SLICE_CHARS):
            texts = part.column("text").to_pylist()
            keys = _text_keys(texts)
            bands = [bands_of(p, int(k) & 0xFFFFFFFFFF).tolist() for p, k in zip(walk([letters_of(t) for t in texts]), keys[:, 0], strict=True)]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(bands, pa.list_(pa.int64())),
            ], names=schema.names)

    signatures = shared.cut(source.mapInArrow(sign, schema), "edit-signatures")
    classes, found = near_dedup.linked_classes(signatures, lambda wanted: _characters(near_dedup.texts_of(source, wanted)), percent, TextBlock)
    return near_dedup.labelled(signatures, classes, found).withColumnRenamed("n_shingles", "n_chars")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as many first characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def next_in_order(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(bucket, halo, doc_id, text): documents dealt out by ranges of ids, each range in one partition, sorted, in
    descending order of id, and followed by the first document of the next range as its halo.

    There are MOST_RANGES ranges at most, whatever the size; a row finds its range by binary search."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_or_empty().alias("text"))
    rows = source.select("doc_id").where("doc_id is not null").count()
    parts = min(max(1, -(-rows // range_rows)), MOST_RANGES)
    edges = source.stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts) if parts > 1 else []
    edges = np.unique(np.array(edges, np.float64).astype(np.int64))

    def place(rows: DataFrame) -> DataFrame:
        """Rows with their ``bucket``; ranges are of descending ids, bucket 0 has the greatest, the last one those without id."""
        schema = T.StructType([*rows.schema, T.StructField("bucket", T.IntegerType())])

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id")
                below = np.searchsorted(edges, pc.fill_null(ids, np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), "left")
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((len(edges) - below).astype(np.int32))], names=schema.names)

        return rows.mapInArrow(deal, schema)

    heads = {r["bucket"]: r["head"] for r in place(source.select("doc_id")).groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}
    buckets = sorted(heads)
    goes_to = {heads[b]: buckets[i - 1] for i, b in enumerate(buckets)}
    layout = spark.createDataFrame(list(goes_to.items()) or [(None, None)], shared.fields(("head_id", T.LongType()), ("target", T.IntegerType())))
    halo = (
        source.join(F.broadcast(layout), F.col("doc_id").eqNullSafe(F.col("head_id")))  # one row for each range
        .groupBy("target", "doc_id").agg(F.min("text").alias("text"))
        .select(F.col("target").alias("bucket"), F.lit(1).alias("halo"), "doc_id", "text")
    )
    both = place(source).select("bucket", F.lit(0).alias("halo"), "doc_id", "text").unionByName(halo)
    return both.repartition(max(1, parts), "bucket").sortWithinPartitions("bucket", "halo", F.col("doc_id").desc_nulls_last(), "text")


def report(docs: DataFrame) -> DataFrame:
    """One row per document, as the query returns it."""
    schema = shared.fields(
        ("doc_id", T.LongType()), ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()),
        ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()),
    )

    def results(rows: list[tuple[int, int, int, str]], ready: int) -> pa.RecordBatch:
        """Rows 0..ready-1, each of which is followed by its next document unless it is a halo."""
        own = [i for i in range(ready) if not rows[i][1]]
        changed = [edited(rows[i][3], rows[i + 1][3]) for i in own]
        prints = walk([letters_of(r[3]) for r in rows] + [letters_of(t) for t in changed])
        base, other = prints[: len(rows)], prints[len(rows) :]
        return pa.RecordBatch.from_arrays([
            pa.array([rows[i][2] for i in own], pa.int64()), pa.array([len(rows[i][3]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([written(base[i]) for i in own], pa.string()), pa.array([written(p) for p in other], pa.string()),
            pa.array([likeness(base[i], p) for i, p in zip(own, other, strict=True)], pa.float64()),
            pa.array([likeness(base[i], base[i + 1]) for i in own], pa.float64()),
        ], names=schema.names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, int, str]] = []
        held = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "halo", "doc_id", "text")), strict=True):
                rows.append(row)
                held += len(row[3])
                if held > SLICE_CHARS and len(rows) > 1:
                    yield results(rows, len(rows) - 1)
                    rows, held = rows[-1:], len(row[3])
        if rows:
            # The last row of a range is its halo.
            yield results(rows, len(rows) if rows[-1][1] else len(rows) - 1)

    return next_in_order(docs).mapInArrow(read, schema)
