"""Passages that repeat across or inside documents, by a count-min prefilter.

A window is a run of SIZE words. A word goes if a window over it has the same words as a
window that begins anywhere else.

1. *Sketch.* Every slice of texts counts its windows in a sparse count-min sketch of DEPTH
   rows, counts above one being alike. The slices' sketches are merged cell range by cell
   range, and what stays of a cell is one bit: counted twice or more. The sketch has
   CELLS_PER_WINDOW cells a window, up to 2^MOST_BITS bits in all (64 MB); only these bits go
   to the tasks. A cell counts at least the windows that fall into it, so no repeated window
   is passed by, whatever the size; a sketch too small for its input only lets more windows
   through to the second pass.
2. *Exact groups.* Windows estimated repeated go by 80 bits of hash beyond their shard to the
   shard of their hash. A slice settles repeats of its own and sends one window of each kind,
   so a window that a third of all documents hold comes once a slice. Shards answer with the
   places of windows that came twice.
3. *Removal.* The answers of a slice become covered ranges of words for each text, which meet
   the texts by a 128-bit key. Texts with more than COPIES copies are spread over several tasks.

Windows are told apart by 80 bits and their shard, about 2^-84 for a pair to be confused.

Defined results: a null or empty text has no words, and the digest of the empty string; a
text with fewer words than a window loses nothing; repeated rows, whether their doc_id
repeats or not, are other places of their windows, so texts of SIZE words or more with a
copy go whole; rows with a null doc_id count and are returned; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blankweave.operators import skew

from . import shared

SIZE = 35
DEPTH, CELLS_PER_WINDOW, MOST_BITS = 2, 4, 29
#: Cells that are merged together, and windows of one shard of the second pass.
RANGE_BITS, SHARD_WINDOWS = 20, 1 << 20
#: Copies of a text that may meet its runs in one task.
COPIES = 512
#: Windows that one slice gathers before it sends anything.
SLICE_WINDOWS = 2 << 20
_SALT = np.uint64(0xA0761D6478BD642F)
_ROW_SALTS = [np.uint64(0xE7037ED1A0B428DB * (2 * row + 1) % (1 << 64)) for row in range(8)]


class Windows:
    """The windows of a slice of texts: word hashes, window hashes, the text and the place of each window."""

    def __init__(self, texts: pa.Array, size: int):
        data, offsets = shared.text_bytes(texts)
        starts, ends, first = shared.word_bounds(data, offsets)
        self.words = shared.span_hashes(data, starts, ends)
        self.n_words = np.diff(first)
        counts = np.maximum(self.n_words - size + 1, 0)
        text = self.text = np.repeat(np.arange(len(counts)), counts)
        begins = np.concatenate(([0], np.cumsum(counts)))
        self.begins = begins
        self.at = first[:-1][text] + np.arange(begins[-1]) - begins[:-1][text]
        self.size = size
        self.hashes = shared.window_hashes(self.words, size)[self.at] if len(self.at) else np.empty(0, np.uint64)

    def second_hashes(self, chosen: np.ndarray) -> np.ndarray:
        """Another hash of the chosen windows, from other hashes of their words."""
        words, total = shared.mix(self.words ^ _SALT), np.zeros(len(chosen), np.uint64)
        at = self.at[chosen]
        for i in range(self.size):
            total = total * np.uint64(0x2545F4914F6CDD1D) + words[at + i]
        return shared.mix(total)


def sketch_bits(windows: int) -> int:
    """log2 of the cells of one row of the sketch."""
    wanted = max(1, windows * CELLS_PER_WINDOW).bit_length()
    return max(RANGE_BITS, min(wanted, MOST_BITS - (DEPTH - 1).bit_length()))


def cells(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each window in a row of the sketch."""
    return shared.mix(hashes ^ _ROW_SALTS[row]) >> np.uint64(64 - bits)


def sketch(texts: DataFrame, size: int, bits: int) -> np.ndarray:
    """One bit for every cell that counts two windows or more, row after row."""
    parts = shared.fields(("range", T.IntegerType()), ("once", T.BinaryType()), ("more", T.BinaryType()))

    def sent(hashes: np.ndarray) -> pa.RecordBatch:
        rows, edges = [], np.arange((1 << (bits - RANGE_BITS)) + 1, dtype=np.uint64) << np.uint64(RANGE_BITS)
        for row in range(DEPTH):
            cell, times = np.unique(cells(hashes, row, bits), return_counts=True)
            cuts = np.searchsorted(cell, edges)
            within = (cell & np.uint64((1 << RANGE_BITS) - 1)).astype(np.uint32)
            for i in np.flatnonzero(np.diff(cuts)):
                own, n = within[cuts[i] : cuts[i + 1]], times[cuts[i] : cuts[i + 1]]
                rows.append(((row << (bits - RANGE_BITS)) + int(i), _packed(own[n == 1]), _packed(own[n > 1])))
        kinds = (pa.int32(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=parts.names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        for part in shared.slices(batches):
            waiting.append(Windows(part.column("text"), size).hashes)
            if sum(map(len, waiting)) >= SLICE_WINDOWS:
                yield sent(np.concatenate(waiting))
                waiting = []
        if sum(map(len, waiting)):
            yield sent(np.concatenate(waiting))

    def merge(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, place = np.zeros(1 << RANGE_BITS, np.uint8), None
        for batch in rows:
            place = batch.column("range")[0].as_py()
            for once, more in zip(batch.column("once").to_pylist(), batch.column("more").to_pylist(), strict=True):
                own = _unpacked(once)
                seen[own] = np.minimum(seen[own] + 1, 2)
                seen[_unpacked(more)] = 2
        if place is not None:
            yield pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([np.packbits(seen > 1).tobytes()], pa.binary())], names=["range", "bits"])

    merged = texts.mapInArrow(count, parts).groupBy("range").applyInArrow(merge, shared.fields(("range", T.IntegerType()), ("bits", T.BinaryType())))
    out = np.zeros((DEPTH << (bits - RANGE_BITS), (1 << RANGE_BITS) // 8), np.uint8)
    # At most 2^MOST_BITS bits, one range at a time.
    for r in merged.toLocalIterator():
        out[r["range"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)



def _packed(sorted_cells: np.ndarray) -> bytes:
    """Sorted distinct numbers below 2^RANGE_BITS as compressed differences."""
    steps = np.diff(sorted_cells, prepend=np.uint32(0)).astype(np.uint32)
    low, high = steps.astype(np.uint8), (steps >> np.uint32(8)).astype(np.uint16)
    return len(steps).to_bytes(4, "little") + low.tobytes() + pa.compress(high.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    low = np.frombuffer(data, np.uint8, n, 4).astype(np.uint32)
    high = np.frombuffer(pa.decompress(data[4 + n :], 2 * n, codec="zstd", asbytes=True), np.uint16) if n else np.empty(0, np.uint16)
    return np.cumsum(low | (high.astype(np.uint32) << np.uint32(8)), dtype=np.uint32)


def estimated_repeated(bitmap: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of the windows that every row of the sketch counts twice or more."""
    chosen = np.arange(len(hashes))
    for row in range(DEPTH):
        cell = cells(hashes[chosen], row, bits) + np.uint64(row << bits)
        chosen = chosen[(bitmap[cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1 == 1]
    return chosen


def _changes(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where the keys of a sorted table differ from those of the row before; the first row does."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def _shard(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


_SENT = shared.fields(
    ("shard", T.IntegerType()), ("slice", T.StringType()), ("first", T.BinaryType()), ("second", T.BinaryType()), ("places", T.BinaryType()),
    ("keys", T.BinaryType()), ("counts", T.BinaryType()), ("found", T.BinaryType()),
)


def _candidates(texts: DataFrame, bitmap: np.ndarray, size: int, bits: int, shards: int) -> DataFrame:
    """One row a slice with its texts and what it has settled (shard -1), and one a slice and shard with its candidates."""
    sent = texts.sparkSession.sparkContext.broadcast(bitmap)

    def rows_of(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        first, second, place, keys, counts = (np.concatenate(p) for p in zip(*parts, strict=True))
        name = uuid.uuid4().hex
        order = np.lexsort((place, second, first))
        first, second, place = first[order], second[order], place[order]
        heads = np.flatnonzero(_changes(first, second))
        times = np.diff(np.append(heads, len(first)))
        rows = [(-1, name, None, None, None, keys.tobytes(), counts.tobytes(), place[np.repeat(times > 1, times)].tobytes())]
        # One window of each kind, with the mark that the slice holds several.
        first, second, marked = first[heads], second[heads], place[heads] << np.uint32(1) | (times > 1)
        cuts = np.searchsorted(_shard(first, shards), np.arange(shards + 1))
        for i in np.flatnonzero(np.diff(cuts)):
            own = slice(cuts[i], cuts[i + 1])
            rows.append((int(i), name, first[own].tobytes(), second[own].tobytes(), marked[own].tobytes(), None, None, None))
        kinds = [pa.int32(), pa.string(), *[pa.binary()] * 6]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=_SENT.names)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[np.ndarray, ...]] = []
        base = 0
        for part in shared.slices(batches):
            windows = Windows(part.column("text"), size)
            chosen = estimated_repeated(sent.value, windows.hashes, bits)
            if len(chosen):
                # Texts without a candidate need no place in the slice.
                held = np.unique(windows.text[chosen])
                counts = np.diff(windows.begins)[held]
                begins = np.zeros(len(windows.begins), np.int64)
                begins[held] = np.cumsum(counts) - counts
                place = base + begins[windows.text[chosen]] + chosen - windows.begins[windows.text[chosen]]
                keys = np.stack([part.column(c).to_numpy()[held] for c in ("key_a", "key_b")], axis=1)
                waiting.append((windows.hashes[chosen], windows.second_hashes(chosen).astype(np.uint16), place.astype(np.uint32), keys, counts.astype(np.int32)))
                base += int(counts.sum())
            if base >= SLICE_WINDOWS:
                yield rows_of(waiting)
                waiting, base = [], 0
        if waiting:
            yield rows_of(waiting)

    return texts.mapInArrow(send, _SENT)


def _answer(rows: pa.Table) -> pa.Table:
    """The windows of one shard that came more than once, as places in their slices."""
    names = rows["slice"].to_pylist()
    parts = [[np.frombuffer(b, kind) for b in rows[c].to_pylist()] for c, kind in (("first", np.uint64), ("second", np.uint16), ("places", np.uint32))]
    first, second, places = (np.concatenate(p) for p in parts)
    owner = np.repeat(np.arange(len(names)), [len(p) for p in parts[0]])
    order = np.lexsort((second, first))
    first, second, places, owner = first[order], second[order], places[order], owner[order]
    times = np.diff(np.append(np.flatnonzero(_changes(first, second)), len(first)))
    # What a slice has settled itself needs no answer, but counts.
    told = np.repeat(times > 1, times) & (places & 1 == 0)
    places, owner = places[told] >> np.uint32(1), owner[told]
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(names) + 1))
    found = [places[order[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    some = [i for i, f in enumerate(found) if f]
    return pa.table({"slice": pa.array([names[i] for i in some], pa.string()), "found": pa.array([found[i] for i in some], pa.binary())})


def _ranges(size: int):
    def of_slice(rows: pa.Table) -> pa.Table:
        """Covered runs of words of every text of a slice that loses any."""
        head = next(r for r in rows.select(["keys", "counts"]).to_pylist() if r["keys"] is not None)
        keys, counts = np.frombuffer(head["keys"], np.int64).reshape(-1, 2), np.frombuffer(head["counts"], np.int32).astype(np.int64)
        places = np.sort(np.concatenate([np.frombuffer(b, np.uint32) for b in rows["found"].to_pylist()])).astype(np.int64)
        begins = np.concatenate(([0], np.cumsum(counts)))
        text = np.searchsorted(begins, places, "right") - 1
        start = places - begins[text]
        # A run ends where the next window of the text begins beyond it, or the text changes.
        new = np.concatenate(([True], (text[1:] != text[:-1]) | (start[1:] > start[:-1] + size))) if len(text) else np.empty(0, bool)
        heads = np.flatnonzero(new)
        tails = np.append(heads[1:], len(text)) - 1 if len(text) else heads
        runs = np.stack([start[heads], start[tails] + size], axis=1).astype(np.int32)
        own = text[heads]
        held, at = np.unique(own, return_index=True)
        cuts = np.append(at, len(own))
        return pa.table({
            "key_a": pa.array(keys[held, 0]), "key_b": pa.array(keys[held, 1]),
            "runs": pa.array([runs[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        })

    return of_slice


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key_a, key_b): equal texts have equal keys."""
    source = docs.select(F.col("doc_id"), shared.text_or_empty().alias("text"))
    return source.withColumn("key_a", F.xxhash64("text")).withColumn("key_b", F.xxhash64(F.lit(1), "text"))


def covered_runs(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(key_a, key_b, runs): for each text that loses words, its runs as pairs of 32-bit word numbers, end exclusive."""
    texts = keyed(docs).select("key_a", "key_b", "text")
    # Words have a byte and a blank at least, so this is never less than the windows.
    most = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2 + 1
    likely = most // 3
    bits = sketch_bits(likely)
    bitmap = sketch(texts, size, bits)
    sent = shared.cut(_candidates(texts, bitmap, size, bits, max(1, -(-likely // SHARD_WINDOWS))), "windows")
    answers = sent.where("shard >= 0").groupBy("shard").applyInArrow(_answer, shared.fields(("slice", T.StringType()), ("found", T.BinaryType())))
    heads = sent.where("shard < 0").select("slice", "keys", "counts", "found")
    both = heads.unionByName(answers, allowMissingColumns=True)
    schema = shared.fields(("key_a", T.LongType()), ("key_b", T.LongType()), ("runs", T.BinaryType()))
    found = both.groupBy("slice").applyInArrow(_ranges(size), schema)
    # Copies of a text all lose all their words.
    out = shared.cut(found.groupBy("key_a", "key_b").agg(F.max("runs").alias("runs")), "runs")
    shared.drop_cut(sent)
    return out


def with_runs(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, text, runs) of every row; runs is null where nothing goes."""
    source = keyed(docs)
    runs = covered_runs(docs, size)
    return skew.hot_join(source, runs, ["key_a", "key_b"], F.col("doc_id"), "left", COPIES).select("doc_id", "text", "runs")


def without_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, kept_sha256) of every row."""
    schema = T.StructType([docs.schema["doc_id"], *shared.fields(("n_words", T.LongType()), ("n_removed", T.LongType()), ("kept_text", T.StringType()), ("kept_sha256", T.StringType()))])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.slices(batches):
            data, offsets = shared.text_bytes(part.column("text"))
            starts, ends, first = shared.word_bounds(data, offsets)
            raw, out = data.tobytes(), []
            for i, runs in enumerate(part.column("runs").to_pylist()):
                a, b = int(first[i]), int(first[i + 1])
                stay = np.ones(b - a, bool)
                for begin, end in np.frombuffer(runs or b"", np.int32).reshape(-1, 2):
                    stay[begin:end] = False
                kept = b" ".join(raw[s:e] for s, e in zip(starts[a:b][stay].tolist(), ends[a:b][stay].tolist(), strict=True))
                out.append((b - a, int(b - a - stay.sum()), kept))
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()),
                pa.array([o[2] for o in out], pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(o[2]).hexdigest() for o in out], pa.string()),
            ], names=schema.names)

    return with_runs(docs, size).mapInArrow(remove, schema)


def report(docs: DataFrame) -> DataFrame:
    """One row per document, as the query returns it."""
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


REPORT_SQL = r"""
WITH texts AS (
    SELECT row_number() OVER () AS row_id, doc_id,
           list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
    FROM documents
), windows AS (
    SELECT row_id, unnest(range(1, len(words) - 33)) AS place FROM texts WHERE len(words) >= 35
), spelled AS (
    SELECT row_id, place, array_to_string(words[place : place + 34], ' ') AS spelling FROM windows JOIN texts USING (row_id)
), repeated AS (
    SELECT row_id, place FROM (SELECT row_id, place, count(*) OVER (PARTITION BY spelling) AS times FROM spelled) WHERE times > 1
), covered AS (
    SELECT DISTINCT row_id, unnest(range(place, place + 35)) AS place FROM repeated
), placed AS (
    SELECT row_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM texts
), kept AS (
    SELECT row_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY place) AS kept
    FROM placed ANTI JOIN covered USING (row_id, place) GROUP BY row_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (row_id)
"""
