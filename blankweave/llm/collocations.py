"""Phrases whose words keep company, by mergeable Misra-Gries summaries.

Texts are cut into pieces at punctuation and line ends, pieces into words; everything is
counted for each language on its own.

1. *Slices.* Texts are written in slices, words parted by one blank, pieces by a line feed.
2. *Summaries.* Every slice counts its n-grams of 1 to LONGEST words and sends them by hash
   partition, as 32-bit hashes with counts up to the threshold (more than that proves
   nothing further). A partition merges them into one Misra-Gries summary whose capacity is
   ROOM times its mass divided by the threshold, and one more: when it overflows, the first
   count that no longer fits is taken off all. What was taken off in all bounds the error,
   so each n-gram with f >= threshold has count + error >= threshold and survives.
3. *Exact counts.* Partitions answer each slice with one bit for each n-gram it sent. The
   slice spells the survivors out with their counts, and one aggregate over the spellings
   gives f exactly; hashes decide nothing but which n-grams are spelled out.
4. *Scores.* Candidates meet the counts of their parts by joins that split hot words.

Defined results: a null text is empty; a null lang is ``und``; repeated rows, whatever their
doc_id, count as often as they come; texts without words give nothing; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blankweave.operators import skew

from . import shared

LONGEST, THRESHOLD, TOP, HELD_PERCENT = 3, 10, 2000, 50
NO_LANG = "und"
#: Times the least capacity that guarantees survival.
ROOM = 2
#: n-grams of one hash partition, and bytes of text of one slice.
PART_MASS, SLICE_TEXT = 4 << 20, 8 << 20
#: Bytes of text that are cut into words, and bytes that are hashed, in one go.
PIECE_TEXT = 1 << 20
TOP_BUCKETS = 64

_CUTS = np.zeros(256, bool)
_CUTS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09]] = True
_APART = _CUTS | _BLANK
_SIZE_MARKS = [np.uint64(0xD6E8FEB86659FD93 * (2 * n + 1) % (1 << 64)) for n in range(8)]
_ROLE = [np.uint64(0x8CB92BA72F3D8DD7 * (2 * i + 1) % (1 << 64)) for i in range(8)]


def _spread_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of all texts, each followed by a blank or, at the end of a piece, a line feed; where each text begins,
    in bytes and in words (one more entry for the end)."""
    data, offsets = shared.text_bytes(texts)
    data = shared.LOWER[data]
    apart = _APART[data]
    first, last = ~apart, ~apart
    first[1:] &= apart[:-1]
    last[:-1] &= apart[1:]
    filled = np.flatnonzero(offsets[1:] > offsets[:-1])
    begins, finals = offsets[:-1][filled], offsets[1:][filled] - 1
    first[begins] = ~apart[begins]
    last[finals] = ~apart[finals]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    words = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.empty(0, np.uint8), np.zeros(len(offsets), np.int64), words
    cuts = np.concatenate(([0], np.cumsum(_CUTS[data])))
    closes = np.ones(len(starts), bool)
    closes[:-1] = cuts[starts[1:]] > cuts[ends[:-1]]
    closes[np.maximum(words[1:][words[1:] > words[:-1]] - 1, 0)] = True
    sizes = ends - starts + 1
    upto = np.concatenate(([0], np.cumsum(sizes)))
    place = np.arange(upto[-1]) - np.repeat(upto[:-1] - starts, sizes)
    out = data[np.minimum(place, len(data) - 1)]
    out[upto[1:] - 1] = np.where(closes, 0x0A, 0x20)
    return out, upto[words], words


def written_slices(docs: DataFrame) -> DataFrame:
    """(slice, langs, texts, words): the texts of a slice by language, and their numbers of words."""
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), shared.text_or_empty().alias("text"))
    schema = shared.fields(("slice", T.StringType()), ("langs", T.ArrayType(T.StringType())), ("texts", T.ArrayType(T.StringType())), ("words", T.ArrayType(T.LongType())))

    form = pa.schema([("slice", pa.string()), ("langs", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("words", pa.list_(pa.int64()))])

    def row(texts: dict[str, list[bytes]], words: dict[str, int]) -> pa.RecordBatch:
        langs = sorted(texts)
        return pa.RecordBatch.from_pydict({
            "slice": [uuid.uuid4().hex], "langs": [langs], "texts": [[b"".join(texts[lang]).decode() for lang in langs]], "words": [[words[lang] for lang in langs]],
        }, schema=form)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: dict[str, list[bytes]] = {}
        numbers: dict[str, int] = {}
        held = 0
        for part in shared.slices(batches, most=PIECE_TEXT):
            part = part.take(pc.sort_indices(part.column("lang")))
            names = part.column("lang").to_pylist()
            data, begins, words = _spread_texts(part.column("text"))
            edges = [i for i in range(len(names)) if not i or names[i] != names[i - 1]] + [len(names)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if words[b] > words[a]:
                    texts.setdefault(names[a], []).append(data[begins[a] : begins[b]].tobytes())
                    numbers[names[a]] = numbers.get(names[a], 0) + int(words[b] - words[a])
            held += len(data)
            if held >= SLICE_TEXT:
                yield row(texts, numbers)
                texts, numbers, held = {}, {}, 0
        if texts:
            yield row(texts, numbers)

    return source.mapInArrow(write, schema)


def _word_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """``span_hashes`` of the words, a stretch of PIECE_TEXT bytes at a time."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        upto = max(at + 1, int(np.searchsorted(stop, start[at] + PIECE_TEXT, "right")))
        low = start[at]
        out[at:upto] = shared.span_hashes(data[low : stop[upto - 1]], start[at:upto] - low, stop[at:upto] - low)
        at = upto
    return out


class Grams:
    """The distinct n-grams of a slice, by size and by rising hash: how often each comes and, if asked for, a place of it."""

    def __init__(self, langs: list[str], texts: list[str], places: bool = False):
        hashes: list[list[np.ndarray]] = [[] for _ in range(LONGEST + 1)]
        begins, ends = [[] for _ in range(LONGEST + 1)], [[] for _ in range(LONGEST + 1)]
        encoded = [t.encode() for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in encoded])))
        self.data, self.offsets = np.frombuffer(b"".join(encoded), np.uint8), offsets
        for lang, low, high in zip(langs, offsets[:-1], offsets[1:], strict=True):
            data = self.data[low:high]
            name = np.frombuffer(b"\x00" + lang.encode(), np.uint8)
            seed = shared.span_hashes(name, np.array([0]), np.array([len(name)]))[0]
            stop = np.flatnonzero((data == 0x20) | (data == 0x0A))
            start = np.concatenate(([0], stop[:-1] + 1))
            inside = data[stop] == 0x20
            words = _word_hashes(data, start, stop)
            joined = np.ones(len(words), bool)
            total = np.full(len(words), seed, np.uint64)
            for n in range(1, LONGEST + 1):
                rows = len(words) - n + 1
                if rows <= 0:
                    break
                total = total[:rows] + words[n - 1 :] * _ROLE[n]
                joined = joined[:rows] & inside[n - 2 : n - 2 + rows] if n > 1 else joined
                at = np.flatnonzero(joined)
                hashes[n].append(shared.mix(total[at] ^ _SIZE_MARKS[n]))
                if places:
                    begins[n].append((low + start[at]).astype(np.uint32))
                    ends[n].append((low + stop[at + n - 1]).astype(np.uint32))
        found: list[tuple[np.ndarray, ...]] = []
        for n in range(1, LONGEST + 1):
            own = np.concatenate(hashes[n]) if hashes[n] else np.empty(0, np.uint64)
            hashes[n] = []
            order = np.argsort(own) if places else None
            own = own[order] if places else np.sort(own)
            heads = np.flatnonzero(np.concatenate((own[:1] == own[:1], own[1:] != own[:-1])))
            counts = np.diff(np.append(heads, len(own)))
            # Any place of an n-gram spells it.
            spots = [np.concatenate(x[n])[order[heads]] for x in (begins, ends)] if places and len(own) else [np.empty(0, np.uint32)] * 2
            found.append((own[heads], counts, np.full(len(heads), n, np.int32), *spots))
        self.sizes_at = np.concatenate(([0], np.cumsum([len(f[0]) for f in found])))
        self.hashes, self.counts, self.sizes, self.begins, self.ends = (np.concatenate(x) for x in zip(*found, strict=True))

    def parts(self, number: int) -> list[np.ndarray]:
        """Bounds of each hash partition among the n-grams of each size: begin and end, a row for each partition."""
        out = []
        for low, high in zip(self.sizes_at[:-1], self.sizes_at[1:], strict=True):
            part = (self.hashes[low:high] >> np.uint64(32)) * np.uint64(number) >> np.uint64(32)
            cuts = low + np.searchsorted(part, np.arange(number + 1))
            out.append(np.stack([cuts[:-1], cuts[1:]], axis=1))
        return out

    def langs(self, chosen: np.ndarray) -> np.ndarray:
        """The number of the language of each chosen n-gram."""
        return np.searchsorted(self.offsets, self.begins[chosen], "right") - 1

    def spelled(self, chosen: np.ndarray) -> pa.Array:
        """The chosen n-grams as text."""
        begins, sizes = self.begins[chosen].astype(np.int64), (self.ends[chosen] - self.begins[chosen]).astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(sizes)))
        place = np.arange(upto[-1]) - np.repeat(upto[:-1] - begins, sizes)
        return pa.LargeStringArray.from_buffers(len(chosen), pa.py_buffer(upto.tobytes()), pa.py_buffer(self.data[place].tobytes())).cast(pa.string())


class Summary:
    """A Misra-Gries summary: at most ``capacity`` counts, each too low by ``error`` at most."""

    def __init__(self, capacity: int):
        self.capacity, self.error = capacity, 0
        self.keys, self.counts = np.empty(0, np.uint32), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        both, at = np.unique(np.concatenate((self.keys, keys)), return_inverse=True)
        total = np.bincount(at, np.concatenate((self.counts, counts)), len(both)).astype(np.int64)
        if len(both) > self.capacity:
            off = int(np.partition(total, len(both) - self.capacity - 1)[len(both) - self.capacity - 1])
            self.error += off
            both, total = both[total > off], total[total > off] - off
        self.keys, self.counts = both, total

    def survivors(self, threshold: int) -> np.ndarray:
        """Every key that came ``threshold`` times or more, and some that came less."""
        return self.keys[self.counts + self.error >= threshold]


def _sent(slices: DataFrame, parts: int, threshold: int) -> DataFrame:
    schema = shared.fields(("part", T.IntegerType()), ("slice", T.StringType()), ("keys", T.BinaryType()), ("counts", T.BinaryType()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                grams = Grams(row["langs"], row["texts"])
                keys, counts = grams.hashes.astype(np.uint32), np.minimum(grams.counts, min(threshold, 255)).astype(np.uint8)
                bounds = grams.parts(parts)
                together = [(i, *(b"".join(x[b[i, 0] : b[i, 1]].tobytes() for b in bounds) for x in (keys, counts))) for i in range(parts)]
                some = [t for t in together if t[1]]
                yield pa.RecordBatch.from_arrays([
                    pa.array([t[0] for t in some], pa.int32()), pa.array([row["slice"]] * len(some), pa.string()),
                    pa.array([t[1] for t in some], pa.binary()), pa.array([t[2] for t in some], pa.binary()),
                ], names=schema.names)

    return slices.select("slice", "langs", "texts").mapInArrow(send, schema)


def _answers(threshold: int, room: int):
    def answer(rows: pa.Table) -> pa.Table:
        """One bit for each n-gram that a slice sent to this partition: whether it survives."""
        keys = [np.frombuffer(b, np.uint32) for b in rows["keys"].to_pylist()]
        counts = [np.frombuffer(b, np.uint8) for b in rows["counts"].to_pylist()]
        summary = Summary(room * sum(int(c.sum(dtype=np.int64)) for c in counts) // min(threshold, 255) + 1)
        waiting, held = [], 0
        for i in range(len(keys)):
            waiting.append(i)
            held += len(keys[i])
            if held > summary.capacity or i == len(keys) - 1:
                summary.merge(np.concatenate([keys[j] for j in waiting]), np.concatenate([counts[j] for j in waiting]))
                waiting, held = [], 0
        alive = summary.survivors(min(threshold, 255))
        bits = [np.packbits(np.isin(k, alive)).tobytes() for k in keys]
        return pa.table({"part": rows["part"], "slice": rows["slice"], "bits": pa.array(bits, pa.binary())})

    return answer


def _spelled(parts: int):
    def spell(slices: pa.Table, answers: pa.Table) -> pa.Table:
        """(lang, phrase, size, f): the survivors of one slice with their counts in it."""
        row = slices.to_pylist()[0]
        grams = Grams(row["langs"], row["texts"], places=True)
        bounds, alive = grams.parts(parts), np.zeros(len(grams.hashes), bool)
        for part, bits in zip(answers["part"].to_pylist(), answers["bits"].to_pylist(), strict=True):
            own = np.concatenate([np.arange(*b[part]) for b in bounds])
            alive[own] = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(own))
        chosen = np.flatnonzero(alive)
        langs = pa.array(row["langs"], pa.string()).take(pa.array(grams.langs(chosen)))
        return pa.table({"lang": langs, "phrase": grams.spelled(chosen), "size": pa.array(grams.sizes[chosen]), "f": pa.array(grams.counts[chosen], pa.int64())})

    return spell


def frequent_phrases(docs: DataFrame, threshold: int = THRESHOLD, room: int = ROOM) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of every n-gram that comes ``threshold`` times or more, and (lang, n): all words."""
    slices = shared.cut(written_slices(docs), "slices")
    totals = slices.select(F.explode(F.arrays_zip("langs", "words")).alias("w")).groupBy(F.col("w.langs").alias("lang")).agg(F.sum("w.words").alias("n"))
    words = totals.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-words * LONGEST // PART_MASS))
    schema = shared.fields(("part", T.IntegerType()), ("slice", T.StringType()), ("bits", T.BinaryType()))
    answers = _sent(slices, parts, threshold).groupBy("part").applyInArrow(_answers(threshold, room), schema)
    counted = shared.fields(("lang", T.StringType()), ("phrase", T.StringType()), ("size", T.IntegerType()), ("f", T.LongType()))
    texts = slices.select("slice", "langs", "texts")
    spelled = texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_spelled(parts), counted)
    exact = spelled.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f")).where(F.col("f") >= threshold)
    return shared.cut(exact, "phrases"), shared.cut(totals, "words")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, top: int = TOP, held_percent: int = HELD_PERCENT) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of 2 words and more."""
    phrases, totals = frequent_phrases(docs, threshold)
    counts = phrases.select("lang", "phrase", "f")
    words = F.split("phrase", " ")
    spans = F.expr("flatten(transform(sequence(2, size - 1), k -> transform(sequence(0, size - k), i -> array_join(slice(words, i + 1, k), ' '))))")
    inside = (
        phrases.where("size > 2").withColumn("words", words).select("lang", F.explode(F.array_distinct(spans)).alias("phrase"), "f")
        .groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    )
    free = phrases.where("size > 1").join(inside, ["lang", "phrase"], "left").where(f"held IS NULL OR 100 * cast(held as decimal(38,0)) < {held_percent} * cast(f as decimal(38,0))")
    part = lambda begin, size: f"array_join(slice(words, {begin}, {size}), ' ')"
    cuts = free.withColumn("words", words).select("lang", "phrase", F.col("f").alias("a"), "words", "size", F.expr("explode(sequence(1, size - 1))").alias("k"))
    cuts = cuts.withColumn("left_part", F.expr(part("1", "k"))).withColumn("right_part", F.expr(part("k + 1", "size - k"))).drop("words")
    lefts = counts.select("lang", F.col("phrase").alias("left_part"), F.col("f").alias("l"))
    rights = counts.select("lang", F.col("phrase").alias("right_part"), F.col("f").alias("r"))
    met = skew.hot_join(cuts, lefts, ["lang", "left_part"], F.struct("phrase", "k"))
    met = skew.hot_join(met, rights, ["lang", "right_part"], F.struct("phrase", "k"))
    wide = lambda c: f"cast({c} as decimal(19,0))"
    # a is at most l and r, so the score is at most a million.
    score = F.expr(f"(cast(1000000 as decimal(7,0)) * ({wide('a')} * {wide('a')})) div ({wide('l')} * {wide('r')})")
    scored = met.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    rows = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # In two steps, as one language may have nearly all candidates.
    rows = rows.withColumn("_bucket", F.expr(f"pmod(xxhash64(phrase), {TOP_BUCKETS})"))
    rows = rows.withColumn("_place", F.row_number().over(W.partitionBy("lang", "_bucket").orderBy(*order))).where(F.col("_place") <= top)
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


REPORT_SQL = r"""
WITH pieces AS (
    SELECT row_number() OVER () AS piece_id, lang, piece FROM (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)
), worded AS (
    SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS words FROM pieces
), totals AS (
    SELECT lang, sum(len(words))::BIGINT AS n FROM worded GROUP BY lang
), grams AS (
    SELECT lang, unnest(words) AS phrase, 1 AS size FROM worded
    UNION ALL SELECT lang, unnest(list_transform(range(1, len(words)), lambda i: array_to_string(words[i : i + 1], ' '))), 2 FROM worded
    UNION ALL SELECT lang, unnest(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i : i + 2], ' '))), 3 FROM worded
), counted AS (
    SELECT lang, phrase, size, count(*) AS f, string_split(phrase, ' ') AS words FROM grams GROUP BY ALL HAVING count(*) >= 10
), held AS (
    SELECT lang, phrase, max(f) AS held FROM (
        SELECT lang, array_to_string(words[1:2], ' ') AS phrase, f FROM counted WHERE size = 3
        UNION ALL SELECT lang, array_to_string(words[2:3], ' '), f FROM counted WHERE size = 3) GROUP BY ALL
), cuts AS (
    SELECT c.lang, c.phrase, c.f AS a, k, array_to_string(c.words[1:k], ' ') AS left_part, array_to_string(c.words[k+1:], ' ') AS right_part
    FROM counted c LEFT JOIN held h USING (lang, phrase), (VALUES (1), (2)) cut(k)
    WHERE c.size > k AND (h.held IS NULL OR 100 * h.held < 50 * c.f)
), scored AS (
    SELECT cuts.lang, cuts.phrase, a, k, x.f AS l, y.f AS r, ((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts JOIN counted x ON x.lang = cuts.lang AND x.phrase = left_part JOIN counted y ON y.lang = cuts.lang AND y.phrase = right_part
), least AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM least
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
