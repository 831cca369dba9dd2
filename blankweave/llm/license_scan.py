"""Licence notices in running text, also misspelt ones.

Words are runs of a-z, 0-9 and all signs outside ASCII, after lower-casing A-Z. A notice
stands where its words follow each other. With up to ``edits`` edits allowed a phrase is
cut into ``edits`` + 1 pieces; one of them must then stand unchanged (pigeonhole). One
automaton finds the pieces and whole phrases of all notices in one pass over a text. Around
each piece the regex library matches its phrase with bounded errors and reports the best
span, which must begin and end at word bounds. Of overlapping spans of one notice the one
with the fewest edits stays, then the first.

Of overlapping places of one label the base places stay, else the longest phrase. A place
with edits goes where a phrase of another notice, at least as long, fits the same words with
fewer edits (or as many, if longer or earlier in the table).

Defined results: null or empty text has no words and no places; of two exact notices of
different labels at one place both count; rows of a repeated doc_id are scanned row by row,
rows without one likewise; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Phrase and label of each base notice.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Phrase, label and allowed edits of each further notice; short forms must stand as they are.
MORE = (
    ("academic free license", "afl", 2),
    ("apache 2 0", "apache-2", 0),
    ("apache license 2 0", "apache-2", 0),
    ("apache software license", "apache", 2),
    ("artistic license 2 0", "artistic-2", 1),
    ("attribution noncommercial noderivatives 4 0 international", "cc-by-nc-nd", 3),
    ("attribution noncommercial sharealike 4 0 international", "cc-by-nc-sa", 3),
    ("attribution sharealike 4 0 international", "cc-by-sa", 3),
    ("boost software license", "bsl-1", 2),
    ("bsd 2 clause", "bsd-2", 0),
    ("bsd 2 clause license", "bsd-2", 1),
    ("bsd 3 clause", "bsd-3", 0),
    ("bsd 3 clause license", "bsd-3", 1),
    ("bsd zero clause license", "0bsd", 2),
    ("business source license", "busl", 2),
    ("cc by nc nd", "cc-by-nc-nd", 0),
    ("cc by nc sa", "cc-by-nc-sa", 0),
    ("cc by nd", "cc-by-nd", 0),
    ("cc by sa", "cc-by-sa", 0),
    ("cc0 1 0 universal", "cc0", 1),
    ("common development and distribution license", "cddl", 4),
    ("common public attribution license", "cpal", 3),
    ("creative commons attribution 4 0", "cc-by", 2),
    ("creative commons attribution license", "cc-by", 3),
    ("creative commons zero", "cc0", 2),
    ("eclipse distribution license", "edl", 2),
    ("eclipse public license", "epl", 2),
    ("educational community license", "ecl", 2),
    ("european union public licence", "eupl", 2),
    ("gnu affero general public license", "agpl", 3),
    ("gnu agpl", "agpl", 0),
    ("gnu free documentation license", "gfdl", 3),
    ("gnu general public license", "gpl", 2),
    ("gnu general public license version 2", "gpl-2", 3),
    ("gnu general public license version 3", "gpl-3", 3),
    ("gnu gpl", "gpl", 0),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu lgpl", "lgpl", 0),
    ("gnu library general public license", "lgpl", 3),
    ("gpl 2 0", "gpl-2", 0),
    ("gpl 3 0", "gpl-3", 0),
    ("gpl v2", "gpl-2", 0),
    ("gpl v3", "gpl-3", 0),
    ("gplv2", "gpl-2", 0),
    ("gplv3", "gpl-3", 0),
    ("isc license", "isc", 0),
    ("lgpl 2 1", "lgpl", 0),
    ("lgpl 3 0", "lgpl", 0),
    ("microsoft public license", "ms-pl", 2),
    ("microsoft reciprocal license", "ms-rl", 2),
    ("mit licence", "mit", 0),
    ("mit license", "mit", 0),
    ("mozilla public license", "mpl", 2),
    ("mpl 2 0", "mpl", 0),
    ("open data commons attribution license", "odc-by", 3),
    ("open database license", "odbl", 2),
    ("open software license", "osl", 2),
    ("python software foundation license", "psf", 3),
    ("sil open font license", "ofl", 2),
    ("server side public license", "sspl", 2),
    ("universal permissive license", "upl", 2),
    ("zlib license", "zlib", 0),
)
EDITS_PER_CHARS = 10

# Everything in ASCII but digits and letters separates words; A-Z become a-z.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def edits_of(phrase: str) -> int:
    """One edit for every ten characters of a phrase; short phrases have none, as other words are too near."""
    return len(phrase) // EDITS_PER_CHARS


class Notice:
    def __init__(self, phrase: str, label: str, edits: int, base: bool):
        self.phrase, self.label, self.base, self.edits = phrase.encode(), label, base, edits
        n, parts = len(self.phrase), edits + 1
        bounds = [n * i // parts for i in range(parts + 1)]
        self.seeds = [(a, self.phrase[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] if edits else []
        # Cut whole words out of the joined words: a blank stands before and after each.
        self.fuzzy = regex.compile(rb"(?b)(?<= )(?:%s){e<=%d}(?= )" % (regex.escape(self.phrase, literal_spaces=True), edits))

    def window(self, seed_at: int, offset: int) -> tuple[int, int]:
        """Where the phrase may stand, if its piece at ``offset`` stands at ``seed_at``."""
        begin = seed_at - offset
        return max(0, begin - self.edits - 1), begin + len(self.phrase) + self.edits + 1

    def near(self, words: bytes, windows: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, end, edits) of misspelt places in the windows, apart from one another, those of fewest edits first."""
        spans = set()
        for lo, hi in windows:
            m = self.fuzzy.search(words, lo, min(hi, len(words)))
            if m and any(m.fuzzy_counts):
                spans.add((sum(m.fuzzy_counts), m.start(), m.end()))
        return [(s, e, edits) for edits, s, e in apart(sorted(spans))]


def apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of spans (any, start, end) in order of preference those that overlap none before them."""
    starts, ends, out = [], [], []
    for span in spans:
        at = bisect_right(starts, span[1])
        if (at == 0 or ends[at - 1] <= span[1]) and (at == len(starts) or span[2] <= starts[at]):
            starts.insert(at, span[1])
            ends.insert(at, span[2])
            out.append(span)
    return out


NOTICES = tuple(Notice(p, label, edits_of(p), True) for p, label in BASE) + tuple(Notice(p, label, edits, False) for p, label, edits in MORE)


class Finder:
    """The pieces and whole phrases of all notices in one automaton; it reads bytes as characters of the same number."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES):
        self.notices = notices
        keys: dict[str, list[tuple[int, int]]] = {}
        for i, notice in enumerate(notices):
            keys.setdefault(f" {notice.phrase.decode('latin-1')} ", []).append((i, -1))
            for offset, seed in notice.seeds:
                keys.setdefault(seed.decode("latin-1"), []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for key, uses in keys.items():
            self.automaton.add_word(key, (len(key), uses))
        self.automaton.make_automaton()

    def places(self, words: bytes) -> list[tuple[int, int, int, int]]:
        """(start, end, edits, number of the notice) of all places in `` word word ``, as byte positions."""
        windows: dict[int, set[tuple[int, int]]] = {}
        found: dict[str, list[tuple[int, int, int, int]]] = {}
        for last, (size, uses) in self.automaton.iter(words.decode("latin-1")):
            at = last - size + 1
            for i, offset in uses:
                if offset < 0:
                    found.setdefault(self.notices[i].label, []).append((at + 1, last, 0, i))
                else:
                    windows.setdefault(i, set()).add(self.notices[i].window(at, offset))
        for i, some in windows.items():
            found.setdefault(self.notices[i].label, []).extend((s, e, edits, i) for s, e, edits in self.notices[i].near(words, some))
        for label, some in found.items():
            some.sort(key=lambda p: (not (self.notices[p[3]].base and p[2] == 0), -len(self.notices[p[3]].phrase), p[2], p[0]))
            found[label] = sorted(p[1:] for p in apart([(p, *p) for p in some]))
        return [p for some in found.values() for p in some if p[2] == 0 or not self._fits_better(p, found.values())]

    def _fits_better(self, place: tuple[int, int, int, int], found) -> bool:
        """Whether another notice, of a phrase at least as long, fits the words of a place better."""
        start, end, edits, i = place
        own = len(self.notices[i].phrase)
        for some in found:
            at = bisect_right(some, start, key=lambda p: p[1])
            while at < len(some) and some[at][0] < end:
                size, other = len(self.notices[some[at][3]].phrase), some[at]
                if size >= own and (other[2], -size, other[3]) < (edits, -own, i):
                    return True
                at += 1
        return False


FINDER = Finder()


def scan(text: str, finder: Finder | None = None) -> tuple[int, list[tuple[int, int, str, int, bool, float]]]:
    """The number of words, and (first word, last word, label, edits, base, share of characters right) of each place in order."""
    finder = finder or FINDER
    words = text.encode().translate(_FOLD).split()
    joined = b" " + b" ".join(words) + b" "
    places, upto, passed = [], 0, 0
    for start, end, edits, i in sorted(finder.places(joined)):
        passed += joined.count(b" ", upto, start)
        upto = start
        notice = finder.notices[i]
        first = passed - 1
        places.append((first, first + joined.count(b" ", start, end), notice.label, edits, notice.base and edits == 0, 1 - edits / len(notice.phrase)))
    return len(words), sorted(places)


def scan_documents(docs: DataFrame, text: str = "text", finder: Finder | None = None) -> DataFrame:
    """(doc_id, n_words, places) of every document; a place has its words, label, edits, whether it is a base place and its share of right characters."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_or_empty(text).alias("text"))
    place = T.StructType([T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()), T.StructField("label", T.StringType()), T.StructField("edits", T.LongType()), T.StructField("base", T.BooleanType()), T.StructField("right", T.DoubleType())])
    schema = shared.fields(("doc_id", T.LongType()), ("n_words", T.LongType()), ("places", T.ArrayType(place)))
    kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("label", pa.string()), ("edits", pa.int64()), ("base", pa.bool_()), ("right", pa.float64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("first_word", "last_word", "label", "edits", "base", "right")
        for part in shared.slices(batches):
            found = [scan(t, finder) for t in part.column("text").to_pylist()]
            places = pa.array([[dict(zip(names, p, strict=True)) for p in places] for _, places in found], kind)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), places], names=["doc_id", "n_words", "places"])

    return source.mapInArrow(find, schema)


def report(docs: DataFrame) -> DataFrame:
    """One row per document; score is the share of characters right in its best place, 0 without a place."""
    rows = scan_documents(docs).withColumn("base_places", F.expr("filter(places, p -> p.base)"))
    starts = F.expr("transform(base_places, p -> p.first_word)")
    return rows.select(
        "doc_id", "n_words", F.size("base_places").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.expr("array_join(array_sort(array_distinct(transform(base_places, p -> p.label))), ',')").alias("base_labels"),
        F.expr("array_join(array_sort(array_distinct(transform(places, p -> p.label))), ',')").alias("labels"),
        F.coalesce(F.array_max("places.right"), F.lit(0.0)).alias("score"), "places",
    )
