"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The training table has three parts: lines labelled by hand
(``pii_lines``, each HAND_TIMES times); lines of at most SAMPLE_DOCS documents of at most
SAMPLE_CHARS characters, labelled with the base spans and with sure forms that the patterns
miss (local telephone numbers, IPv6, cards in other groups, masked or non-ASCII addresses);
and the surroundings of base spans with such a form, or a number that is no personal data,
in their place. The field is trained on it (forward-backward and Adam in numpy). It then tags
every line of every text by Viterbi, batched over the lines of a slice. The runs of one tag are
the spans it adds, without the punctuation at their ends; a run that isn't one value is cut
between words into values, the longest first from the left (``values``). What it adds must
pass its kind's check (``is_value``), touch neither a base span nor a failed match of its own
kind (parts, Luhn of 13 digits or more, digits) and lie in no card number that failed. No
pattern searches for it, and nothing beyond the words that the field tagged is taken.

Defined results: null or empty text has no spans; equal starts are ordered by kind, then
end; rows of a repeated doc_id, or without one, are searched row by row; an empty table gives
an empty result; other columns pass through.
"""

from __future__ import annotations

import ipaddress
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import pii_lines, shared

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, SAMPLE_CHARS, LINE_WORDS = 600, 50_000, 200
#: Forms written in place of base spans in the training table, and as many other numbers.
FORMS = 2000
#: Words that one value may have.
VALUE_WORDS = 12
#: How often each line labelled by hand is in the training table.
HAND_TIMES = 20
_SHAPES, _FLAGS, _MARKS = 1024, 512, 64
_TAGS = len(KINDS) + 1

_WORD = re.compile(r"[^\x20\x09-\x0D]+")

# The four patterns, with possessive repeats where these can't change a match.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


# What a value may look like from its first to its last character: what the field tagged is held against it.
_AT, _DOT = r"\x20?[\[({<]\x20?at\x20?[\])}>]\x20?|\x20at\x20", r"\x20?[\[({<]\x20?(?:dot|\.)\x20?[\])}>]\x20?|\x20dot\x20|\."
_PART = r"[^\s@<>()\[\]{}\"',;:.]+"
_IPS = r"(?:[0-9A-Fa-f]{0,4}:){2,7}(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{0,4})", r"[0-9]{1,3}(?:(?:[\[({]\.[\])}]|[\[({]dot[\])}]|\.)[0-9]{1,3}){3}"
_VALUE = (
    re.compile(rf"{_PART}(?:\.{_PART})*+(?:@|{_AT}){_PART}(?:(?:{_DOT}){_PART})*", re.IGNORECASE),
    re.compile(rf"{_IPS[0]}|{_IPS[1]}"),
    re.compile(r"[0-9](?:[\x20._/–-]{0,3}[0-9])+"),
    re.compile(r"(?:\+|\(\+?)?[0-9](?:[\x20()./–-]{0,3}[0-9])+"),
)
# Forms surely of a kind, by which lines of the training table are labelled.
_SURE = (
    re.compile(rf"{_PART}(?:\.{_PART})*+(?:@{_PART}\.{_PART}(?:\.{_PART})*|\x20?[\[({{]at[\])}}]\x20?{_PART}(?:(?:{_DOT}){_PART})+)", re.IGNORECASE),
    re.compile(rf"(?<![0-9A-Fa-f:.]){_IPS[0]}(?![0-9A-Fa-f:])|(?<![0-9.]){_IPS[1]}(?![0-9.])"),
    re.compile(r"(?<![0-9])[0-9]{4}(\x20-\x20|[._/\u2013])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])"),
    re.compile(
        r"(?<![\w+.:/-])(?:\([0-9]{2,5}\)\x20?[0-9]{3,4}[\x20./-]?[0-9]{3,5}|[0-9]{3}([./-])[0-9]{3}\1[0-9]{4}|0[0-9]{2,4}(?:[\x20./-][0-9]{3,4}){2}|00[0-9]{1,3}(?:[\x20./-][0-9]{2,4}){3,4})(?![\w/-]|\.[0-9])"
    ),
)


def confirmed(kind: int, piece: str) -> bool:
    """Whether what the field tagged passes the check of its kind."""
    digits = "".join(c for c in piece if c in "0123456789")
    if kind == 0:
        return True
    if kind == 1:
        try:
            return bool(ipaddress.ip_address(re.sub(r"[\[({](?:\.|dot)[\])}]", ".", piece))) and len(piece) > 3
        except ValueError:
            return False
    if kind == 2:
        return 13 <= len(digits) <= 19 and _luhn(digits)
    return 9 <= len(digits) <= 15


def sure_forms(kind: int, text: str) -> list[tuple[int, int, int]]:
    """The confirmed forms of one kind in a text, by which the training table is labelled."""
    return [(kind, *m.span()) for m in _SURE[kind].finditer(text) if confirmed(kind, m[0])]


def is_value(kind: int, piece: str) -> bool:
    return _VALUE[kind].fullmatch(piece) is not None and confirmed(kind, piece)


def trimmed(kind: int, text: str, start: int, end: int) -> tuple[int, int]:
    """A run of words without what stands around a value in its first and last word."""
    if kind < 2:
        outside = "\"'`<>()[]{},;.!?“”‘’" + (":" if kind == 0 else "")
        while start < end and text[start] in outside:
            start += 1
        while start < end and text[end - 1] in outside:
            end -= 1
        return start, end
    while start < end and text[start] not in "0123456789":
        start += 1
    while start < end and text[end - 1] not in "0123456789":
        end -= 1
    if kind == 3 and start < end:
        start -= text[start - 1 : start] == "+"
        start -= text[start - 1 : start] == "(" and ")" in text[start:end]
    return start, end


def values(kind: int, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
    """The values that a tagged run consists of: from each word on the longest piece that passes the check."""
    words = [m.span() for m in _WORD.finditer(text, start, end)]
    out, i = [], 0
    while i < len(words):
        for j in range(min(len(words), i + VALUE_WORDS), i, -1):
            lo, hi = trimmed(kind, text, words[i][0], words[j - 1][1])
            if lo >= words[i][0] and is_value(kind, text[lo:hi]):
                out.append((kind, lo, hi))
                break
        else:
            j = i + 1
        i = j
    return out


def allowed(span: tuple[int, int, int], base: list[tuple[int, int, int]], refused: list[tuple[int, int, int]]) -> bool:
    kind, start, end = span
    touches = any(s < end and start < e for _, s, e in base)
    return not touches and not any(s < end and start < e and (k == kind or k == 2 and s <= start and end <= e) for k, s, e in refused)


def matches(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(kind number, start, end) by kind, then start, of the matches that pass their check and of those that fail it.

    Fewer than 13 digits are no card that failed, but a number that was none.
    """
    found, refused = [], []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((0, start, domain.end()))
            free = domain.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        small = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())
        (found if small else refused).append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) >= 13:
            (found if len(digits) <= 19 and _luhn(digits) else refused).append((2, *m.span()))
    for m in _PHONE.finditer(text):
        (found if 9 <= sum(c in "0123456789" for c in m[0]) <= 15 else refused).append((3, *m.span()))
    return found, refused


_KIND = np.arange(256, dtype=np.uint8)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[128:] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdefABCDEF:", np.uint8))
_BRACKET = np.isin(np.arange(256), np.frombuffer(b"[](){}<>", np.uint8)).astype(np.int64)
_DIGIT_BIN = np.minimum(np.searchsorted([1, 3, 5, 9, 13, 20], np.arange(64), "right"), 6)


class Words:
    """The words of a slice, the lines they form, and their features."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = shared.text_bytes(column)
        data = self.data
        self.starts, self.ends, self.first = shared.word_bounds(data, self.offsets)
        n = len(self.starts)
        kinds = _KIND[data]
        turn = np.ones(len(data), bool)
        turn[1:] = kinds[1:] != kinds[:-1]
        turn[self.starts] = True
        before = np.concatenate(([0], np.cumsum(turn)))
        shape = (shared.span_hashes(kinds[turn], before[self.starts], before[self.ends]) % np.uint64(_SHAPES)).astype(np.int64)

        def counted(mask: np.ndarray) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(mask)))
            return sums[self.ends] - sums[self.starts]

        self.digits = counted(kinds == 3)
        self.ats = counted(data == ord("@"))
        flags = _DIGIT_BIN[np.minimum(self.digits, 63)]
        for i, sign in enumerate(b".-+()@"):
            flags = flags + (counted(data == sign) > 0) * (8 << i)
        # A line begins at a text's first word and after each line feed.
        new = np.zeros(n + 1, bool)
        new[self.first] = True
        feeds = np.flatnonzero(data == 0x0A)
        new[np.searchsorted(self.starts, feeds)] = True
        self.lines = np.flatnonzero(new[:n])
        self.line_sizes = np.diff(np.concatenate((self.lines, [n])))
        edge = _SHAPES
        left, right = np.full(n, edge), np.full(n, edge)
        left[1:], right[:-1] = shape[:-1], shape[1:]
        left[self.lines] = edge
        if n:
            right[self.lines[1:] - 1] = edge
        size = np.minimum(self.ends - self.starts, 31)
        # Colons, words of hexadecimal digits and colons, a leading zero, and what is written for @.
        colons = counted(data == ord(":"))
        hexadecimal = counted(_HEX[data]) == self.ends - self.starts
        zero = data[self.starts] == ord("0")
        inner, outer = self.starts + _BRACKET[data[self.starts]], self.ends - _BRACKET[data[self.ends - 1]]
        letter = lambda at: shared.LOWER[data[np.minimum(at, len(data) - 1)]]
        self.signs = np.zeros(n, bool)
        for spelt in (b"at", b"dot"):
            same = outer - inner == len(spelt)
            for i, c in enumerate(spelt):
                same &= letter(inner + i) == c
            self.signs |= same
        bracketed = counted((data == ord("[")) | (data == ord("]"))) > 0
        marks = np.minimum(colons, 3) + 4 * hexadecimal + 8 * zero + 16 * self.signs + 32 * bracketed
        self.features = np.stack([shape, left, right, flags, size, marks], axis=1)


_TABLES = (_SHAPES, _SHAPES + 1, _SHAPES + 1, _FLAGS, 32, _MARKS)
_BASES = np.concatenate(([0], np.cumsum(_TABLES)[:-1]))


class Field:
    """Weights of a linear-chain field with one tag for plain words (0) and one for each kind."""

    def __init__(self) -> None:
        self.emit = np.zeros((sum(_TABLES), _TAGS))
        self.move = np.zeros((_TAGS, _TAGS))
        self.trained = False

    def scores(self, features: np.ndarray) -> np.ndarray:
        total = self.emit[features[:, 0] + _BASES[0]]
        for i in range(1, len(_TABLES)):
            total = total + self.emit[features[:, i] + _BASES[i]]
        return total

    def train(self, lines: list[tuple[np.ndarray, np.ndarray]], rounds: int = 50, rate: float = 0.2) -> Field:
        """``lines``: features and tags of each line."""
        lines = sorted((x for x in lines if len(x[1])), key=lambda x: -len(x[1]))
        if not lines or not any(tags.any() for _, tags in lines):
            return self
        sizes = np.array([len(t) for _, t in lines])
        features, tags = np.concatenate([f for f, _ in lines]), np.concatenate([t for _, t in lines])
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        flat = features + _BASES
        target = np.zeros_like(self.emit)
        np.add.at(target, (flat, tags[:, None]), 1)
        inner = np.ones(len(tags), bool)
        inner[begin] = False
        moves = np.zeros_like(self.move)
        np.add.at(moves, (tags[np.flatnonzero(inner) - 1], tags[inner]), 1)
        longest, count = int(sizes[0]), np.array([(sizes > t).sum() for t in range(sizes[0])])
        parts = [(self.emit, target), (self.move, moves)]
        state = [(np.zeros_like(w), np.zeros_like(w)) for w, _ in parts]
        for step in range(1, rounds + 1):
            emit, move = self.scores(features), np.exp(self.move)
            heat = np.exp(emit - emit.max(axis=1, keepdims=True))
            ahead, behind = np.empty_like(heat), np.ones_like(heat)
            ahead[begin] = heat[begin] / heat[begin].sum(axis=1, keepdims=True)
            for t in range(1, longest):
                at = begin[: count[t]] + t
                value = ahead[at - 1] @ move * heat[at]
                ahead[at] = value / value.sum(axis=1, keepdims=True)
            expected = np.zeros_like(self.move)
            for t in range(longest - 1, 0, -1):
                at = begin[: count[t]] + t
                value = heat[at] * behind[at]
                back = value @ move.T
                joint_sum = (ahead[at - 1] * back).sum(axis=1, keepdims=True)
                expected += (ahead[at - 1] / joint_sum).T @ value * move
                behind[at - 1] = back / back.sum(axis=1, keepdims=True)
            belief = ahead * behind
            belief /= belief.sum(axis=1, keepdims=True)
            model = np.zeros_like(self.emit)
            for i in range(len(_TABLES)):
                for k in range(_TAGS):
                    model[:, k] += np.bincount(flat[:, i], belief[:, k], len(model))
            for (w, goal), (m, v), seen in zip(parts, state, (model, expected), strict=True):
                g = (seen - goal) / len(lines) + 1e-3 * w
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        self.trained = True
        return self

    def viterbi(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """The best tag of every word of a slice, and the scores it was decoded from."""
        scores = self.scores(words.features)
        best, come = scores.copy(), np.zeros(scores.shape, np.uint8)
        order = np.argsort(-words.line_sizes, kind="stable")
        begin, sizes = words.lines[order], words.line_sizes[order]
        count = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), "left")
        for t in range(1, len(count)):
            at = begin[: count[t]] + t
            total = best[at - 1][:, :, None] + self.move
            come[at] = total.argmax(axis=1)
            best[at] += total.max(axis=1)
        tags = np.zeros(len(scores), np.int64)
        last = begin + sizes - 1
        tags[last] = best[last].argmax(axis=1)
        for t in range(len(count) - 1, 0, -1):
            at = begin[: count[t]] + t
            tags[at - 1] = come[at, tags[at]]
        return tags, scores


def _tags_of(words: Words, spans: list[tuple[int, int, int]], text: str, number: int) -> np.ndarray:
    """Tags of the words of one text, from its base spans."""
    a, b = words.first[number], words.first[number + 1]
    tags = np.zeros(b - a, np.int64)
    for kind, start, end in spans:
        lo = words.offsets[number] + len(text[:start].encode())
        hi = lo + len(text[start:end].encode())
        tags[(words.starts[a:b] < hi) & (words.ends[a:b] > lo) & (tags == 0)] = kind + 1
    return tags


def known_spans(text: str) -> list[tuple[int, int, int]]:
    """The base spans of a text and the sure forms that the patterns miss."""
    base, refused = matches(text)
    out = list(base)
    for kind in range(len(KINDS)):
        out += [x for x in sure_forms(kind, text) if allowed(x, out, refused)]
    return out


def _form(kind: int, rng: random.Random) -> str:
    """A value of a kind in a form that the patterns miss."""
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    w = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9)))
    if kind == 0:
        at, dot = rng.choice(((" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" at ", " dot "), (" [at] ", ".")))
        return rng.choice((f"{w()}{rng.choice(('', '.' + w(), d(2)))}{at}{w()}{dot}{rng.choice(('com', 'org', 'net', 'de'))}", f"{w()}\u00e9@{w()}\u00fc.{w()}", f"{w()}@{w()}"))
    if kind == 1:
        h = lambda: f"{rng.randrange(1 << rng.choice((4, 8, 12, 16))):x}"
        groups = [h() for _ in range(rng.randint(2, 7))]
        cut = rng.randint(1, len(groups) - 1)
        sign = rng.choice(("[.]", "(.)"))
        return rng.choice((f"2001:{':'.join(groups[:cut][:5])}::{':'.join(groups[cut:][:2])}", ":".join(h() for _ in range(8)), f"fe80::{h()}:{h()}", sign.join(str(rng.randrange(256)) for _ in range(4))))
    if kind == 2:
        digits = d(15)
        digits += next(c for c in "0123456789" if _luhn(digits + c))
        return rng.choice((".", " - ", "_", "/", "\u2013")).join(digits[i : i + 4] for i in range(0, 16, 4))
    return rng.choice((
        f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}){d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(3)} {d(3)} {d(3)}", f"0{d(3)} {d(3)} {d(3)}",
        f"0{d(2)} {d(4)} {d(4)}", f"0{d(3)}-{d(3)}-{d(3)}", f"(0{d(2)}) {d(4)} {d(4)}", f"0{d(4)} {d(3)} {d(3)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"00{d(2)} {d(2)} {d(3)} {d(4)}",
    ))


def _number(rng: random.Random) -> str:
    """A number that is no personal data."""
    d = lambda n: rng.choice("123456789") + "".join(rng.choices("0123456789", k=n - 1))
    year, month, day = rng.randint(1900, 2040), rng.randint(1, 12), rng.randint(1, 28)
    return rng.choice((
        f"{year}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.{year}", f"{month:02d}/{day:02d}/{year}", f"{year}-{year + 3}", f"{day:02d}:{month:02d}:{day:02d}", f"{year}-{month:02d}-{day:02d} {day:02d}:{month:02d}:{day:02d}",
        f"{year}-{month:02d}-{day:02d}T{day:02d}:{month:02d}:{day:02d}", f"{day}.{month}.{d(2)}", f"v{month}.{day}.{month}", f"{d(3)} {d(3)} {d(3)}", f"{d(1)} {d(2)} {d(3)} {d(2)} {d(4)}", f"{d(3)},{d(3)},{d(3)}", f"${d(3)}.{d(2)}",
        f"{d(rng.randint(1, 12))}", f"{d(3)}.{d(3)}.{d(3)}", f"{d(2)}-{d(2)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"{d(3)}.{d(5)}", f"at {d(2)}", f"{d(3)}.{rng.randint(256, 999)}.{d(2)}.{d(1)}", f"{d(4)}:{d(4)}",
    ))


def rewritten(texts: list[str], around: int = 12, forms: int = FORMS) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """The surroundings of base spans with another form of a kind in place of the span, or with some other number, and their spans.

    About ``forms`` of each, at least one for every base span.
    """
    rng, out = random.Random(7), []
    places = [(text, *span) for text in texts for span in matches(text)[0]]
    for text, kind, start, end in places:
        line, upto = text.rfind("\n", 0, start) + 1, text.find("\n", end)
        left = " ".join(text[max(line, start - 30 * around) : start].split(" ")[-around - 1 :])
        right = " ".join(text[end : min(upto if upto >= 0 else len(text), end + 30 * around)].split(" ")[: around + 1])
        beside = [x for x in matches(left + "\n" + right)[0] if x[2] <= len(left)]
        for _ in range(-(-forms // len(places))):
            other = kind if rng.random() < 0.5 else rng.randrange(len(KINDS))
            value = _form(other, rng)
            out.append((left + value + right, [*beside, (other, len(left), len(left) + len(value))]))
            out.append((left + _number(rng) + right, beside))
    return out


def labelled_lines(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features and tags of the lines labelled by hand, of every line that holds a span, of as many that hold none, and of the rewritten surroundings."""
    marked, plain, more = [], [], rewritten(texts)
    own = [(t, known_spans(t)) for t in texts]
    hand = [(t, [(KINDS.index(k), a, b) for k, a, b in spans]) for t, spans in pii_lines.labelled()]
    for source, is_own in ((own, True), (more, False), (hand * HAND_TIMES, False)):
        for i in range(0, len(source), 100):
            some = source[i : i + 100]
            words = Words(pa.array([t for t, _ in some], pa.large_string()))
            tags = np.concatenate([_tags_of(words, spans, t, j) for j, (t, spans) in enumerate(some)])
            for a, n in zip(words.lines, words.line_sizes, strict=True):
                if n <= LINE_WORDS:
                    (marked if not is_own or tags[a : a + n].any() else plain).append((words.features[a : a + n], tags[a : a + n]))
    step = max(1, len(plain) // max(1, len(marked)))
    return marked + plain[::step][: max(len(marked), 1)]


def train(docs: DataFrame, text: str = "text", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Field:
    """A field trained on the lines of at most ``sample_docs`` documents that hold a digit or an @, those of least hash."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_or_empty(text).alias("text"))
    ids = source.where(F.col("text").rlike("[0-9@]") & (F.char_length("text") <= sample_chars)).select("doc_id").where("doc_id is not null")
    chosen = F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct())  # at most sample_docs numbers
    rows = source.where(F.char_length("text") <= sample_chars).join(chosen, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return shared.learn_in_a_task(rows, lambda sample: Field().train(labelled_lines([r["text"] for r in sorted(sample, key=lambda r: r["doc_id"])])))


def _spelt(words: Words, a: int, b: int) -> bool:
    """Whether a run may hold an address with its @ written as a word."""
    return b"at" in words.data[words.starts[a] : words.ends[b - 1]].tobytes().lower()


def _field_spans(words: Words, tags: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Runs of one tag inside a line, by text: (kind number, first byte, end byte) within the text."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    new = np.ones(len(tags), bool)
    new[1:] = tags[1:] != tags[:-1]
    new[words.lines] = True
    begins = np.flatnonzero(new)
    finals = np.concatenate((begins[1:], [len(tags)]))
    hit = tags[begins] > 0
    for a, b in zip(begins[hit], finals[hit], strict=True):
        tag = tags[a]
        if words.digits[a:b].sum() + words.ats[a:b].sum() == 0 and not _spelt(words, a, b):
            continue
        number = int(np.searchsorted(words.first, a, "right")) - 1
        base = words.offsets[number]
        out.setdefault(number, []).append((int(tag) - 1, int(words.starts[a] - base), int(words.ends[b - 1] - base)))
    return out


def find_spans(column: pa.Array, model: Field) -> list[tuple[list, list]]:
    """For every text its base spans and the spans that the field adds, in code points."""
    words = Words(column)
    sums = lambda mask: np.concatenate(([0], np.cumsum(mask)))
    digits, ats, pluses = sums(_KIND[words.data] == 3), sums(words.data == ord("@")), sums(words.data == ord("+"))
    held = [x[words.offsets[1:]] - x[words.offsets[:-1]] for x in (digits, ats, pluses)]
    added = {}
    if model.trained and len(words.starts):
        added = _field_spans(words, model.viterbi(words)[0])
    out = []
    for i in range(len(words.offsets) - 1):
        may = held[0][i] >= 4 or held[1][i]
        if not may and i not in added:
            out.append(([], []))
            continue
        raw = words.data[words.offsets[i] : words.offsets[i + 1]].tobytes()
        text = raw.decode()
        base, refused = matches(text) if may or i in added else ([], [])
        more = []
        for kind, lo, hi in added.get(i, ()):
            lo, hi = len(raw[:lo].decode()), len(raw[:hi].decode())
            more += [x for x in values(kind, text, lo, hi) if allowed(x, base + more, refused)]
        out.append((base, more))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first names all."""
    out, at = [], 0
    for start, end, kind in sorted((s, e, k) for k, s, e in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def spans_of(docs: DataFrame, model: Field, text: str = "text") -> DataFrame:
    """doc_id, counts of each kind, base spans and all spans of every document."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shared.text_or_empty(text).alias("text"))
    schema = shared.fields(("doc_id", T.LongType()), *((f"n_{k}", T.LongType()) for k in KINDS), ("base_spans", T.StringType()), ("spans", T.StringType()))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.slices(batches):
            found = find_spans(part.column("text"), sent.value)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(len(KINDS))]
            texts = [pa.array([written(base) for base, _ in found], pa.string()), pa.array([written(base + more) for base, more in found], pa.string())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, *texts], names=schema.names)

    return source.mapInArrow(find, schema)


def report(docs: DataFrame) -> DataFrame:
    found = spans_of(docs, train(docs))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def mask_documents(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns, with every span in ``text`` replaced by its kind, and ``n_chars``, where there is one, counted anew."""
    model = train(docs, text)
    sent, names, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns, docs.columns.index(text)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.slices(batches, text):
            column = part.column(at)
            values = None
            for i, (base, more) in enumerate(find_spans(column, sent.value)):
                if base or more:
                    values = column.to_pylist() if values is None else values
                    values[i] = masked(values[i], base + more)
            columns = part.columns
            if values is not None:
                columns[at] = pa.array(values, column.type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(mask, docs.schema)
    if "n_chars" in names and text != "n_chars":
        out = out.withColumn("n_chars", F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out
