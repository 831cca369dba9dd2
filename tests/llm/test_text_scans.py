"""License scan, personal data, BPE and edit fingerprints against plain forms."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from blankweave.llm import bpe, edit_fingerprint, license_scan, pii, pii_lines

import pii_held_out
from llm_helpers import AWKWARD, by_id, documents, sentences


# --- license scan ------------------------------------------------------------
def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


@pytest.mark.parametrize("text", [
    "Released under the MIT License.", "under  the--MIT\nlicense under the mit license", "Apache License, Version 2.0", "cc BY-nc cc by nc nc",
    "aunder the mit license", "under the mit licenses", "", "é under the mit license é", "apache license version 2apache license version 2",
])
def test_base_places(text):
    words = words_of(text)
    want = sorted((i, label) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    n, places = license_scan.scan(text)
    assert n == len(words) and [(f, label) for f, _, label, _, base, _ in places if base] == want


@pytest.mark.parametrize("text, label, edits", [
    ("relased under teh mit license", "mit", 2), ("under the mitt license", "mit", 1), ("apache licence version 2", "apache-2", 1),
    ("the gnu general public license", "gpl", 0), ("GNU Genral Public License", "gpl", 1),
])
def test_misspelt_places(text, label, edits):
    _, places = license_scan.scan("some words " + text + " more words")
    assert [(x[2], x[3]) for x in places] == [(label, edits)]


def edit_counts(phrase, words):
    """Edits, start and end of every run of whole words that is as near to the phrase as its notice allows, in ``" word word "``."""
    out, starts = [], [i + 1 for i, c in enumerate(words[:-1]) if c == " "]
    for s in starts:
        for e in (i for i in range(s + 1, min(len(words), s + len(phrase) + 6)) if words[i] == " "):
            row = list(range(e - s + 1))
            for i, c in enumerate(phrase, 1):
                last, row[0] = row[0], i
                for j in range(1, len(row)):
                    last, row[j] = row[j], min(last + (words[s + j - 1] != c), row[j] + 1, row[j - 1] + 1)
            out.append((row[-1], s, e))
    return out


def test_fuzzy_places_equal_edit_distances():
    for seed in range(12):
        phrases = ["under the mit license", "gnu genral public licence", "mozila public license", "cc by nc sa", "sil open font licenses", "gnu general public license version 3"]
        text = " ".join(f"{sentences(seed * 9 + i, 4, 'abehilmnrstu')} {phrases[(seed + i) % 6]}" for i in range(3)).replace("mit" if seed % 2 else "i", "mt" if seed % 3 else "y", 1)
        joined = b" " + b" ".join(w.encode() for w in words_of(text)) + b" "
        for notice in license_scan.NOTICES:
            near = [x for x in edit_counts(notice.phrase.decode(), joined.decode()) if x[0] <= notice.edits]
            want = sorted((s, e, edits) for edits, s, e in license_scan.apart(sorted(near)))
            got = sorted((s, e, edits) for s, e, edits, _ in license_scan.Finder((notice,)).places(joined))
            assert [x[2] for x in got] == [x[2] for x in want], (notice.phrase, text)
            assert all(a[0] < b[1] and b[0] < a[1] for a, b in zip(got, want))


@pytest.mark.parametrize("text, labels", [
    ("MIT License", "mit"), ("SPDX-License-Identifier: Apache-2.0", "apache-2"), ("GPL v3", "gpl-3"), ("GNU Lesser General Public License", "lgpl"),
    ("Creative Commons Attribution 4.0", "cc-by"), ("CC BY-NC-SA", "cc-by-nc,cc-by-nc-sa"), ("GNU General Public License, version 3", "gpl,gpl-3"),
    ("gnu genral public license version 3", "gpl-3"), ("Mozila Public Licence", "mpl"), ("BSD-3-Clause licence", "bsd-3"), ("the exit license of a limit license", ""),
    ("a public license for commons", ""), ("general license", ""), ("under teh mit license, under the mit license", "mit"),
])
def test_labels_of_short_notices(text, labels):
    _, places = license_scan.scan(f"words {text} words")
    assert ",".join(sorted({p[2] for p in places})) == labels


def test_many_places_in_one_text():
    text = "under teh mit license x " * 20000
    n, places = license_scan.scan(text)
    assert n == 100000 and len(places) == 20000 and all(p[1] - p[0] == 3 for p in places)


def test_license_rows(spark):
    got = by_id(license_scan.report(documents(spark, [*AWKWARD, (20, "Under the MIT license; cc by-nc. UNDER THE MIT LICENSE")])))
    assert (got[20][0]["n_base"], got[20][0]["first_word"], got[20][0]["last_word"], got[20][0]["base_labels"], got[20][0]["score"]) == (3, 0, 7, "cc-by-nc,mit", 1.0)
    assert (got[1][0]["n_words"], got[1][0]["n_base"], got[1][0]["first_word"], got[1][0]["labels"], got[1][0]["score"]) == (0, 0, None, "", 0.0)
    assert len(got[6]) == 2 and license_scan.report(documents(spark, [])).count() == 0


# --- personal data ------------------------------------------------------------
PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def plain_spans(text):
    out = []
    for kind, (name, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            luhn = sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if name == "ip" else True, "card": 13 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[name]
            if good:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_plain_patterns():
    import random

    rng = random.Random(5)
    parts = ["a@b.c", "@", "x_y", ".", "1.2.3.4", "256", " ", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "é", "9", "-", "_", "d@e.f.g", "0001.2.3.04", "12345678901234567890"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 9)))
        assert pii.matches(text)[0] == plain_spans(text), text


def test_long_runs_stay_linear():
    assert pii.matches("1" * 200_000)[0] == [] and pii.matches("a" * 200_000 + "@")[0] == []


def taught():
    rng = np.random.default_rng(2)
    texts = []
    for i in range(120):
        mail = f"{sentences(i, 1)}{i}@mail{i % 9}.example.com"
        call = f"+1 ({rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
        texts.append(f"{sentences(i + 500, 12)} {mail} {sentences(i + 900, 8)}.\n{sentences(i + 700, 9)} {call} {sentences(i, 5)}")
    return pii.Field().train(pii.labelled_lines(texts))


def test_field_tags_like_the_patterns_and_viterbi_is_exact():
    model = taught()
    texts = [f"{sentences(i + 3000, 10)} +1 (123) 555-77{i:02d} {sentences(i, 6)} zz{i}@mail3.example.com end" for i in range(30)]
    words = pii.Words(pa.array(texts, pa.large_string()))
    tags, scores = model.viterbi(words)
    want = np.concatenate([pii._tags_of(words, pii.matches(t)[0], t, j) for j, t in enumerate(texts)])
    assert (tags == want).mean() > 0.97
    # against all paths of a short line
    line = pii.Words(pa.array(["ab 12@x.y +1 (2"], pa.large_string()))
    got, scores = model.viterbi(line)
    import itertools

    value = lambda path: sum(scores[i, t] for i, t in enumerate(path)) + sum(model.move[a, b] for a, b in itertools.pairwise(path))
    best = max(itertools.product(range(5), repeat=len(got)), key=value)
    assert abs(value(best) - value(got.tolist())) < 1e-9


def test_spans_and_masks_of_awkward_rows(spark):
    rows = [*AWKWARD, *((100 + i, f"{sentences(i, 9)} m{i}@mail.example.com {sentences(i + 1, 9)}") for i in range(40)), (99, "né 1.2.3.4, a@b.c")]
    docs = documents(spark, rows)
    got = by_id(pii.report(docs))
    assert got[99][0]["base_sha256"] == hashlib.sha256(b"email:12:17,ip:3:10").hexdigest() and got[99][0]["n_ip"] == 1
    assert got[1][0]["spans"] == "" and len(got[6]) == 2
    masked = by_id(pii.mask_documents(docs))
    assert masked[99][0]["text"] == "né [IP], [EMAIL]" and masked[99][0]["n_chars"] == len("né [IP], [EMAIL]")
    assert masked[1][0]["text"] is None and masked[7][0]["text"] == AWKWARD[7][1] and masked[99][0]["bucket"] == "b"
    assert pii.mask_documents(documents(spark, [])).count() == 0 and pii.report(documents(spark, [])).count() == 0


MISSED = [
    ("phone", "(212) 555-0100"), ("phone", "212-555-0100"), ("phone", "0912 345 678"), ("phone", "555.867.5309"), ("ip", "2001:db8::ff00:42:8329"),
    ("card", "4111.1111.1111.1111"), ("email", "jane.doe [at] example [dot] com"),
]
NO_DATA = ["2024-01-15", "1.2.3", "1,234.56", "12:30:45", "1990-2000", "4111 1111 1111 1112", "256.300.1.2", "100 200 300"]


def test_the_field_adds_and_masks_what_the_patterns_miss(spark):
    mails = [(200 + i, f"{sentences(i, 9)} m{i}@mail.example.com {sentences(i + 1, 9)} +1 ({212 + i}) 555-0{100 + i} {sentences(i + 2, 9)}") for i in range(80)]
    rows = [(i, f"{sentences(i, 6)} {value} {sentences(i + 50, 6)}") for i, value in enumerate([*(v for _, v in MISSED), *NO_DATA], 1)]
    docs = documents(spark, [*mails, *rows])
    got, masked = by_id(pii.report(docs)), by_id(pii.mask_documents(docs))
    for i, (kind, value) in enumerate(MISSED, 1):
        start = rows[i - 1][1].index(value)
        assert got[i][0]["spans"] == f"{kind}:{start}:{start + len(value)}", value
        assert got[i][0]["base_sha256"] == hashlib.sha256(b"").hexdigest()
        assert masked[i][0]["text"] == rows[i - 1][1].replace(value, f"[{kind.upper()}]")
    assert [got[i][0]["spans"] for i in range(len(MISSED) + 1, len(rows) + 1)] == [""] * len(NO_DATA)


def test_field_on_lines_labelled_by_hand():
    lines = pii_lines.labelled(pii_held_out.LINES)
    assert not set(pii_held_out.LINES) & set(pii_lines.LINES)
    right = told = wanted = 0
    for (text, spans), (base, more) in zip(lines, pii.find_spans(pa.array([t for t, _ in lines], pa.large_string()), taught())):
        got, want = {(pii.KINDS[k], a, b) for k, a, b in more}, set(spans)
        assert not want & {(pii.KINDS[k], a, b) for k, a, b in base}
        right, told, wanted = right + len(got & want), told + len(got), wanted + len(want)
    assert right / told >= 0.95 and right / wanted >= 0.9


@pytest.mark.parametrize("kind, run, values", [
    (3, "(212-555-0100),", ["212-555-0100"]), (3, "(212) 555-0100.", ["(212) 555-0100"]), (3, "tel:+1.212.555.0100", ["+1.212.555.0100"]),
    (3, "212-555-0100 212-555-0101", ["212-555-0100", "212-555-0101"]), (3, "2021-05-30", []), (3, "12 ab 34", []), (0, "<jane [at] x.org>,", ["jane [at] x.org"]),
    (0, "see jane [at] x.org", ["jane [at] x.org"]), (0, "at", []), (1, "(2001:db8::1),", ["2001:db8::1"]), (1, "300[.]1[.]1[.]1", []), (2, "4111/1111/1111/1112", []), (3, "", []),
])
def test_values_of_a_tagged_run(kind, run, values):
    text = "aé " + run + " 99"
    assert [text[a:b] for _, a, b in pii.values(kind, text, 3, 3 + len(run))] == values


# --- BPE ---------------------------------------------------------------------
def vocabulary():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json")


def test_chunks_agree_with_the_whole_text():
    import random

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary())
    library.no_truncation()
    library.no_padding()
    coder, rng = bpe.Codec(vocabulary()), random.Random(3)
    parts = ["a", "  ", " ", "\n", "'s", "é", "ß", "漢", "1", "12 ", "!!", "<|endoftext|>", " the", "\t", "don't", "🙂", "​", " ", "  y", "word and word again "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 900))) for _ in range(150)] + ["ab" * 20000, "", " " * 3000, "x " * 5000, "<|endoftext|>"]
    data = [t.encode() for t in texts]
    offsets = np.concatenate(([0], np.cumsum([len(d) for d in data])))
    cuts, first = bpe.content_cuts(np.frombuffer(b"".join(data), np.uint8), offsets)
    assert len(cuts) > 300
    for i, text in enumerate(texts):
        ids = coder.encode(data[i], cuts[first[i] : first[i + 1]] - offsets[i])
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, np.uint32).tolist() == want
        assert coder.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_rows(spark):
    got = by_id(bpe.encode_documents(documents(spark, AWKWARD), vocabulary()))
    assert got[1][0]["n_tokens"] == 0 and got[1][0]["decoded"] == "" and len(got[6]) == 2
    assert all(r["decoded"] == text for i, text in AWKWARD if text is not None for r in got[i])
    digests = by_id(bpe.encode_documents(documents(spark, AWKWARD), vocabulary(), digests=True))
    assert digests[9][0]["ids_sha256"] == hashlib.sha256(np.array(got[9][0]["ids"], "<u4").tobytes()).hexdigest()
    assert bpe.encode_documents(documents(spark, []), vocabulary()).count() == 0


# --- edit fingerprints --------------------------------------------------------
def test_edited_rows_follow_descending_ids(spark, monkeypatch):
    rows = [(i, sentences(i, 5 + i % 40)) for i in range(0, 300, 3)] + [(1, None), (2, "")]
    docs = documents(spark, rows)
    monkeypatch.setattr(edit_fingerprint.next_in_order, "__defaults__", (17,))
    got = by_id(edit_fingerprint.report(docs))
    texts = {i: t or "" for i, t in rows}
    order = sorted(texts, reverse=True)
    for i, following in zip(order, order[1:] + order[:1]):
        half = len(texts[i]) // 2
        want = texts[i][: len(texts[i]) - half] + texts[following][:half]
        assert got[i][0]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest() and got[i][0]["n_chars"] == len(texts[i])
    long = [r[0] for r in got.values() if r[0]["n_chars"] > 60]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.95 * len(long)


def test_fingerprints_keep_edit_distance():
    base = sentences(1, 900)
    near = base[:500] + "XY" + base[502:1500] + base[1504:]
    far = sentences(2, 900)
    a, b, c, d = edit_fingerprint.walk([edit_fingerprint.letters_of(t) for t in (base, near, far, base)])
    assert (a == d).all()
    assert edit_fingerprint.likeness(a, b) > 0.6 > 0.1 > edit_fingerprint.likeness(a, c)
    alone = edit_fingerprint.walk([edit_fingerprint.letters_of(base)])[0]
    assert (alone == a).all()


def test_fingerprints_of_awkward_rows(spark):
    got = by_id(edit_fingerprint.report(documents(spark, AWKWARD)))
    assert sum(map(len, got.values())) == len(AWKWARD)
    assert got[1][0]["fingerprint"] == "" and got[4][0]["fingerprint"] == got[5][0]["fingerprint"]
    assert edit_fingerprint.report(documents(spark, [])).count() == 0
    assert edit_fingerprint.report(documents(spark, [(1, "alone here")])).first()["near_next"] == 1.0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance_equals_the_plain_one():
    import random

    rng = random.Random(8)
    for _ in range(400):
        a = [rng.randrange(3) for _ in range(rng.randint(0, 14))]
        b = list(a) if rng.random() < 0.5 else [rng.randrange(3) for _ in range(rng.randint(0, 14))]
        for _ in range(rng.randint(0, 3)):
            if b:
                b[rng.randrange(len(b))] = rng.randrange(3)
        want = plain_distance(a, b)
        for most in (0, 1, 3, 20):
            assert edit_fingerprint.edit_distance(np.array(a, np.int64), np.array(b, np.int64), most) == (want if want <= most else None)


def test_near_texts_against_brute_force(spark):
    import random

    rng, rows = random.Random(6), [(0, None), (1, "")]
    base = [sentences(40 + k, 70) for k in range(3)]
    for i in range(2, 60):
        text = list(base[i % 3]) if i % 4 else list(sentences(i, 70))
        for _ in range(rng.randint(0, 4)):
            at = rng.randrange(len(text))
            text[at : at + rng.randint(0, 2)] = rng.choice(["é", "x", ""])
        rows.append((i, "".join(text)))
    texts = {i: t or "" for i, t in rows}
    parent = {i: i for i in texts}
    for a in texts:
        for b in texts:
            longest = max(len(texts[a]), len(texts[b]))
            if a < b and longest and plain_distance(texts[a], texts[b]) <= longest * 10 // 100:
                x, y = parent[a], parent[b]
                parent = {k: min(x, y) if v in (x, y) else v for k, v in parent.items()}
    got = edit_fingerprint.near_texts(documents(spark, rows)).collect()
    found = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == len(rows) and found[0] == 0 and found[1] == 1
    together = [(a, b) for a in found for b in found if a < b and found[a] == found[b]]
    wanted = [(a, b) for a in parent for b in parent if a < b and parent[a] == parent[b]]
    # Nothing is linked that brute force keeps apart; the embedding finds nearly all that it links.
    assert set(together) <= set(wanted) and len(together) >= 0.85 * len(wanted) > 100
    assert edit_fingerprint.near_texts(documents(spark, [])).count() == 0
