"""Whitening, repeated passages and collocations against plain forms."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np

from blankweave.llm import collocations, repeated_passages, whitening

from llm_helpers import AWKWARD, documents, sentences


# --- whitening -----------------------------------------------------------------
def vectors(spark, rows):
    clashing = "vec_id long, embedding array<float>, label int, x string, n long, component string, i int, value string"
    floats = [(i, v and [None if c is None else float(c) for c in v]) for i, v in rows]
    return spark.createDataFrame([(i, v, 1, "x", 2, "c", 3, "v") for i, v in floats], clashing)


def test_polar_components_equal_a_symmetric_solver():
    rng = np.random.default_rng(3)
    for d, values in [(1, [2.0]), (2, [1.0, 1.0]), (7, [5, 5, 5, 1, 1, 0, 0]), (40, rng.random(40) ** 6), (12, [1e6, *[1.0] * 11]), (16, np.ones(16))]:
        q, _ = np.linalg.qr(rng.standard_normal((d, d)))
        a = q @ np.diag(values) @ q.T
        a = (a + a.T) / 2
        got, v = whitening.components_of(a)
        assert np.allclose(got, np.linalg.eigvalsh(a)[::-1], rtol=0, atol=1e-12 * np.abs(a).max() * d)
        assert np.abs(v.T @ v - np.eye(d)).max() < 1e-13 * d and np.abs(a @ v - v * got).max() < 1e-12 * max(values) * d
    assert np.allclose(whitening.components_of(np.zeros((3, 3)))[0], 0)


def test_polar_factor():
    a = np.random.default_rng(1).standard_normal((30, 30))
    a = a + a.T
    w, v = np.linalg.eigh(a)
    assert np.abs(whitening.polar(a) - v @ np.diag(np.sign(w)) @ v.T).max() < 1e-11


def test_whitened_rows_equal_plain_arithmetic(spark):
    rng = np.random.default_rng(9)
    data = (rng.standard_normal((300, 6)) * [3, 2, 1, 0.7, 0.4, 0.2]).astype(np.float32)
    rows = [(i, [float(v) for v in data[i]]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(600)]  # one vector holds two thirds of all rows
    bad = [(1, None), (2, []), (3, [1.0, None, 0, 0, 0, 0]), (4, [float("nan"), 0, 0, 0, 0, 0]), (5, [float("inf"), 0, 0, 0, 0, 0]), (6, [1.0, 2.0]), (7, [1e30, 0, 0, 0, 0, 0])]
    got = whitening.report(vectors(spark, rows + [(-i, v) for i, v in bad] + [(None, rows[0][1])])).collect()
    x = np.floor(data.astype(np.float64) * 256).astype(np.int64)
    listed = np.unique(x, axis=0)
    n, sums = len(listed), listed.sum(axis=0)
    values, v = np.linalg.eigh(np.cov(listed.T.astype(float), bias=True))
    values, v = values[::-1], v[:, ::-1]
    v = v * np.where(v[np.abs(v).argmax(axis=0), range(6)] < 0, -1, 1)
    assert len(got) == 4 * 901 and {r["vec_id"] for r in got} == {i for i, _ in rows} | {None}
    for r in got:
        i = 0 if r["vec_id"] is None else 7 if r["vec_id"] >= 1000 else r["vec_id"]
        c = r["component"] - 1
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums))
        assert abs(r["whitened"] - (x[i] - sums / n) @ v[:, c] / np.sqrt(values[c])) < 1e-9
        assert abs(r["explained"] - values[c] / values.sum()) < 1e-12 and r["identity_error"] < 1e-9


def test_awkward_vectors(spark):
    assert whitening.report(vectors(spark, [])).count() == 0
    assert whitening.report(vectors(spark, [(1, None)])).count() == 0
    one = whitening.report(vectors(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, None, None)] * 4
    flat = whitening.report(vectors(spark, [(1, [0.0, 1.0]), (2, [1.0, 1.0])])).orderBy("vec_id", "component").collect()
    assert np.allclose([r["explained"] for r in flat], [1.0, 0.0, 1.0, 0.0], atol=1e-12) and abs(abs(flat[0]["whitened"]) - 1) < 1e-12 and flat[1]["whitened"] is None
    far = whitening.report(vectors(spark, [(1, [2.0**40]), (2, [-(2.0**40)]), (3, [0.0])])).orderBy("vec_id").collect()
    assert far[2]["deviation"] == 0 and far[0]["deviation"] is None and abs(far[0]["whitened"] - 1.5**0.5) < 1e-9
    assert whitening.Whitening(3, [1], np.zeros(0), np.zeros((1, 0)), 0.0, 0).rest[0] == float(Fraction(1, 3))


# --- repeated passages -----------------------------------------------------------
def plain_passages(rows, size):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    times = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for (i, _), w in zip(rows, words):
        gone = {k for a in range(len(w) - size + 1) if times[tuple(w[a : a + size])] > 1 for k in range(a, a + size)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=repr)


def passages(spark, rows, size):
    got = repeated_passages.without_repeats(documents(spark, rows).repartition(5), size)
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()), key=repr)


def test_passages_equal_plain_form(spark):
    rng, rows = random.Random(2), [(i, t) for i, t, *_ in AWKWARD]
    shared_parts = [sentences(900 + k, 50) for k in range(3)]
    for i in range(100, 260):
        parts = [sentences(i, rng.randint(0, 80))]
        parts += [" ".join(rng.choice(shared_parts).split()[rng.randint(0, 20) : rng.randint(30, 50)]) for _ in range(rng.randint(0, 2))]
        parts.append(sentences(i + 5000, rng.randint(0, 30)))
        rows.append((i, rng.choice([" ", "\n", "\t\x0b"]).join(parts)))
    rows += [(700, "a " * 90), (701, "a b " * 40), (702, " ".join(f"w{k % 7}" for k in range(60)))]
    rows += [(800 + i, sentences(55, 60)) for i in range(300)]  # one text holds most rows
    assert passages(spark, rows, 35) == plain_passages(rows, 35)
    assert passages(spark, rows[:60], 3) == plain_passages(rows[:60], 3)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """Where the sketch lets all windows through, the exact pass still decides; slices and shards are small here."""
    monkeypatch.setattr(repeated_passages, "sketch_bits", lambda windows: repeated_passages.RANGE_BITS)
    monkeypatch.setattr(repeated_passages, "estimated_repeated", lambda bitmap, hashes, bits: np.arange(len(hashes)))
    rows = [(i, sentences(i % 40, 60) + " " + sentences(i, 30)) for i in range(90)] + [(1, None)]
    assert passages(spark, rows, 35) == plain_passages(rows, 35)


def test_sketch_counts_at_least_what_comes():
    import pyarrow as pa

    packed = repeated_passages._packed(np.array([0, 5, 300, (1 << 20) - 1], np.uint32))
    assert repeated_passages._unpacked(packed).tolist() == [0, 5, 300, (1 << 20) - 1]
    assert repeated_passages._unpacked(repeated_passages._packed(np.empty(0, np.uint32))).tolist() == []
    w = repeated_passages.Windows(pa.array(["a b c d", None, "", "b c d", "x"]), 3)
    assert w.begins.tolist() == [0, 2, 2, 2, 3, 3] and w.hashes[1] == w.hashes[2]
    assert w.second_hashes(np.array([1, 2]))[0] == w.second_hashes(np.array([2]))[0]


def test_no_documents(spark):
    assert repeated_passages.report(documents(spark, [])).count() == 0
    assert collocations.collocations(documents(spark, [])).count() == 0
    assert collocations.collocations(documents(spark, [(1, None), (2, " ., ")])).count() == 0


# --- collocations -----------------------------------------------------------------
def plain_collocations(rows, threshold, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in (1, 2, 3):
                f[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= threshold}
        rank = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            score, k, l, r = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rank.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rank)[:top])]
    return sorted(out)


def test_collocations_equal_plain_form(spark, monkeypatch):
    rng, rows = random.Random(4), []
    for i in range(150):
        words = [rng.choice("ab cd ef gh ij kl mn É Ü 日本 X-y zz".split()) for _ in range(rng.randint(0, 60))]
        marks = [rng.choice([" ", " ", "  ", "\t", ", ", "\n", ";", " . "]) for _ in words]
        rows.append((i, "".join(w + m for w, m in zip(words, marks)), rng.choice(["en", "en", "en", "de", None])))
    rows += [(500 + i, "Hot word pair here", "en") for i in range(300)] + [(i, t, "en") for i, t, *_ in AWKWARD]
    monkeypatch.setattr(collocations, "PART_MASS", 500)
    for threshold, top in ((10, 2000), (4, 7)):
        got = collocations.collocations(documents(spark, rows).repartition(6), threshold, top).collect()
        assert sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got) == plain_collocations(rows, threshold, top)


def test_summaries_keep_every_frequent_key():
    rng = np.random.default_rng(6)
    for _ in range(30):
        stream = np.minimum(rng.zipf(1.3, 4000), 1500).astype(np.uint32)
        summary = collocations.Summary(len(stream) // 10 + 1)
        for part in np.array_split(stream, 9):
            keys, counts = np.unique(part, return_counts=True)
            summary.merge(keys, np.minimum(counts, 10))
            assert len(summary.keys) <= summary.capacity
        keys, counts = np.unique(stream, return_counts=True)
        assert set(keys[counts >= 10].tolist()) <= set(summary.survivors(10).tolist())
        small = collocations.Summary(50)
        for part in np.array_split(stream, 9):
            small.merge(*np.unique(part, return_counts=True))
        true = dict(zip(keys.tolist(), counts.tolist()))
        assert all(c <= true[k] <= c + small.error for k, c in zip(small.keys.tolist(), small.counts.tolist())) and small.error <= len(stream) / 51
