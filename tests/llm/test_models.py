"""Quality rules, classifier, language model, packing, chat format and the pipeline."""

import itertools
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from blankweave.llm import chat_format, packing, quality_model, quality_rules, recurrent_lm

from llm_helpers import AWKWARD, by_id, documents, sentences


def junk(seed):
    return " ".join(w + "%%%" for w in sentences(seed, 60).split())


def labelled(spark, n=240):
    rows = [(i, junk(i) if i % 4 == 0 else sentences(i, 60).capitalize()) for i in range(1000, 1000 + n)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    return rows, labels


# --- quality rules ------------------------------------------------------------
def plain_counts(text):
    words = (text or "").encode().split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_counts_equal_the_plain_ones(spark):
    rows = [r for r in AWKWARD if r[0] not in (7, None)] + [(50 + i, (sentences(i, 12) + "\n") * (1 + i % 3) + sentences(i, 25) + "\n \n" + "a|b#") for i in range(30)]
    got = by_id(quality_rules.report(documents(spark, rows), labelled(spark)[1]))
    for i, text in rows:
        r = got[i][0]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(text), i
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert len(got[6]) == 2


def test_cutoffs_are_exact():
    for k, n, p in itertools.product((0, 1, 5), (10, 60), (0.01, 0.2)):
        assert abs(quality_rules.binomial_at_most(k, n, p) - sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))) < 1e-9
    good, bad = np.zeros(51, np.int64), np.zeros(51, np.int64)
    good[2], bad[30] = 1000, 100
    cut = quality_rules.choose_cutoff(good, bad, 0.01, 0.01)
    assert cut == 29 / 50
    assert quality_rules.choose_cutoff(good // 50, bad, 0.01, 0.01) is None


def test_rules_reject_junk_and_keep_the_rest(spark, monkeypatch):
    rows, labels = labelled(spark, 1600)
    got = by_id(quality_rules.judge(documents(spark, rows), labels, ["doc_id"], risk=0.2).selectExpr("doc_id", "_rule_kept AS kept"))
    assert all(r[0]["kept"] == (i % 4 != 0) for i, r in got.items())
    none = documents(spark, [])
    assert quality_rules.report(none, labels).count() == 0
    stage = quality_rules.filter_documents(documents(spark, AWKWARD), labels)
    assert stage.columns == none.columns and {r["doc_id"] for r in stage.collect()} == {6, 7, 10}


# --- classifier ---------------------------------------------------------------
def test_classifier_on_held_out_rows(spark):
    rows, labels = labelled(spark)
    docs = documents(spark, [*rows, *AWKWARD])
    got = by_id(quality_model.report(docs, labels))
    held = [r[0] for i, r in got.items() if i is not None and i >= 1000 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 20 and all(r["held_out"] for r in held)
    assert all(r["predicted"] == (r["doc_id"] % 4 != 0) for r in held)
    assert all(0 <= r["score"] <= 1 for rows_ in got.values() for r in rows_) and len({r["score"] for r in got[6]}) == 1
    assert got[1][0]["score"] == got[2][0]["score"]
    one_label = labels.where("quality = 1")
    assert {r["score"] for r in quality_model.report(docs, one_label).collect()} == {0.5}
    assert quality_model.report(documents(spark, []), labels).count() == 0
    kept = quality_model.filter_documents(docs, labels)
    assert kept.columns == docs.columns and not any(r["doc_id"] % 4 == 0 for r in kept.where("doc_id >= 1000").collect())


# --- language model -----------------------------------------------------------
def test_gradients_equal_differences():
    keys = np.arange(1, 70, dtype=np.uint64)
    net = recurrent_lm.Network(keys, np.arange(69, 0, -1).astype(float), 40.0)
    rng = np.random.default_rng(3)
    net.set_weights(net.weights() + rng.normal(0, 0.2, net.weights().shape) * (np.abs(net.weights()) < 1e3))
    inputs, targets = rng.integers(0, 60, (6, 4)), rng.integers(0, 69, (6, 4))
    fresh = rng.random((6, 4)) < 0.2
    state = np.zeros((4, recurrent_lm.HIDDEN), np.float32)
    parts, _ = net.gradients(inputs, fresh, targets, state)
    exact = np.concatenate([g.reshape(-1) for g in parts])

    def loss(flat):
        net.set_weights(flat)
        h, total = state, 0.0
        for t in range(6):
            h = h * ~fresh[t][:, None]
            h, *_ = net.step(net.read[inputs[t]], h)
            total -= net.log_probabilities(h, targets[t]).sum()
        return total / 24

    flat = net.weights().astype(np.float64)
    for i in rng.choice(np.flatnonzero(np.abs(exact) > 1e-3), 25, replace=False):
        up, down = flat.copy(), flat.copy()
        up[i] += 5e-3
        down[i] -= 5e-3
        assert abs((loss(up) - loss(down)) / 1e-2 - exact[i]) < 5e-3 + 0.05 * abs(exact[i])


def test_probabilities_sum_to_one():
    net = recurrent_lm.Network(np.arange(1, 70, dtype=np.uint64), np.arange(69, 0, -1).astype(float), 40.0)
    h = np.random.default_rng(1).normal(0, 1, (1, recurrent_lm.HIDDEN)).astype(np.float32)
    total = sum(float(np.exp(net.log_probabilities(h, np.array([k])))[0]) for k in range(70))
    assert abs(total - 1) < 1e-4


def test_scores(spark):
    rows = [(i, " ".join(["red green blue yellow"] * 12) if i % 2 else " ".join(["one two three four"] * 12)) for i in range(60)] + [r for r in AWKWARD if r[0] is not None]
    docs = documents(spark, rows)
    got = by_id(recurrent_lm.report(docs, share=1 / 2))
    counts, texts = {}, {}
    for i, text in rows:
        texts.setdefault(i, []).append([*(text or "").encode().lower().split(), None])
        if zlib.crc32(str(i).encode()) % 7 != 2:
            for w in texts[i][-1]:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, all_words in texts.items():
        for words, r in zip(all_words, got[i]):
            assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(words), sum(w in counts for w in words), n, zlib.crc32(str(i).encode()) % 7 == 2)
            base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words)
            assert abs(r["base_score"] - base) < 1e-6 * abs(base)
            assert r["score"] < 0
    short = [r[0] for i, r in got.items() if i >= 20 and r[0]["held_out"]]
    assert sum(r["score"] for r in short) > sum(r["base_score"] for r in short)
    assert recurrent_lm.report(documents(spark, [])).count() == 0


def test_the_network_learns_from_every_training_document(spark, monkeypatch):
    """With the settings of the query all tokens of training documents are trained on, each once."""
    words, averaged = [], recurrent_lm._averaged

    def noted(trained):
        rows = averaged(trained)
        words.append(sum(r["words"] for r in rows if r["slice"] == 0))
        return rows

    monkeypatch.setattr(recurrent_lm, "_averaged", noted)
    got = recurrent_lm.report(documents(spark, [(i, sentences(i, 1 + i % 9)) for i in range(300)])).first()
    assert sum(words) == got["train_tokens"] == sum(2 + i % 9 for i in range(300) if zlib.crc32(str(i).encode()) % 7 != 2)


def test_training_leaves_no_word_out(monkeypatch):
    net, seen = recurrent_lm.Network(np.arange(1, 70, dtype=np.uint64), np.ones(69), 1.0), []
    plain = net.gradients
    monkeypatch.setattr(net, "gradients", lambda i, f, t, s: (seen.extend(t.reshape(-1).tolist()), plain(i, f, t, s))[1])
    net.train(np.zeros(67, np.int32), np.zeros(67, bool), np.arange(1, 68, dtype=np.int32))
    assert set(seen) == set(range(1, 68))


def test_classes_share_the_passes_over_their_members(monkeypatch):
    """Exponentials are taken once for all classes and once for the members of all, not class by class."""
    net = recurrent_lm.Network(np.arange(1, 1024, dtype=np.uint64), np.ones(1023), 1.0)
    rng, calls, plain = np.random.default_rng(5), [], np.exp
    monkeypatch.setattr(np, "exp", lambda *a, **k: (calls.append(1), plain(*a, **k))[1])
    inputs, targets = rng.integers(0, 1023, (8, 256)), rng.integers(0, 1024, (8, 256))
    net.gradients(inputs, np.zeros((8, 256), bool), targets, np.zeros((256, recurrent_lm.HIDDEN), np.float32))
    assert len(set((targets // recurrent_lm.MEMBERS).reshape(-1))) == 32 and len(calls) == 2
    got = net.log_probabilities(rng.normal(0, 1, (2048, recurrent_lm.HIDDEN)).astype(np.float32), targets.reshape(-1))
    assert len(calls) == 4 and got.shape == (2048,)


def test_units_of_a_step_are_whole_runs_of_memory():
    net = recurrent_lm.Network(np.arange(1, 70, dtype=np.uint64), np.ones(69), 1.0)
    rng = np.random.default_rng(6)
    read, state = net.read[rng.integers(0, 60, 5)], rng.normal(0, 1, (5, recurrent_lm.HIDDEN)).astype(np.float32)
    new, gates, candidate, inner = net.step(read, state)
    assert all(x.T.flags.c_contiguous for x in (new, gates, candidate, inner))
    size = recurrent_lm.HIDDEN
    for i in range(5):
        again = state[i].astype(float) @ net.again
        gate = 1 / (1 + np.exp(-(read[i, : 2 * size] + again[: 2 * size])))
        inside = np.tanh(read[i, 2 * size :] + gate[size:] * again[2 * size :])
        assert np.allclose(new[i], gate[:size] * state[i] + (1 - gate[:size]) * inside, atol=1e-5)


def test_places_are_looked_up_without_a_search(monkeypatch):
    keys = np.array([9, 3, 2**64 - 1, 5], np.uint64)
    net, none = recurrent_lm.Network(keys, np.ones(4), 1.0), recurrent_lm.Network(keys[:0], np.ones(0), 1.0)
    monkeypatch.setattr(np, "searchsorted", None)
    assert net.places(np.array([5, 4, 2**64 - 1, 9, 9, 0, 3], np.uint64)).tolist() == [4, 0, 3, 1, 1, 0, 2]
    assert net.places(keys[:0]).tolist() == [] and none.places(keys).tolist() == [0, 0, 0, 0]


def test_a_long_text_scores_like_its_words_in_turn():
    net = recurrent_lm.Network(np.arange(1, 70, dtype=np.uint64), np.arange(69, 0, -1).astype(float), 40.0)
    rng = np.random.default_rng(1)
    targets = rng.integers(0, 69, 700).astype(np.int32)
    inputs = rng.integers(0, 69, 700).astype(np.int32)
    bounds = np.array([0, 3, 500, 501, 700])
    h, want, at = None, [], 0
    for a, b in itertools.pairwise(bounds):
        h, total = np.zeros((1, recurrent_lm.HIDDEN), np.float32), 0.0
        for t in range(a, b):
            h, *_ = net.step(net.read[inputs[t : t + 1]], h)
            total += float(net.log_probabilities(h, targets[t : t + 1])[0])
        want.append(total)
    assert np.allclose(net.score(inputs, targets, bounds), want, rtol=1e-3)


# --- packing ------------------------------------------------------------------
def test_boundaries_are_optimal():
    rng = np.random.default_rng(4)
    for _ in range(40):
        edges = sorted(rng.choice(60, rng.integers(1, 9), replace=False).tolist())
        counts = rng.integers(1, 9, len(edges)).tolist()
        most = int(rng.integers(1, 5))

        def padded(bounds):
            return sum(c * next(b for b in bounds if b >= e) for e, c in zip(edges, counts))

        got = packing.boundaries(edges, counts, most)
        best = min(padded([*inner, edges[-1]]) for k in range(most) for inner in itertools.combinations(edges[:-1], k))
        assert padded(got) == best and len(got) <= most


def test_batches_hold_their_budget(spark):
    rows = [(i, sentences(i, 1 + i * i % 700)) for i in range(20, 300)] + AWKWARD
    got = packing.pack(documents(spark, rows), budget=2000, part_rows=50).collect()
    assert len(got) == len(rows)
    batches = {}
    for r in got:
        assert r["n_tokens"] + r["padding"] == r["bucket"] and r["padding"] >= 0
        batches.setdefault(r["batch_id"], []).append(r)
    for rows_ in batches.values():
        assert len({r["bucket"] for r in rows_}) == 1 and sorted(r["slot"] for r in rows_) == list(range(len(rows_)))
        assert len(rows_) == 1 or len(rows_) * rows_[0]["bucket"] <= 2000
    assert packing.pack(documents(spark, [])).count() == 0
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2, 3)} == {0}


def test_boundaries_of_many_lengths_are_exact():
    rng = np.random.default_rng(9)
    lengths = sorted(set(rng.lognormal(6, 1.2, 700).astype(int).tolist()))
    counts = rng.integers(1, 1 << 50, len(lengths)).tolist()
    docs = np.array([0, *itertools.accumulate(counts)], object)
    cost = [0, *(x * d for x, d in zip(lengths, docs[1:]))]
    for _ in range(4):
        cost = [0, *(min(cost[i] + lengths[j - 1] * (docs[j] - docs[i]) for i in range(j)) for j in range(1, len(lengths) + 1))]
    bounds = packing.boundaries(lengths, counts, 5)
    assert sum(c * next(b for b in bounds if b >= x) for x, c in zip(lengths, counts)) == cost[-1]


def test_packed_rows_have_the_least_padding(spark):
    rows = [(i, sentences(i, 1 + i * i % 900)) for i in range(20, 200)] + AWKWARD
    got = packing.pack(documents(spark, rows), buckets=3).collect()
    lengths = sorted(r["n_tokens"] for r in got)
    best = min(
        sum(next(b for b in (*inner, lengths[-1]) if b >= x) - x for x in lengths)
        for inner in itertools.combinations(sorted(set(lengths))[:-1], 2)
    )
    assert sum(r["padding"] for r in got) == best


def test_hot_ids_spread_over_the_parts(spark):
    rows = [(None, f"w{i} word") for i in range(300)] + [(None, "same text") for _ in range(300)] + [(7, f"v{i} word") for i in range(300)]
    got = packing.pack(documents(spark, rows), part_rows=100, budget=20).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r["doc_id"], {}).setdefault(r["batch_id"].split("-")[1], []).append(r)
    assert len(got) == 900
    for parts in sizes.values():
        assert len(parts) == 9 and max(map(len, parts.values())) < 2 * sum(map(len, parts.values())) / 9


# --- chat format --------------------------------------------------------------
HARD = "\\### Assistant: </turn>\n\\l \\b # < : ok"


def test_chat_round_trip(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", HARD), (1, 2, "assistant", HARD), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "bye"),
            (2, 0, "user", "only"), (3, 0, "ro:le <#\\", "x"), (3, 1, "assistant", "y" * 50_000), (4, 1, "assistant", "same"), (4, 1, "assistant", "same"), (None, 0, None, "z")]
    given = spark.createDataFrame([(*r, "extra", 7) for r in rows], "conv_id long, turn long, role string, text string, turns string, example long")
    examples = chat_format.format_examples(given)
    read = examples.where("last").select("conv_id", chat_format.read_turns(examples["formatted"]).alias("t")).collect()
    for r in read:
        assert [tuple(t) for t in r["t"]] == [(role or "", text or "") for c, _, role, text in rows if c == r["conv_id"]]
    losses = examples.where("loss_start is not null").select("conv_id", "example", chat_format.read_loss(examples["formatted"], examples["loss_start"], examples["loss_chars"]).alias("loss")).collect()
    got = {}
    for r in sorted(losses, key=lambda r: r["example"]):
        got.setdefault(r["conv_id"], []).append(r["loss"])
    assert got == {1: [HARD, ""], 3: ["y" * 50_000], 4: ["same", "same"]}
    report = {r["conv_id"]: r for r in chat_format.report(given).collect()}
    assert report[2]["loss_chars"] == 0 and report[1]["n_turns"] == 6 and report[4]["n_turns"] == 2
    assert chat_format.report(given.where("false")).count() == 0


# --- pipeline -----------------------------------------------------------------
def test_pipeline_stages_keep_columns_and_bite(spark, tmp_path):
    rows, labels = labelled(spark, 1600)
    rows += [*AWKWARD, (5000, rows[1][1] + " again"), (5001, sentences(77, 40) + " who@mail.example.com")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    left = by_id(docs)
    assert 5000 not in left and 1001 in left and not any(i is not None and 1000 <= i < 2600 and i % 4 == 0 for i in left)
    assert left[5001][0]["text"].endswith("[EMAIL]")
    final = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(str(r["doc_id"]) for r in final.collect()) == sorted(str(r["doc_id"]) for r in docs.collect())


def test_pipeline_of_nothing(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    labelled(spark, 8)[1].write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
