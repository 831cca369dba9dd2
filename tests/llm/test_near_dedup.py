import random

import numpy as np
import pytest

from blankweave.llm import components, near_dedup, shared

from llm_helpers import AWKWARD, by_id, documents, sentences


def brute(rows, size):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        n = len(words)
        sets[i] = {tuple(words[k : k + size]) for k in range(max(1, n - size + 1))} if n else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size", [4, 5])
def test_groups_equal_brute_force(spark, size):
    rng, rows = random.Random(4), []
    base = [sentences(100 + k, 120).split() for k in range(4)]
    for i in range(500):
        words = list(base[i % 4]) if i % 3 else sentences(i, rng.randint(1, 60)).split()
        for _ in range(rng.randint(0, 6) if i % 3 else 0):
            words[rng.randrange(len(words))] = "w%d" % rng.randrange(5000)
        rows.append((i * 3, " ".join(words).upper() if i % 7 == 0 else " ".join(words)))
    want = brute(rows, size)
    got = near_dedup.near_duplicates(documents(spark, rows), size=size).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_blocks_of_a_large_group_lose_no_link(spark, monkeypatch):
    """A chain whose far members share only neighbours, in groups dealt into blocks of eight."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    words = sentences(9, 400).split()
    rows = [(i, " ".join(words[i * 3 : i * 3 + 150])) for i in range(80)]
    got = near_dedup.near_duplicates(documents(spark, rows), size=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in brute(rows, 4).items()}


def test_visitors_of_a_block_come_a_block_at_a_time(spark, monkeypatch):
    """Documents that share boilerplate and are not linked: no group holds much more than two blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    plain = near_dedup._across

    def bounded(percent, kind):
        links = plain(percent, kind)

        def checked(rows):
            if rows.num_rows > 32:
                raise ValueError(f"a group of {rows.num_rows} rows")
            return links(rows)

        return checked

    monkeypatch.setattr(near_dedup, "_across", bounded)
    shared_words = sentences(5, 120)
    rows = [(i, f"{shared_words} {sentences(1000 + i - i % 2, 35)}{' end' if i % 2 else ''}") for i in range(160)]
    got = near_dedup.near_duplicates(documents(spark, rows), size=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: c for i, (_, c) in brute(rows, 4).items()}


def test_awkward_rows(spark):
    got = by_id(near_dedup.near_duplicates(documents(spark, AWKWARD)))
    assert [r["n_shingles"] for r in got[1] + got[2] + got[3]] == [0, 0, 0]
    assert all(r["kept"] for i in (1, 2, 3, 4) for r in got[i])
    assert got[5][0]["component_id"] == 4 and not got[5][0]["kept"]
    assert len(got[6]) == 2 and all(r["component_id"] == 6 and r["kept"] for r in got[6])
    assert got[10][0]["component_id"] == 6
    assert len(got[None]) == 1


def test_repeated_ids_with_different_texts(spark):
    """An id tells nothing about a text: each row has the component of its own text, and no text is lost."""
    a, b = sentences(70, 60), sentences(71, 60)
    a2, b2 = a + " end", b + " end"
    for rows, want in [
        ([(1, a), (5, a), (5, b), (7, b)], {(1, a): 1, (5, a): 1, (5, b): 5, (7, b): 5}),
        ([(3, a2), (5, a), (5, b)], {(3, a2): 3, (5, a): 3, (5, b): 5}),
        ([(5, a), (5, b), (7, b2), (8, a2)], {(5, a): 5, (5, b): 5, (7, b2): 5, (8, a2): 5}),
    ]:
        docs = documents(spark, rows)
        key = {r["k"]: (r["doc_id"], r["text"]) for r in docs.select("doc_id", "text", near_dedup.text_key("text").alias("k")).collect()}
        texts = {k: t for k, (_, t) in key.items()}
        got = near_dedup.near_duplicates(docs).collect()
        assert {(r["doc_id"], texts[r["text_key"]]): r["component_id"] for r in got} == want
        stay = {(r["doc_id"], r["text"]) for r in near_dedup.one_of_each(docs).collect()}
        assert stay == {pair for pair, component in want.items() if component == pair[0]}
    nameless = documents(spark, [(None, a), (4, a), (None, b)])
    assert {(r["doc_id"], r["text"]) for r in near_dedup.one_of_each(nameless).collect()} == {(4, a), (None, b)}


def test_empty_table_and_stage(spark):
    none = documents(spark, [])
    assert near_dedup.near_duplicates(none).count() == 0
    assert near_dedup.one_of_each(none).columns == none.columns
    kept = near_dedup.one_of_each(documents(spark, AWKWARD))
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 2, 3, 4, 6, 6, 7, 8, 9]


def test_signature_estimates_similarity_and_equals_the_plain_definition():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 1 << 62, 900).astype(np.uint64)
    a, b = np.sort(items[:800]), np.sort(items[100:])
    ranks = near_dedup.super_minhash([a, b, a[:3]])
    assert abs((ranks[0] == ranks[1]).mean() - 700 / 900) < 0.1

    def plain(items, places):
        out = [2**32 - 1] * places
        for item in items.tolist():
            order = list(range(places))
            for level in range(places):
                draw = int(shared.mix(np.array([item], np.uint64) + np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))[0])
                chosen = level + (((draw & 0xFFFFFFFF) * (places - level)) >> 32)
                order[level], order[chosen] = order[chosen], order[level]
                out[order[level]] = min(out[order[level]], (level << 24) | (draw >> 40))
        return out

    assert near_dedup.super_minhash([a[:3], a[:40]])[0].tolist() == plain(a[:3], near_dedup.PLACES)
    assert near_dedup.super_minhash([a[:40]])[0].tolist() == plain(a[:40], near_dedup.PLACES)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(1000, k) for k in range(200, 260)] + [(5, 5), (None, 3), (7, 6)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in [1000, *range(200, 260)]} == {200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
