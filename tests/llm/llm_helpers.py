"""Small tables for the tests of this folder."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, n long, key long, bucket string, part string, chunk long, bands string, rep long, place string"


def sentences(seed: int, words: int, letters: str = "abcdefgh") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(words))


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", len(text) if text is not None else None, 1, 2, "b", "p", 3, "x", 4, "y")


def documents(spark, rows):
    """``rows``: (doc_id, text[, lang]); every other column clashes with a name the operators might use."""
    return spark.createDataFrame([row(*r) for r in rows], DOCUMENTS)


AWKWARD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, sentences(1, 60)), (6, sentences(1, 60)),
    (7, sentences(2, 30000)), (8, "x" * 100_000), (9, "é 🙂 ß Å\n\nline\nline\n"), (None, "lost id"), (10, sentences(1, 60) + " end"),
]


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out
