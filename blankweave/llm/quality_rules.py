"""Quality rules whose cutoffs are controlled for risk.

Every metric is a ratio where more is worse. On labelled documents the number of
good ones that a cutoff would reject is binomial; a cutoff may be used in a stratum
only if the exact (Clopper-Pearson) upper bound of its false rejection rate stays
within that metric's share of ``risk``. The error probability ``delta`` is divided
by strata and metrics (Bonferroni); along the cutoffs of one metric, from lax to
strict, testing ends at the first failure (fixed sequence), which needs no further
division. So with probability 1 - delta no stratum loses more than ``risk`` of its
good documents to all cutoffs together. Among the cutoffs allowed, the one with the
best balance of bad documents caught and good ones lost is taken, the laxer on ties.

Defined results: null or empty text has no words and fails the base rule; a null
stratum counts as the stratum ''; a stratum without enough labels has no cutoffs and
rejects by the base rule alone; repeated documents are judged row by row; a document
labelled twice counts once, as good only if all its labels say so; an empty table
gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

RISK, DELTA, STEPS = 0.05, 0.05, 50
LOSS_WEIGHT = 20.0
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_same_as_last")
#: metric: what it counts, out of what
METRICS = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeat_words": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "same_as_last": ("n_same_as_last", "n_words"),
}
_PREFIX = "_rule_"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def covered_words(windows: np.ndarray, size: int) -> int:
    """Words that lie in a window found twice or more."""
    order = np.sort(windows)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    hit = np.isin(windows, again)
    depth = np.zeros(len(windows) + size, np.int64)
    np.add.at(depth, np.flatnonzero(hit), 1)
    np.add.at(depth, np.flatnonzero(hit) + size, -1)
    return int((np.cumsum(depth) > 0).sum())


def text_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text of a slice."""
    data, offsets = shared.text_bytes(column)
    starts, ends, first = shared.word_bounds(data, offsets)
    n = len(offsets) - 1

    def per_text(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    words = shared.span_hashes(data, starts, ends)
    windows = shared.window_hashes(words, WINDOW)
    same = np.zeros(len(words) + 1, np.int64)
    if len(words):
        same[2:] = np.cumsum(words[1:] == words[:-1])
    out = {k: np.zeros(n, np.int64) for k in COUNTS}
    out["n_words"] = np.diff(first)
    out["word_chars"] = per_text(~shared.SPACE[data] & ((data & 0xC0) != 0x80))
    out["n_symbols"] = per_text(_SYMBOL[data])
    out["n_upper"] = per_text((data >= ord("A")) & (data <= ord("Z")))
    feeds = np.flatnonzero(data == 0x0A)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a > 1:
            out["n_same_as_last"][i] = same[b] - same[a + 1]
        if b - a > WINDOW:
            out["n_repeat_words"][i] = covered_words(windows[a : b - WINDOW + 1], WINDOW)
        if b > a:
            lo, hi = np.searchsorted(feeds, offsets[i : i + 2])
            if lo == hi:
                out["n_lines"][i] = 1
                continue
            text = data[offsets[i] : offsets[i + 1]].tobytes()
            lines = [x for x in text.split(b"\n") if x and not x.isspace()]
            out["n_lines"][i] = len(lines)
            out["n_dup_lines"][i] = len(lines) - len(set(lines))
    return out


def with_counts(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` of every document and its counts, named with a prefix that texts' columns don't have."""
    source = docs.select(*[F.col(c) for c in keep], shared.text_or_empty(text).alias(f"{_PREFIX}text"))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(_PREFIX + c, T.LongType()) for c in COUNTS])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in shared.slices(batches, f"{_PREFIX}text"):
            found = text_counts(part.column(f"{_PREFIX}text"))
            columns = [part.column(c) for c in keep] + [pa.array(found[c]) for c in COUNTS]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *(_PREFIX + c for c in COUNTS)])

    return source.mapInArrow(count, schema)


def base_failed() -> Column:
    n, repeated = F.col(f"{_PREFIX}n_words"), F.col(f"{_PREFIX}n_repeat_words")
    return (n < 20) | (100 * repeated > 30 * n)


def _ratio(metric: str) -> Column:
    part, whole = (F.col(_PREFIX + c) for c in METRICS[metric])
    return part / F.greatest(whole, F.lit(1))


def _stratum(name: str | None) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name else F.lit("")


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial of n and p."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def choose_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, delta: float) -> float | None:
    """The cutoff of one metric in one stratum, from counts by step; step i holds ratios in ((i-1)/STEPS, i/STEPS].

    None: no cutoff is proved to keep the false rejection rate within ``risk``.
    """
    n, n_bad = int(good.sum()), max(1, int(bad.sum()))
    best, gain = None, 0.0
    for step in range(STEPS - 1, -1, -1):
        lost, caught = int(good[step + 1 :].sum()), int(bad[step + 1 :].sum())
        if not n or binomial_at_most(lost, n, risk) > delta:
            break
        if (worth := caught / n_bad - LOSS_WEIGHT * lost / n) > gain:
            best, gain = step / STEPS, worth
    return best


def cutoffs(counted: DataFrame, labels: DataFrame, stratum: str | None, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(_rule_stratum, one cutoff per metric) from labelled documents; ``counted`` has doc_id and the counts."""
    marks = labels.groupBy("doc_id").agg(F.min("quality").alias("_rule_good"))
    steps = F.array(*[F.struct(F.lit(m).alias("metric"), F.least(F.ceil(_ratio(m) * STEPS), F.lit(STEPS)).cast("int").alias("step")) for m in METRICS])
    seen = (
        counted.where(~base_failed()).join(marks, "doc_id").where(F.col("_rule_good").isNotNull())
        .select(_stratum(stratum).alias("_rule_stratum"), "_rule_good", F.explode(steps).alias("at"))
        .groupBy("_rule_stratum", "at.metric", "at.step")
        .agg(F.sum((F.col("_rule_good") == 1).cast("long")).alias("good"), F.sum((F.col("_rule_good") != 1).cast("long")).alias("bad"))
    )
    seen = shared.cut(seen, "rule-histogram")
    tests = max(1, seen.agg(F.countDistinct("_rule_stratum")).first()[0]) * len(METRICS)
    share, error, names = risk / len(METRICS), delta / tests, list(METRICS)

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        row: dict = {"_rule_stratum": part["_rule_stratum"].iloc[0]}
        for m in names:
            good, bad = np.zeros(STEPS + 1, np.int64), np.zeros(STEPS + 1, np.int64)
            own = part[part["metric"] == m]
            np.add.at(good, own["step"].to_numpy(), own["good"].to_numpy())
            np.add.at(bad, own["step"].to_numpy(), own["bad"].to_numpy())
            row[f"{_PREFIX}cut_{m}"] = choose_cutoff(good, bad, share, error)
        return pd.DataFrame([row]).astype({f"{_PREFIX}cut_{m}": "float64" for m in names})

    schema = shared.fields(("_rule_stratum", T.StringType()), *((f"{_PREFIX}cut_{m}", T.DoubleType()) for m in names))
    return shared.cut(seen.groupBy("_rule_stratum").applyInPandas(choose, schema), "rule-cutoffs")


def judge(docs: DataFrame, labels: DataFrame, keep: list[str], stratum: str | None = "lang", text: str = "text", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``keep`` of every document, its counts (prefixed), ``_rule_base_failed`` and ``_rule_kept``."""
    wanted = list(dict.fromkeys([*keep, *([stratum] if stratum else [])]))
    limits = cutoffs(with_counts(docs, list(dict.fromkeys(["doc_id", *([stratum] if stratum else [])])), text), labels, stratum, risk, delta)
    rows = with_counts(docs, wanted, text).withColumn("_rule_stratum", _stratum(stratum)).join(limits, "_rule_stratum", "left")
    over = F.lit(False)
    for m in METRICS:
        limit = F.col(f"{_PREFIX}cut_{m}")
        over = over | (limit.isNotNull() & (_ratio(m) > limit))
    return rows.withColumn(f"{_PREFIX}base_failed", base_failed()).withColumn(f"{_PREFIX}kept", ~base_failed() & ~over)


def filter_documents(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang") -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return judge(docs, labels, docs.columns, stratum).where(f"{_PREFIX}kept").select(*docs.columns)


def report(docs: DataFrame, labels: DataFrame, stratum: str | None = "lang") -> DataFrame:
    """doc_id, the counts and both verdicts of every document."""
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judge(docs, labels, ["doc_id"], stratum).select(
        "doc_id", *[F.col(_PREFIX + c).alias(c) for c in shown],
        F.col(f"{_PREFIX}base_failed").alias("base_failed"), F.col(f"{_PREFIX}kept").alias("kept"),
    )
