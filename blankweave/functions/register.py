"""The library's functions for SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from blankweave import fixed_values as V


def _quote(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _blank_spans() -> str:
    return f"regexp_extract_all(x, {_quote(V.BLANK)}, 0)"


def _title_py() -> str:
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    runs = f"regexp_extract_all(x, {_quote(f'[{cased}]+|[^{cased}]+')}, 0)"
    first = "upper(left(r, 1))"
    word = f"concat(left({first}, 1), lower(substring({first}, 2, 2)), lower(substring(r, 2)))"
    return f"array_join(transform({runs}, r -> {word}), '')"


def _slugify_vi() -> str:
    longer = {char: out for char, out in V.FOLD_LONGER.items() if any(c.isalnum() for c in out)}
    pairs = ", ".join(f"struct({_quote(char)} AS src, {_quote(out)} AS dst)" for char, out in longer.items())
    expanded = (
        f"CASE WHEN x RLIKE {_quote('[' + ''.join(longer) + ']')} "
        f"THEN aggregate(array({pairs}), x, (acc, p) -> replace(acc, p.src, p.dst)) ELSE x END"
    )
    quiet = f"regexp_replace({expanded}, {_quote(r'(?iu)\(ghi rõ.*?\)')}, ' ')"
    spaced = f"regexp_replace({quiet}, {_quote(r'[:\-–—\._…□]')}, ' ')"
    folded = f"regexp_replace(translate({spaced}, {_quote(V.FOLD_FROM)}, {_quote(V.FOLD_TO)}), {_quote(r'[^\x00-\x7F]+')}, '')"
    words = f"regexp_extract_all(lower({folded}), {_quote(r'\w+|%')}, 0)"
    joined = f"array_join({words}, '_')"
    return f"nullif(regexp_replace(btrim({joined}, '_'), '_+', '_'), '')"


FUNCTIONS = {
    "blank_spans": (_blank_spans, "ARRAY<STRING>"),
    "slugify_vi": (_slugify_vi, "STRING"),
    "title_py": (_title_py, "STRING"),
}


def register_functions(spark: SparkSession) -> None:
    """Temporary SQL functions; their bodies inline into the plan, no Python runs per row."""
    for name, (body, kind) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS {kind} RETURN {body()}")
