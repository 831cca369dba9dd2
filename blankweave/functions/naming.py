"""Field names: slugs, base names, suffixes and label rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blankweave import fixed_values as V
from blankweave.functions.text import first_chars, is_blank, strip


def expand_ligatures(text: Column) -> Column:
    """Spell out the few characters that stand for several letters or digits."""
    longer = {char: out for char, out in V.FOLD_LONGER.items() if any(c.isalnum() for c in out)}
    pairs = F.array(*[F.struct(F.lit(c).alias("src"), F.lit(o).alias("dst")) for c, o in longer.items()])
    return F.when(
        text.rlike("[" + "".join(longer) + "]"),
        F.aggregate(pairs, text, lambda acc, pair: F.replace(acc, pair["src"], pair["dst"])),
    ).otherwise(text)


def fold_accents(text: Column) -> Column:
    """Latin letters without their marks; everything else outside ASCII disappears."""
    return F.regexp_replace(F.translate(text, V.FOLD_FROM, V.FOLD_TO), r"[^\x00-\x7F]+", "")


def slugify(text: Column, max_words: int | None = None) -> Column:
    """Accent-free snake case of all words or the last ``max_words``, NULL when nothing is left."""
    quiet = F.regexp_replace(expand_ligatures(text), r"(?iu)\(ghi rõ.*?\)", " ")
    spaced = F.regexp_replace(quiet, r"[:\-–—\._…□]", " ")
    words = F.regexp_extract_all(F.lower(fold_accents(spaced)), F.lit(r"\w+|%"), F.lit(0))
    kept = words if max_words is None else F.reverse(F.slice(F.reverse(words), 1, max_words))
    return F.nullif(squeeze(F.array_join(kept, "_")), F.lit(""))


def squeeze(name: Column) -> Column:
    return F.regexp_replace(F.btrim(name, F.lit("_")), "_+", "_")


def base_field_name(text: Column, max_chars: int | None = None) -> Column:
    """Snake-case name that keeps accents, whole or its first ``max_chars`` characters."""
    letters = F.regexp_replace(text, r"(?U)[^\p{L}\p{N}_\s]", " ")
    joined = F.regexp_replace(strip(F.lower(letters)), r"(?U)\s+", "_")
    unsuffixed = F.regexp_replace(joined, "(?:_lưu|_ghi_chú|_note)$", "")
    return F.coalesce(F.nullif(squeeze(first_chars(unsuffixed, max_chars)), F.lit("")), F.lit("field"))


def strip_suffix(name: Column) -> Column:
    return F.regexp_replace(name, r"_\d+$", "")


def bump_suffix(name: Column, clone_index: Column) -> Column:
    """Name on the k-th (0-based) cloned row."""
    number = F.regexp_extract(name, r"_(\d+)$", 1).try_cast("bigint")
    bumped = F.coalesce(number + clone_index + 1, clone_index + 2)
    return F.concat(strip_suffix(name), F.lit("_"), bumped.cast("string"))


def quiet_label(text_before: Column) -> Column:
    """Text in front of a blank without the notes that never name it."""
    return F.regexp_replace(text_before, r"(?iu)\((?:nếu có|ghi rõ)[^)]*\)", " ")


def date_part(quiet: Column) -> Column:
    """``ngay``, ``thang`` or ``nam`` when the text ends in that word, else NULL."""
    word = F.lower(F.regexp_extract(quiet, r"(?iuU)(ngày|tháng|năm)\s*(?:20)?\s*$", 1))
    names = F.create_map(*[F.lit(part) for part in ("ngày", "ngay", "tháng", "thang", "năm", "nam")])
    return F.try_element_at(names, word)


def label_phrase(quiet: Column) -> Column:
    """The phrase before the last colon, else before the last dash, else all of it."""
    before_colon = _phrase_before_last(quiet, ":")
    before_dash = _phrase_before_last(quiet, "-")
    return (
        F.when(~is_blank(before_colon), before_colon)
        .when(~is_blank(before_dash), before_dash)
        .otherwise(quiet)
    )


def _phrase_before_last(text: Column, mark: str) -> Column:
    """Text between the last two marks (or from the start to the only one), NULL without a mark."""
    tail = F.substring_index(text, mark, -2)
    return F.when(text.contains(mark), F.substring_index(tail, mark, 1))


def kind_prefix(text_before: Column, text_after: Column) -> Column:
    """``loai_`` for a blank followed by a bracketed description of a kind of paper.

    Value words right in front of the blank (number, code, date or place of
    issue) win and keep the name.
    """
    is_value = F.coalesce(text_before.rlike(r"(?iuU)(?:số|mã|mã số|ngày cấp|nơi cấp|giá trị)\s*:\s*$"), F.lit(False))
    is_kind = F.coalesce(
        text_after.rlike(r"(?iuU)^\s*\([^)]*(?:tài liệu|giấy tờ|pháp lý|chứng từ|text|type)[^)]*\)"), F.lit(False)
    )
    return F.when(~is_value & is_kind, F.lit("loai_")).otherwise(F.lit(""))
