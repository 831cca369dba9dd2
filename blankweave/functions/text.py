"""Scalar text functions: Column in, Column out, no Python in the data path."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from blankweave import fixed_values as V

CASED = r"[\p{Lu}\p{Ll}\p{Lt}]"


# --- white space -------------------------------------------------------------
def first_chars(text: Column, limit: int | None) -> Column:
    """The whole text, or its first ``limit`` characters where a caller wants it short."""
    return text if limit is None else F.left(text, F.lit(limit))


def strip(text: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s++|(?<!\s)\s++$", "")


def is_blank(text: Column) -> Column:
    """True for NULL and for text without a visible character."""
    return F.coalesce(~text.rlike(r"(?U)\S"), F.lit(True))


def normalize_text(text: Column) -> Column:
    """Collapse white space (also zero-width and line separators), spell out dot leaders, trim."""
    spaced = F.regexp_replace(text, r"(?U)[\s​]+", " ")
    spelled = F.replace(F.replace(spaced, F.lit("…"), F.lit("...")), F.lit("‥"), F.lit(".."))
    return F.trim(spelled)


def normalize_without_fields(text: Column) -> Column:
    return F.trim(F.regexp_replace(normalize_text(text), "«[^»]+»", ""))


def has_content(text: Column) -> Column:
    """Anything left once white space, dots and underscores are gone."""
    return F.coalesce(text.rlike(r"(?U)[^\s._]"), F.lit(False))


def is_cell_empty(text: Column, field_count: Column | None = None) -> Column:
    """No field in the cell and not one letter or digit."""
    wordless = ~F.coalesce(text, F.lit("")).rlike(r"[\p{L}\p{N}]")
    return wordless if field_count is None else wordless & (F.coalesce(field_count, F.lit(0)) == 0)


# --- blanks ------------------------------------------------------------------
def mark_leader_tabs(text: Column, tab_leaders: Column | None) -> Column:
    """Swap each tab that draws a visible leader for the leader mark.

    The n-th tab of the text belongs to the n-th tab stop. Text without any
    visible character keeps plain tabs.
    """
    if tab_leaders is None:
        return text
    pieces = F.split(text, "\t", -1)
    joined = F.array_join(
        F.transform(
            pieces,
            lambda piece, i: F.when(i == 0, piece)
            .when(F.get(tab_leaders, i - 1).isin(*V.VISIBLE_LEADERS), F.concat(F.lit(V.LEADER_MARK), piece))
            .otherwise(F.concat(F.lit("\t"), piece)),
        ),
        "",
    )
    return F.when(is_blank(text) | ~text.contains("\t"), text).otherwise(joined)


def unmark_leader_tabs(text: Column) -> Column:
    return F.translate(text, V.LEADER_MARK, "\t")


def detect_blanks(text: Column) -> Column:
    """All blanks of a text, in order."""
    return F.regexp_extract_all(text, F.lit(V.BLANK), F.lit(0))


def has_blank(text: Column, tab_leaders: Column | None = None) -> Column:
    return mark_leader_tabs(text, tab_leaders).rlike(V.BLANK)


def strip_blanks(text: Column, tab_leaders: Column | None = None) -> Column:
    """Every blank becomes one space."""
    return F.regexp_replace(mark_leader_tabs(text, tab_leaders), V.BLANK, " ")


def is_blank_only(text: Column, tab_leaders: Column | None = None) -> Column:
    """Nothing but blanks: the mark of a continuation line."""
    marked = mark_leader_tabs(text, tab_leaders)
    return marked.rlike(V.BLANK) & is_blank(F.regexp_replace(marked, V.BLANK, " "))


def last_label(text_before: Column) -> Column:
    """Last non-empty piece between label breaks, trimmed; empty when there is none.

    Read from the end, by plain searches for the single breaks: a pattern would test each character of a long label
    against all of them.
    """
    label = F.rtrim(text_before, F.lit("".join(V.LABEL_BREAK_CHARS) + V.WHITE_SPACE))
    for char in V.LABEL_BREAK_CHARS:
        label = F.substring_index(label, char, -1)
    return F.ltrim(label, F.lit(V.WHITE_SPACE))


def switch_for(label: Column) -> Column:
    """Case switch a label asks for."""
    return (
        F.when((label == F.upper(label)) & (label != F.lower(label)), F.lit(V.SWITCH_UPPER))
        .when(is_title(label), F.lit(V.SWITCH_CAPS))
        .otherwise(F.lit(V.SWITCH_KEEP))
    )


def infer_switch(text_before: Column) -> Column:
    """Case switch for a blank, from the last label in front of it."""
    return switch_for(last_label(text_before))


def is_title(text: Column) -> Column:
    """Upper case only after uncased characters, lower case only after cased ones."""
    return (
        text.rlike(r"[\p{Lu}\p{Lt}]")
        & ~text.rlike(r"(^|[^\p{Lu}\p{Ll}\p{Lt}])\p{Ll}")
        & ~text.rlike(CASED + r"[\p{Lu}\p{Lt}]")
    )


def checkbox_prefix(blank: Column) -> Column:
    """``ck_`` for exactly one box, else nothing (a run of boxes is not a check box)."""
    return F.when(blank.isin(*V.CHECKBOX_CHARS), F.lit("ck_")).otherwise(F.lit(""))


def base_label(blank: Column) -> Column:
    return F.concat(checkbox_prefix(blank), F.lit("field"))


# --- merge field instructions --------------------------------------------------
def format_instr(name: Column, switch: Column, original: Column) -> Column:
    quoted = F.replace(original, F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit(" MERGEFIELD "), name, F.lit(" "), switch, F.lit(' \\z "'), quoted, F.lit('" '))


def instr_name(instr: Column) -> Column:
    found = F.regexp_extract(instr, r"(?U)MERGEFIELD\s+(\S+)", 1)
    return F.nullif(found, F.lit(""))


def instr_original(instr: Column) -> Column:
    return F.regexp_extract(instr, r'(?U)\\z\s*"([^"]*)"', 1)


def instr_switch(instr: Column) -> Column:
    return (
        F.when(instr.rlike(r"(?iU)\\\*\s*Upper"), F.lit(V.SWITCH_UPPER))
        .when(instr.rlike(r"(?iU)\\\*\s*Caps"), F.lit(V.SWITCH_CAPS))
        .otherwise(F.lit(V.SWITCH_KEEP))
    )


def fields_in_text(text: Column) -> Column:
    """Distinct field names shown in a text, first use first."""
    names = F.transform(F.regexp_extract_all(text, F.lit("«([^»]+)»"), F.lit(1)), strip)
    return F.array_distinct(F.filter(names, lambda name: name != ""))


def field_mark(name: Column) -> Column:
    return F.concat(F.lit("«"), name, F.lit("»"))


# --- headings ------------------------------------------------------------------
def is_heading(text: Column, style: Column | None = None) -> Column:
    by_text = F.coalesce(
        strip(text).rlike(
            rf"(?iuU)^(?:{V.HEADING_WORDS})\s+{V.HEADING_NUMBER}|(?iuU)^[IVXLCDM]+\.\s+\S"
        ),
        F.lit(False),
    )
    if style is None:
        return by_text
    styled = F.coalesce(F.lower(style).contains("heading"), F.lit(False)) & ~is_blank(text)
    return by_text | styled


def heading_number(text: Column) -> Column:
    found = F.regexp_extract(
        strip(text), rf"(?iuU)^(?:{V.HEADING_WORDS})\s+({V.HEADING_NUMBER})", 1
    )
    return F.nullif(F.lower(found), F.lit(""))


def requested_numbers(text: Column) -> Column:
    """All heading numbers a user text mentions."""
    pattern = rf"(?iuU)(?:{V.HEADING_WORDS})\s+({V.HEADING_NUMBER})"
    return F.array_distinct(
        F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1)), F.lower)
    )


# --- values --------------------------------------------------------------------
def title_py(text: Column) -> Column:
    """Capital after every uncased character, unlike ``initcap`` which looks at spaces only."""
    runs = F.regexp_extract_all(text, F.lit(CASED + r"+|[^\p{Lu}\p{Ll}\p{Lt}]+"), F.lit(0))
    return F.array_join(
        F.transform(
            runs,
            # A first letter may become two capitals; only one of them stays a capital.
            lambda run: F.concat(
                F.left(F.upper(F.left(run, F.lit(1))), F.lit(1)),
                F.lower(F.substring(F.upper(F.left(run, F.lit(1))), 2, 2)),
                F.lower(F.substring(run, 2, 2147483647)),
            ),
        ),
        "",
    )


def checkbox_value(value: Column) -> Column:
    checked = F.coalesce(strip(F.lower(value)).isin(*V.CHECKED_WORDS), F.lit(False))
    return F.when(checked, F.lit(V.CHECKED_BOX)).otherwise(F.lit(V.UNCHECKED_BOX))


def apply_switch(value: Column, switch: Column) -> Column:
    return (
        F.when(switch == V.SWITCH_UPPER, F.upper(value))
        .when(switch == V.SWITCH_CAPS, title_py(value))
        .otherwise(value)
    )


def merged_value(
    field_name: Column, switch: Column, original: Column, value: Column, is_locked: Column
) -> Column:
    """What a field shows after the merge: lock, box, value, original text, switch."""
    is_box = field_name.startswith("ck_")
    chosen = (
        F.when(is_locked, original)
        .when(is_box, checkbox_value(value))
        .otherwise(F.coalesce(value, F.lit("")))
    )
    return F.when(is_blank(chosen) & ~is_box, original).otherwise(apply_switch(chosen, switch))


def url_ok(url: Column) -> Column:
    prefixes = "|".join(V.URL_PREFIXES)
    return F.coalesce(url.rlike(rf"^(?:{prefixes})"), F.lit(False))


def usage_value(*candidates: Column) -> Column:
    """First candidate that casts to a whole number, else 0."""
    return F.coalesce(*[c.try_cast("bigint") for c in candidates], F.lit(0).cast("bigint"))


# --- JSON ----------------------------------------------------------------------
def json_object_text(raw: Column) -> Column:
    """From the first ``{`` to the last ``}``; without braces the text minus code fences."""
    stripped = strip(F.coalesce(raw, F.lit("")))
    braced = F.regexp_extract(stripped, r"(?s)\{.*\}", 0)
    unfenced = F.regexp_replace(F.regexp_replace(stripped, r"^(?:```json)?(?:```)?", ""), r"```$", "")
    return F.when(braced != "", braced).otherwise(strip(unfenced))


def extract_json(raw: Column) -> Column:
    """Model reply -> map of strings, empty when it is no JSON object."""
    parsed = F.from_json(json_object_text(raw), "MAP<STRING,STRING>")
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(parsed, empty)


def snake_keys(options: Column) -> Column:
    known = F.create_map(*[F.lit(part) for pair in V.SNAKE_KEYS.items() for part in pair])
    return F.transform_keys(options, lambda key, _: F.coalesce(F.try_element_at(known, key), key))


# --- pieces ---------------------------------------------------------------------
def split_at_offset(text: Column, offset: Column) -> Column:
    """(before, after) at a character offset; empty text forces 0, a blank tail is dropped."""
    cut = F.when(text == "", F.lit(0)).otherwise(offset).cast("int")
    after = F.substring(text, cut + 1, F.length(text))
    return F.struct(
        F.substring(text, F.lit(1), cut).alias("before"),
        F.when(~is_blank(after), after).alias("after"),
    )
