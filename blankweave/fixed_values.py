"""Values that decide results and therefore have to stay exactly as they are."""

from __future__ import annotations

import unicodedata

# --- fixed values: blanks -------------------------------------------------
# Stand-in character for a tab whose tab stop draws a visible leader. It lives
# in the private use area, so no real text holds it.
LEADER_MARK = "\ue000"

# Portable form for engines without possessive quantifiers.
BLANK_RE2 = r"([._…‥⋯]*[…‥⋯][._…‥⋯]*|\s*[._](?:\s*[._])+\s*|[□■]+)"

# The same language for java.util.regex. The quantifiers are possessive: a
# greedy group would recurse once per dot and overflow the stack on long rows
# of dots; the look-behind tries each white space run once, and the look-ahead
# passes over most letters, and spaces in front of them, without trying an
# alternative: its characters are spelled out, so Java tests them by one table
# and not range by range. Leader marks count as white space next to dots and as
# a blank alone.
_PLAIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789,"
BLANK = (
    r"(?U)(?! ?[" + _PLAIN + r"])([._…‥⋯]*[…‥⋯][._…‥⋯]*"
    r"|(?<![\s" + LEADER_MARK + r"])[\s" + LEADER_MARK + r"]*+[._](?:[\s" + LEADER_MARK + r"]*+[._])++[\s" + LEADER_MARK + r"]*+"
    r"|[□■]+"
    r"|" + LEADER_MARK + r"+)"
)

# Tab stop leaders that make a tab a blank.
VISIBLE_LEADERS = ("dot", "middleDot", "heavy", "underscore")

# Characters that end a label in front of a blank.
LABEL_BREAKS = r"[:\-–—\._…□■\n]"
LABEL_BREAK_CHARS = (".", ":", "…", "_", "-", "–", "—", "□", "■", "\n")

# What (?U)\s matches in java.util.regex.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

CHECKBOX_CHARS = ("□", "■")
CHECKED_WORDS = ("x", "1", "true", "checked", "v")
CHECKED_BOX, UNCHECKED_BOX = "☑", "☐"

SWITCH_UPPER, SWITCH_CAPS, SWITCH_KEEP = "\\* Upper", "\\* Caps", "\\* MERGEFORMAT"

# Neighbours that ask for a space before / after a merged value.
PAD_AFTER = r"[\p{L}.,:;>)\]}]$"
PAD_BEFORE = r"^[\p{L}<(\[{]"

# --- fixed values: headings and dates --------------------------------------
HEADING_WORDS = "điều|dieu|chương|chuong|mục|muc|phần|phan"
HEADING_NUMBER = "[0-9IVXLCDM]+"
DATE_LINE = (
    r"«([^»]+)»\s*,\s*ngày\s*«([^»]+)»\s*tháng\s*«([^»]+)»\s*năm\s*«([^»]+)»"
)
DATE_LINE_TARGETS = ("dia_diem_lam_don", "ngay_lam_don", "thang_lam_don", "nam_lam_don")

# --- fixed values: sentences of the reply after a fill message ----------------
MORE_FIELDS = (" và ", " field khác")
CORRECTED = "Đã sửa "
ASK_MORE = "Anh/chị vui lòng cung cấp thêm: "
NOTED = "Đã ghi nhận thông tin mới. "
NOTHING_FOUND = "Chưa tìm thấy thông tin phù hợp. Anh/chị vui lòng cung cấp: "
NOW_COMPLETE = ". Thông tin hiện đã đủ để tạo tài liệu."
COMPLETE_AFTER_UPDATE = "Đã đủ thông tin để tạo tài liệu. Anh/chị có thể kiểm tra lại các giá trị và thực hiện merge."
COMPLETE_BEFORE = "Các thông tin bắt buộc hiện đã đủ. Anh/chị có thể thực hiện merge."

# --- fixed values: attribute keys and edit kinds ----------------------------
SNAKE_KEYS = {
    "fontSize": "font_size",
    "fontName": "font_name",
    "allCaps": "all_caps",
    "lineSpacing": "line_spacing",
    "spaceBefore": "space_before",
    "spaceAfter": "space_after",
    "firstLineIndent": "first_line_indent",
    "alignment": "alignment",
}

ALIGNMENTS = ("left", "center", "right", "justify", "both")
URL_PREFIXES = ("http://", "https://", "mailto:")

EDIT_TYPES = (
    "rename_placeholder",
    "delete_placeholder",
    "add_placeholder",
    "add_placeholder_by_offset",
    "update_text",
    "delete_text_range",
    "format_text",
    "format_paragraph",
    "add_paragraph",
    "delete_paragraph",
    "delete_multiple_paragraphs",
    "add_page_break",
    "add_table_row",
    "delete_table_row",
    "add_table_column",
    "delete_table_column",
    "format_table_cell",
    "add_table_at_cursor",
    "add_image_at_cursor",
    "add_hyperlink",
)


# --- derived tables ---------------------------------------------------------
def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Latin letters -> their ASCII skeleton, from the Unicode decompositions.

    Single characters go to a ``translate`` pair; characters that fold to more
    than one letter (ligatures, fractions) go to a small replacement table.
    """
    blocks = [(0x00A0, 0x0250), (0x1E00, 0x1F00), (0x2000, 0x2190), (0xFB00, 0xFB07), (0xFF01, 0xFF5F)]
    source, target, longer = ["đ", "Đ"], ["d", "D"], {}
    for low, high in blocks:
        for code in range(low, high):
            char = chr(code)
            folded = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
            if len(folded) == 1:
                source.append(char)
                target.append(folded)
            elif len(folded) > 1:
                longer[char] = folded
    return "".join(source), "".join(target), longer


FOLD_FROM, FOLD_TO, FOLD_LONGER = _fold_tables()
