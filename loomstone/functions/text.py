"""Text functions as column expressions; all stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that define what counts as markup for formulas.
LATEX = (
    r"(\\begin\{(?:equation|align|gather|multline|matrix|bmatrix|pmatrix)\}"
    r"|\\[a-zA-Z]+(?:\[[^\]]+\])?(?:\{[^}]+\})?|\\\(|\\\)|\\\[|\\\]|\$\$)"
)
MATH = "[∑∫√∞≈≠≤≥±×÷∂∇∈∉∩∪⊂⊆⊕⊗≃≅∀∃]"
#: White space as Unicode counts it, for a class of Java's expressions or DuckDB's.
SPACE = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: Lines that are document codes, and the label of a title.
CODES = (r"^P\d+_TA\(\d{4}\)\d{4}$", r"^\d{4}/\d+$", r"^PE.*\d")
TITLE_LABEL = r"(?m)^Τίτλος:[ \t]*(.+)$"
#: Labels of lines that are no titles.
NO_TITLES = (
    "ΚΕΙΜΕΝΑ ΠΟΥ ΕΓΚΡΙΘΗΚΑΝ", "Επιτροπή:", "Αναφορά Διαδικασίας:", "Τύπος Διαδικασίας:", "Ημερομηνία:", "Αναφορά Εγγράφου:", "Εσωτερική Επιτροπή:", "Τύπος Τίτλου:", "Υπεύθυνη Επιτροπή:",
)


def spelled(pattern: str) -> str:
    """The expression with white space (``\\s``) and its opposite (``\\S``, outside of classes) as Unicode has them, since neither
    Java nor DuckDB means more than ASCII by them."""
    out, inside, at = [], False, 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern):
            two = pattern[at : at + 2]
            out.append({"\\s": SPACE if inside else f"[{SPACE}]", "\\S": two if inside else f"[^{SPACE}]"}.get(two, two))
            at += 2
            continue
        inside = c == "[" or (inside and c != "]")
        out.append(c)
        at += 1
    return "".join(out)


def sub(c: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(c, spelled(pattern), to)


WORD = r"[\p{L}\p{M}\p{N}]+"
TOKEN = spelled(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]")
#: Addresses that say there is none, and keys that never leave the source.
PLACEHOLDER_URLS = ("na", "n/a", "none", "null", "nan", "-", "_")
FORBIDDEN_KEYS = ("filename", "filepath", "file_path", "original_filepath", "md_filename", "md_path", "source_doc_id", "source_jsonl", "row_id", "id")


def clean_text(c: Column) -> Column:
    """Null is empty; NUL characters and outer white space go."""
    return sub(F.translate(F.coalesce(c, F.lit("")), "\x00", ""), r"^\s+|\s+$", "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(sub(c, r"^\s+|\s+$", ""), F.lit(""))


def normalize_whitespace(c: Column) -> Column:
    """Runs of white space become one space, none before ``, . ; :``; a blank is null."""
    one = sub(sub(c, r"\s+", " "), r"^ +| +$", "")
    return F.nullif(sub(one, r" +([,.;:])", "$1"), F.lit(""))


def normalize_title(parts: Column) -> Column:
    """Non-blank parts of a title array, joined by `` - ``."""
    return normalize_whitespace(F.array_join(F.filter(parts, lambda p: normalize_whitespace(p).isNotNull()), " - "))


def normalize_author(parts: Column) -> Column:
    return F.nullif(F.array_join(F.filter(F.transform(parts, normalize_whitespace), lambda p: p.isNotNull()), "; "), F.lit(""))


def placeholder_url(c: Column) -> Column:
    """An address that only says there is none becomes null."""
    value = blank_to_null(c)
    return F.when(~F.lower(value).isin(*PLACEHOLDER_URLS), value)


def metadata_json(json_text: Column, forbidden: tuple[str, ...] = FORBIDDEN_KEYS) -> Column:
    """Flat JSON object with cleaned values, keys in order, forbidden keys and blanks left out; null where nothing is left."""
    values = F.from_json(json_text, "map<string,string>")
    kept = F.map_filter(F.transform_values(values, lambda _, v: blank_to_null(v)), lambda k, v: v.isNotNull() & ~k.isin(*forbidden))
    entries = F.array_sort(F.map_entries(kept))
    return F.when(F.size(entries) > 0, F.to_json(F.map_from_entries(entries)))


def contains_latex(c: Column) -> Column:
    return c.rlike(LATEX)


def contains_math(c: Column, hint: Column | None = None, formulas: Column | None = None) -> Column:
    found = contains_latex(c) | c.rlike(MATH)
    if hint is not None:
        found = F.coalesce(hint, F.lit(False)) | found
    if formulas is not None:
        found = (F.coalesce(formulas, F.lit(0)) != 0) | found
    return found


def historical(source: Column, sources: tuple[str, ...], polytonic: Column, author_year: Column) -> Column:
    """By source, by a polytonic ratio of at least 0.02, or by an author's year before 1900."""
    ratio, year = F.expr("0"), author_year
    ratio = polytonic.try_cast("double")
    return F.coalesce(source.isin(*sources), F.lit(False)) | F.coalesce(ratio >= 0.02, F.lit(False)) | F.coalesce(year.try_cast("double").cast("int") < 1900, F.lit(False))


def share_percentage(existing: Column, other: Column) -> Column:
    """The value that is there, else what the other script leaves of 100."""
    return F.coalesce(existing.try_cast("double"), F.greatest(F.lit(0.0), 100.0 - other.try_cast("double")))


def first_meaningful_line(c: Column, skip: tuple[str, ...] = ()) -> Column:
    """First line that isn't blank after markup at its ends is stripped, nor in the skip list, nor a document code."""
    lines = F.transform(F.split(c, "\n"), lambda x: normalize_whitespace(sub(x, r"^[#*| \-\t]+|[#*| \-\t]+$", "")))
    good = F.filter(lines, lambda x: x.isNotNull() & ~x.isin(*skip, "") & ~reduce(lambda a, b: a | b, (x.rlike(p) for p in CODES)))
    return F.get(good, F.lit(0))


def word_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def token_estimate(c: Column) -> Column:
    """Words and single marks."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(TOKEN)).cast("long")


def token_estimate_fast(c: Column) -> Column:
    return F.ceil(F.length(F.coalesce(c, F.lit(""))) / 4).cast("long")


def text_metrics(c: Column) -> dict[str, Column]:
    text = F.coalesce(c, F.lit(""))
    return {
        "chars": F.length(text).cast("long"),
        "non_ws_chars": F.length(sub(text, r"\s+", "")).cast("long"),
        "bytes": F.octet_length(text).cast("long"),
        "words": F.regexp_count(text, F.lit(spelled(r"\S+"))).cast("long"),
    }


def char_mass(chars: Column, text: Column) -> Column:
    return F.greatest(F.coalesce(chars.cast("long"), F.length(text).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long"))


def strict_ascii(c: Column) -> Column:
    """Strict form without Unicode composition: line ends, zero-width characters, white space."""
    text = F.translate(sub(c, "\r\n?", "\n"), "​‌‍⁠﻿", "")
    return sub(sub(text, r"\s+", " "), "^ | $", "")


def relaxed_sql(c: Column) -> Column:
    """Relaxed form in the JVM: lower case, marks and separators to single spaces."""
    text = F.translate(F.lower(c), "­", "")
    return sub(sub(sub(text, r"[\p{P}\p{Z}]+", " "), r"\s+", " "), "^ | $", "")


def badness(c: Column) -> Column:
    """Percentage of characters that are no letters, digits or white space; null for an empty text."""
    odd = F.length(sub(c, r"[\p{L}\p{N}\s]+", ""))
    return F.when(F.length(c) > 0, F.round(100.0 * odd / F.length(c), 4))


def host(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, "^[a-zA-Z]+://([^/?#]+)", 1), F.lit(""))


def hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def excerpt(c: Column, size: int) -> Column:
    return F.substring(sub(sub(c, r"\s+", " "), "^ | $", ""), 1, size)


def size_hint(chars: Column) -> Column:
    return F.when(chars < 200, "tiny").when(chars < 1000, "short").when(chars < 5000, "medium").otherwise("long")


def without_comments(c: Column) -> Column:
    """Text without ``<!-- ... -->``; what opens and never closes stays. In proportion to the text, whatever it holds."""
    parts = F.split(c, "-->", -1)

    def kept(part: Column, i: Column) -> Column:
        closed = i < F.size(parts) - 1
        return F.when(closed & part.contains("<!--"), F.substring_index(part, "<!--", 1)).when(closed, F.concat(part, F.lit("-->"))).otherwise(part)

    return F.when(c.contains("<!--"), F.array_join(F.transform(parts, kept), "")).otherwise(c)


def low_information(c: Column) -> Column:
    """Why a text says nothing: missing, empty, image_only, comment_only, symbol_only; null if it says something."""
    text = sub(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    no_comments = without_comments(text)
    no_images = sub(no_comments, r"!\[[^\[\]]*\]\([^()]*\)", "")
    blank = lambda x: sub(x, r"\s+", "") == ""
    return (
        F.when(c.isNull(), "missing").when(text == "", "empty").when(blank(no_comments), "comment_only").when(blank(no_images), "image_only")
        .when(~no_images.rlike(r"[\p{L}\p{N}]"), "symbol_only")
    )


def text_shape(c: Column) -> dict[str, Column]:
    """Counts and shares of a text's lines after comments, and of its tables, headers, digits and words."""
    text = without_comments(F.coalesce(c, F.lit("")))
    lines = F.filter(F.split(text, "\n"), lambda x: sub(x, r"\s+", "") != "")
    n = F.size(lines)
    tables = F.size(F.filter(lines, lambda x: x.contains("|")))
    return {
        "line_count": n.cast("long"),
        "table_lines": tables.cast("long"),
        "header_lines": F.size(F.filter(lines, lambda x: x.rlike(spelled(r"^#{1,6}\s")))).cast("long"),
        "short_lines": F.size(F.filter(lines, lambda x: F.length(x) < 20)).cast("long"),
        "digit_chars": F.length(sub(text, r"[^\p{N}]", "")).cast("long"),
        "upper_chars": F.length(sub(text, r"[^\p{Lu}]", "")).cast("long"),
        "word_count": F.regexp_count(text, F.lit(spelled(r"\S+"))).cast("long"),
        "table_share": F.when(n > 0, F.round(tables / n, 6)).otherwise(0.0),
    }


def line_context(line: Column, fences_before: Column) -> Column:
    """What kind of place a line is, given the count of code fences before it."""
    trimmed = sub(line, r"^\s+|\s+$", "")
    return (
        F.when(trimmed.startswith("```"), "fence").when(fences_before % 2 == 1, "code").when(trimmed == "", "blank").when(trimmed.contains("|"), "table")
        .when(trimmed.rlike(spelled(r"^#{1,6}\s")), "header").when(trimmed.rlike(spelled(r"^[-*+]\s")), "list").when(trimmed.rlike(spelled(r"^\d+[.)]\s")), "numbered").otherwise("prose")
    )


def lines_of(c: Column, most: int) -> Column:
    """The first lines, with white space made one; without blank ones."""
    lines = F.slice(F.split(F.coalesce(c, F.lit("")), "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), 1, most)
    return F.filter(F.transform(lines, normalize_whitespace), lambda x: x.isNotNull())


def adopted_text_code(c: Column) -> Column:
    """The code of an adopted text that stands in the first 2,500 characters, as addresses write it; null if there is none."""
    head = F.substring(c, 1, 2500)
    term, year, number = (F.regexp_extract(head, r"P(\d+)_TA\((\d{4})\)(\d{4})", k) for k in (1, 2, 3))
    return F.when(term != "", F.concat(F.lit("TA-"), term, F.lit("-"), year, F.lit("-"), number))


def adopted_text_title(c: Column) -> Column:
    """The labelled title, else the first of 30 lines of 16 characters and more that is neither another label's nor a code."""
    labelled = normalize_whitespace(F.regexp_extract(F.coalesce(c, F.lit("")), TITLE_LABEL, 1))
    other = lambda x: reduce(lambda a, b: a | b, (x.startswith(p) for p in NO_TITLES))
    good = F.filter(lines_of(c, 30), lambda x: ~other(x) & ~x.rlike(CODES[0]) & ~x.rlike(CODES[2]) & (F.length(x) >= 16))
    return F.coalesce(labelled, F.get(good, F.lit(0)))


def act_title(c: Column) -> Column:
    """Of the first four lines (of 20) outside tables the first with a lower-case letter; else the third and fourth, else the first."""
    lines = F.slice(F.filter(lines_of(c, 20), lambda x: ~x.startswith("|") & (x != "---")), 1, 4)
    mixed = F.filter(lines, lambda x: x.rlike(r"\p{Ll}"))
    return F.when(F.size(mixed) > 0, F.get(mixed, F.lit(0))).when(F.size(lines) >= 3, F.array_join(F.slice(lines, 3, 2), " ")).otherwise(F.get(lines, F.lit(0)))


def record_title(json_text: Column, citation: str, title: str) -> Column:
    """The second part of a citation list of a JSON record, else its title."""
    second = F.get(F.from_json(F.get_json_object(json_text, f"$['{citation}']"), "array<string>"), F.lit(1))
    return F.coalesce(normalize_whitespace(second), normalize_whitespace(F.get_json_object(json_text, f"$['{title}']")))


def record_author(json_text: Column, authors: str) -> Column:
    """Authors of a JSON record, a list or one text, joined."""
    raw = F.get_json_object(json_text, f"$['{authors}']")
    return F.when(raw.startswith("["), normalize_author(F.from_json(raw, "array<string>"))).otherwise(normalize_whitespace(raw))


def dedup_token(c: Column) -> Column:
    """Lower-cased text with white space made one; a blank is null."""
    return F.lower(normalize_whitespace(c))


def html_lang(values: Column) -> Column:
    """Non-blank languages of a list, joined by ``|``; null if there are none."""
    return F.nullif(F.array_join(F.filter(values, lambda x: x.isNotNull() & (x != "")), "|"), F.lit(""))


def quality_bin(name: Column) -> Column:
    """The number before the first underscore of a shard's name."""
    return F.substring_index(name, "_", 1).try_cast("int")


def noise_row(row: Column) -> dict[str, Column]:
    """Fields of a noise score row: path, badness, latin percentage, table ratio, polytonic ratio, Greek letters. Shorter rows give nulls."""
    kinds = {"md_path": "string", "greek_badness_score": "double", "latin_percentage": "double", "table_ratio": "double", "polytonic_ratio": "double", "len_greek": "long"}
    return {name: F.get(row, F.lit(k)).try_cast(kind) for k, (name, kind) in enumerate(kinds.items())}


def cleaner_statistics(before: Column, after: Column) -> dict[str, Column]:
    """What cleaning took from a text: characters, lines, and kinds of lines before and after. Own definitions."""
    old, new = F.coalesce(before, F.lit("")), F.coalesce(after, F.lit(""))
    count = lambda c, p: F.regexp_count(c, F.lit(spelled(p))).cast("long")
    chars = [F.length(x).cast("long") for x in (old, new)]
    out = {"chars_before": chars[0], "chars_after": chars[1], "chars_removed": chars[0] - chars[1], "removed_share": F.when(chars[0] > 0, F.round((chars[0] - chars[1]) / chars[0], 6)).otherwise(0.0)}
    for name, pattern in (("lines", r"[^\n]+"), ("digits", r"\p{N}"), ("marks", r"\p{P}"), ("spaces", r"\s"), ("upper", r"\p{Lu}"), ("words", r"\S+"), ("tables", r"(?m)^[^\n]*\|")):
        out |= {f"{name}_before": count(old, pattern), f"{name}_after": count(new, pattern)}
    return out
