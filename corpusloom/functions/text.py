"""Text functions: each takes columns and gives a column, evaluated in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.chars import NOT_WORD, SPACE, WIDE_SPACE

# Limits of sections, titles, previews and virtual pages.
MIN_SECTION, MAX_TITLE, PREVIEW_WINDOW, PREVIEW_MAX, PAGE_CHARS = 30, 120, 100, 200, 2500

# Words that a query drops.
MINOR_WORDS = ["the", "a", "an", "and", "or", "in", "on", "at", "to", "for", "of", "with", "by", "is", "it", "its"]

# Entities in the order in which they are decoded.
ENTITIES = [("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&quot;", '"'), ("&#39;", "'")]

# Wrongly decoded sequences and what they stand for, in order.
MOJIBAKE = [
    ("ΓÇÿ", "'"),
    ("ΓÇÖ", '"'),
    ("ΓÇ×", '"'),
    ("ΓÇ£", "«"),
    ("ΓÇ¤", "»"),
    ("ΓÇô", "-"),
]

# Box-drawing characters that broken decoding leaves behind.
BOX_CHARS = "├┤┬┴─│┐┌└┘"

# A page marker between two rules, as it stands in a section.
SECTION_MARKER = r"={40,}\s*\r?\n\s*PDF PAGE\s+(\d+)\s*\r?\n\s*={40,}\s*(\r?\n)?"


def sub(c: Column, pattern: str, replacement: str = "") -> Column:
    return F.regexp_replace(c, pattern, replacement)


def put(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def trim_space(c: Column, space: str = SPACE) -> Column:
    """Trim Unicode white space from both ends (Spark's trim removes blanks only)."""
    return sub(c, rf"\A{space}+|{space}+\z")


def strip_html(c: Column) -> Column:
    """Text of an HTML string: scripts and styles go, tags become blanks, six entities are decoded in their order."""
    c = sub(c, r"(?is)<(script|style)[^>]*>.*?</(script|style)>")
    c = sub(c, r"<[^>]+>", " ")
    for entity, plain in ENTITIES:
        c = put(c, entity, plain)
    return trim_space(sub(sub(c, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def drop_bom(c: Column) -> Column:
    return sub(c, r"\A\x{FEFF}")


def clean_encoding(c: Column) -> Column:
    """Remove carriage returns, control characters and traces of wrong decoding; collapse blanks and blank lines.

    Escaped returns and newlines that stand in the text as letters go too. Tabs become blanks after blanks have been
    collapsed, so two tabs give two blanks.
    """
    c = put(put(put(c, "\r", ""), "\\r", ""), "\\n", " ")
    c = sub(c, r"[\p{C}&&[^\n\t]]")
    for wrong, right in MOJIBAKE:
        c = put(c, wrong, right)
    c = F.translate(c, BOX_CHARS, "")
    c = sub(sub(sub(c, r" +", " "), r"\n{3,}", "\n\n"), r"\t", " ")
    return sub(c, r"[ \p{Z}]+(\n|\z)", "$1")


def remove_page_markers(c: Column) -> Column:
    """Replace a page marker line between two rules by a newline."""
    s = WIDE_SPACE
    return sub(c, rf"\n={{40,}}{s}*\nPDF PAGE \p{{Nd}}+{s}*\n={{40,}}{s}*\n", "\n")


def strip_headers(c: Column) -> Column:
    return sub(c, rf"(?m)^#+{WIDE_SPACE}+")


def strip_bold(c: Column) -> Column:
    return sub(c, r"\*\*([^*]+)\*\*", "$1")


def strip_italic(c: Column) -> Column:
    return sub(sub(c, r"_([^_]+)_", "$1"), r"(?<!\*)\*([^*]+)\*(?!\*)", "$1")


def has_encoding_traces(c: Column) -> Column:
    """Quality flag: does cleaned text still hold a carriage return or one of the usual wrong characters?"""
    return c.contains("\r") | c.rlike("[Γ£├]")


def normalize_content(c: Column) -> Column:
    """All line breaks, also the written-out ones, become blanks; runs of blanks become one; trim."""
    for old in ("\r\n", "\r", "\n", "\\r\\n", "\\r", "\\n"):
        c = put(c, old, " ")
    return trim_space(sub(c, " +", " "))


def sanitize_title(c: Column) -> Column:
    """Drop heading marks and section numbers; cut long titles to 120 characters with an ellipsis."""
    c = trim_space(sub(c, r"\A#+\s*"))
    c = trim_space(sub(c, r"\A\d+(\.\d+)*\.?\s*"))
    return F.when(F.length(c) > MAX_TITLE, F.concat(F.substring(c, 1, MAX_TITLE - 3), F.lit("..."))).otherwise(c)


def strip_section_markers(c: Column) -> Column:
    return trim_space(sub(c, SECTION_MARKER))


def page_number_of(c: Column) -> Column:
    """Number of the first page marker inside a section, 0 without one."""
    return F.coalesce(F.nullif(F.regexp_extract(c, SECTION_MARKER, 1), F.lit("")).try_cast("int"), F.lit(0))


def is_valid_section(c: Column) -> Column:
    return F.length(trim_space(c)) >= MIN_SECTION


def sanitize_preview(c: Column) -> Column:
    return sub(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]")


def document_slug(stem: Column) -> Column:
    return F.btrim(sub(F.lower(stem), r"[^a-z0-9]+", "-"), F.lit("-"))


def query_terms(q: Column) -> Column:
    """Distinct words of a query in their order, without one-letter and minor words."""
    words = F.split(F.lower(q), NOT_WORD)
    minor = F.array(*map(F.lit, MINOR_WORDS))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(minor, w)))


_WORD_BREAK = re.compile(r"\W+")


def terms_of(query: str) -> list[str]:
    """``query_terms`` of one string, on the driver."""
    found = dict.fromkeys(_WORD_BREAK.split(query.lower()))
    return [w for w in found if len(w) > 1 and w not in MINOR_WORDS]


def count_occurrences(text: Column, term: Column) -> Column:
    """Occurrences of a substring that don't overlap."""
    n = F.length(term)
    found = F.floor((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / n)
    return F.when(n > 0, found).otherwise(0).cast("int")


def format_bytes(n: Column) -> Column:
    """A size in B, KB, MB or GB with up to two decimals."""
    order = sum((F.when(n >= 1024**k, 1).otherwise(0) for k in (1, 2, 3)), F.lit(0))
    value = F.round(n / F.pow(F.lit(1024.0), order), 2)
    digits = sub(sub(F.format_string("%.2f", value), r"0+\z"), r"\.\z")
    return F.concat(digits, F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), order + 1))


def page_status(only: Column, start: Column, end: Column) -> Column:
    """What a page range shows as in a list of documents."""
    n = F.size(only)
    first = F.array_join(F.slice(F.array_sort(only), 1, 5).cast("array<string>"), ", ")
    more = F.when(n > 5, F.concat(F.lit(", +"), (n - 5).cast("string"))).otherwise("")
    span = F.concat(F.lit("[pages "), start.cast("string"), F.lit("-"), F.coalesce(end.cast("string"), F.lit("end")), F.lit("]"))
    return (
        F.when(only.isNotNull() & (n > 0), F.concat(F.lit("[pages: "), first, more, F.lit("]")))
        .when((start > 1) | end.isNotNull(), span)
        .otherwise("")
    )


def page_selection(c: Column) -> Column:
    """Sorted distinct pages of an input like ``12, 15-19``; null where a part is no page or range, or nothing is left."""
    parts = F.filter(F.transform(F.split(c, ","), trim_space), lambda p: p != "")
    low = lambda p: F.regexp_extract(p, r"\A\s*(\d{1,9})\s*(?:-\s*(\d{1,9})\s*)?\z", 1)
    high = lambda p: F.regexp_extract(p, r"\A\s*(\d{1,9})\s*(?:-\s*(\d{1,9})\s*)?\z", 2)
    a = lambda p: low(p).try_cast("int")
    b = lambda p: F.coalesce(high(p).try_cast("int"), a(p))
    good = F.forall(parts, lambda p: F.coalesce((a(p) >= 1) & (b(p) >= a(p)), F.lit(False)))
    pages = F.flatten(F.transform(parts, lambda p: F.sequence(a(p), b(p))))
    return F.when((F.size(parts) > 0) & good, F.array_sort(F.array_distinct(pages)))


def hierarchy_path(level: Column, parent: Column, title: Column) -> Column:
    below = (title != "") & ~title.eqNullSafe(parent)
    path = F.concat(F.coalesce(parent, F.lit("Root")), F.when(below, F.concat(F.lit(" > "), title)).otherwise(""))
    return F.when(level == 0, "Document Content").otherwise(path)


def context_preview(content: Column, content_lc: Column, terms: list[Column]) -> Column:
    """Text around the first hit of any term, with dots where it is cut; the beginning where nothing hits."""
    spots = [F.nullif(F.position(t, content_lc), F.lit(0)) for t in terms]
    hit = (F.least(*spots) if len(spots) > 1 else spots[0] if spots else F.lit(None).cast("int")) - 1
    size = F.length(content)
    start, end = F.greatest(hit - PREVIEW_WINDOW, F.lit(0)), F.least(hit + PREVIEW_WINDOW, size)
    around = F.concat(
        F.when(start > 0, "...").otherwise(""),
        trim_space(F.substring(content, start + 1, F.greatest(end - start, F.lit(0)))),
        F.when(end < size, "...").otherwise(""),
    )
    plain = F.when(size > PREVIEW_MAX, F.concat(F.substring(content, 1, PREVIEW_MAX - 3), F.lit("..."))).otherwise(content)
    return sanitize_preview(F.when(hit.isNull(), plain).otherwise(around))


def is_pattern(pattern: str) -> bool:
    """Does the pattern compile as a regular expression? Otherwise it is used as a keyword."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True
