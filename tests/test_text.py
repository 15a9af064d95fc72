"""Text functions against hand-derived cases."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators.cleaning import clean, clean_documents
from corpusloom.operators.lines import join_short_lines, normalize_line_breaks
from corpusloom.sources.settings import Cleaning


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v"))).first()[0]


CASES = [
    (t.strip_html, "<p>a &amp;lt; b</p><script>x</script>", "a < b"),
    (t.clean_encoding, "a\r\t\tb\\n ├c​  \n\n\n\nd ", "a  b c\n\nd"),
    (t.clean_encoding, "ΓÇÖx ΓÇôy", '"x -y'),
    (t.remove_page_markers, "a\n" + "=" * 80 + "\nPDF PAGE 3\n" + "=" * 80 + "\nb", "a\nb"),
    (t.strip_headers, "# A\n## B\nC #", "A\nB\nC #"),
    (t.strip_bold, "**a** b **c", "a b **c"),
    (t.strip_italic, "a_b_c", "abc"),
    (t.strip_italic, "*x* **y**", "x **y**"),
    (t.normalize_content, " a\r\nb\\n  c ", "a b c"),
    (t.sanitize_title, "## 1.2. Intro", "Intro"),
    (t.sanitize_title, "x" * 121, "x" * 117 + "..."),
    (t.document_slug, "My Doc (v2)", "my-doc-v2"),
    (t.document_slug, "日本", ""),
    (t.sanitize_preview, "a\x00b\tc", "ab\tc"),
    (t.drop_bom, "﻿a", "a"),
    (normalize_line_breaks, "a.\n\nb", "a.\nb"),
    (normalize_line_breaks, "one\ntwo.\nthree", "one two.\nthree"),
    (join_short_lines, "a\nb\nc", "a b\nc"),
]


@pytest.mark.parametrize(("function", "value", "expected"), CASES)
def test_string_functions(spark, function, value, expected):
    assert one(spark, value, function) == expected
    assert one(spark, None, function) is None


def test_query_terms(spark):
    q = "The State of the Art, and Café-2!"
    assert one(spark, q, t.query_terms) == ["state", "art", "café"] == t.terms_of(q)


def test_counts_and_pages(spark):
    assert one(spark, "aaaa", lambda c: t.count_occurrences(c, F.lit("aa"))) == 2
    assert one(spark, "aaaa", lambda c: t.count_occurrences(c, F.lit(""))) == 0
    for text, pages in [("12, 15-17, 12", [12, 15, 16, 17]), ("5-3", None), ("0", None), ("", None), ("1, x", None), (" 2 - 3 ,", [2, 3])]:
        assert one(spark, text, t.page_selection) == pages
    assert [one(spark, n, t.format_bytes, "long") for n in (500, 1024, 1536, 5 << 30)] == ["500 B", "1 KB", "1.5 KB", "5 GB"]
    marker = "x\n" + "=" * 40 + "\nPDF PAGE 7\n" + "=" * 40 + "\ny"
    assert one(spark, marker, t.page_number_of) == 7 and one(spark, "x", t.page_number_of) == 0


def test_page_status(spark):
    rows = [([9, 1, 2, 3, 4, 5, 6], 1, None), (None, 3, None), (None, 1, None), (None, 2, 4)]
    df = spark.createDataFrame(rows, "o array<int>, s int, e int").select(t.page_status(F.col("o"), F.col("s"), F.col("e")))
    assert [r[0] for r in df.collect()] == ["[pages: 1, 2, 3, 4, 5, +2]", "[pages 3-end]", "", "[pages 2-4]"]


def test_hierarchy_and_preview(spark):
    rows = [(0, None, "x"), (1, None, "A"), (2, "A", "B"), (2, "A", "A")]
    df = spark.createDataFrame(rows, "l int, p string, t string").select(t.hierarchy_path(F.col("l"), F.col("p"), F.col("t")))
    assert [r[0] for r in df.collect()] == ["Document Content", "Root > A", "A > B", "A"]
    preview = lambda c: t.context_preview(c, F.lower(c), [F.lit("needle")])
    assert one(spark, "a" * 201, preview) == "a" * 197 + "..."
    assert one(spark, "a" * 150 + "Needle" + "b" * 150, preview) == "..." + "a" * 100 + "Needle" + "b" * 94 + "..."


def folded_sentences(text):
    out = []
    for line in map(str.rstrip, text.split("\n")):
        closed = not out or (out[-1] and (out[-1][-1] in ".!?;—–…" or out[-1][0] == "#" or re.search(r"\d+\.\d+\s*$", out[-1])))
        if closed or not line:
            out.append(line)
        else:
            out[-1] = f"{out[-1]} {line}".strip()
    return "\n".join(out)


def paired_lines(text):
    left, out = text.split("\n")[::-1], []
    while left:
        line, then = left.pop().rstrip(), left[-1].lstrip() if left else ""
        if line and len(line) < 80 and then and not re.match(r"[#\d]|PDF PAGE", then):
            line = f"{line} {left.pop().lstrip()}".strip()
        out.append(line)
    return "\n".join(out)


def test_line_joins(spark):
    text = "# Head\nfoo bar\nbaz 1.2\nnext\n\n  indented\nmore; \nend—\nx\n\n\ny" + "\nword" * 5
    assert one(spark, text, normalize_line_breaks) == "# Head\nfoo bar baz 1.2\nnext\nindented more;\nend—\nx\n\ny" + " word" * 5
    assert one(spark, "a\n\nb\n1c\n# d\nPDF PAGE 1\ne", join_short_lines) == "a\n\nb\n1c\n# d\nPDF PAGE 1 e"


def test_line_joins_against_plain_loops(spark):
    pick = random.Random(7)
    parts = ["foo", "bar", " ", "\t", "#", "# h", "1.2", "3.", "end.", "end—", "\n", "\n", "\n", "\n\n", "\r", "\xa0", "\x1c", "😀", "PDF PAGE", "w" * 40, "9", "٣.٤"]
    texts = ["".join(pick.choices(parts, k=pick.randrange(25))) for _ in range(4000)]
    texts += ["word 😀\n" * 300, " " * 20_000, "1.1." * 5000 + "\nx", "😀a" * 5000 + "\nb", None]
    df = spark.createDataFrame([(x,) for x in texts], "v string")
    for row in df.select("v", normalize_line_breaks("v").alias("a"), join_short_lines("v").alias("b")).collect():
        assert row.a == (None if row.v is None else folded_sentences(row.v)), row.v[:200]
        assert row.b == (None if row.v is None else paired_lines(row.v)), row.v[:200]


def test_line_joins_of_a_long_text(spark):
    assert one(spark, "\n".join(["word 😀"] * 100_000), normalize_line_breaks) == " ".join(["word 😀"] * 100_000)
    assert one(spark, "\n".join(["word 😀"] * 100_000), join_short_lines) == "\n".join(["word 😀 word 😀"] * 50_000)


def test_cleaning_by_document(spark):
    docs = spark.createDataFrame([("a", "**x** _y_"), ("b", "**x** _y_")], "stem string, text string")
    own = spark.createDataFrame([("b", (True, False, True, False, False, False, False, False))], "stem string, cleaning struct<clean_encoding:boolean,preserve_markdown:boolean,strip_bold:boolean,strip_italic:boolean,strip_headers:boolean,remove_page_markers:boolean,normalize_line_breaks:boolean,join_short_lines:boolean>")
    found = {r["stem"]: r["text"] for r in clean_documents(docs, Cleaning(), own).collect()}
    assert found == {"a": "**x** _y_", "b": "x _y_"}
    assert one(spark, "**x**", lambda c: clean(c, Cleaning(strip_bold=True))) == "**x**"
    assert one(spark, "a\rb Γ", t.has_encoding_traces)


def test_patterns():
    assert t.is_pattern(r"\d+") and not t.is_pattern("(")
