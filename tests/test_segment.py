"""Segmentation against hand-derived cases and slow loops."""

from __future__ import annotations

import random

import pytest

from corpusloom.operators import segment as s
from corpusloom.operators.paging import page_filter
from corpusloom.sources.settings import DocumentSettings, PageRange, from_json


def titles(text, **settings):
    return [(x.title, x.content, x.level, x.parent) for _, _, x in s.sections_of_text(text, DocumentSettings(**settings))]


def test_fixed_size():
    a, b, c = "a" * 35, "b" * 35, "c" * 10
    assert [x[0] for x in titles(f"{a}\n\n{b}", max_section_size=40)] == ["Section 1", "Section 2"]
    assert titles(f"{c}\n\n{a}", max_section_size=40) == [("Section 1", a, 0, None)]


def test_split_by_sentences():
    parts = s.split_large(s.Section("T", "Aa b. Cc d. Eeeeee fff", 1), 10)
    assert [(p.title, p.content, p.level, p.parent) for p in parts] == [("T.1", "Aa b.", 2, "T"), ("T.2", "Cc d.", 2, "T"), ("T.3", "Eeeeee fff", 2, "T")]


def slow_split(text, size):
    out = []
    while len(text) > size:
        ends = [k + 1 for k in range(size) if text[k] == "." and k + 1 < len(text) and text[k + 1].isspace()]
        cut = ends[-1] if ends else size
        out.append(text[:cut].strip())
        text = text[cut:].lstrip()
    return [x for x in [*out, text] if x]


@pytest.mark.parametrize("seed", range(30))
def test_split_against_loop(seed):
    rng = random.Random(seed)
    text = s.flat("".join(rng.choice("ab. ") for _ in range(rng.randint(0, 400))))
    parts = [p.content for p in s.split_large(s.Section("T", text), 25)]
    assert parts == (slow_split(text, 25) if len(text) > 25 else [text])
    assert "".join(parts).replace(" ", "") == text.replace(" ", "") and all(len(p) <= 25 for p in parts)


def test_bold():
    pre, body = "p" * 40, "b" * 40
    assert titles(f"{pre}\n**Intro** tail\n{body}", extract_by_bold=True) == [("", pre, 0, None), ("Intro", body, 0, None)]
    assert titles(f"***x***\n{pre}", extract_by_bold=True)[0][0] == ""


def test_patterns_levels_and_parents():
    body = "text of a body that is long enough"
    text = f"lost\n# One\n{body}\n## Two\n{body}\n# Short\nx\n## Three\n{body}"
    found = titles(text, extract_by_patterns=True, custom_heading_patterns=(r"^# .*$", r"^## .*$"))
    assert found == [("One", body, 1, None), ("Two", body, 2, "# One"), ("Three", body, 2, "# One")]
    # a keyword that is no regular expression, on the last line too; two headings on one line
    assert titles(f"(key here\n{body}\nend (key", extract_by_patterns=True, custom_heading_patterns=("(key",))[0][:2] == ("(key here", body)
    assert len(titles(f"x1 x2\n{body}", extract_by_patterns=True, custom_heading_patterns=(r"x\d",))) == 1


def test_strategies_in_turn_and_duplicates():
    body = "w" * 40
    assert titles(body, extract_by_bold=True, extract_by_patterns=True, custom_heading_patterns=("zzz",)) == [("", body, 0, None)]
    text = f"**A**\nshort but here {'x' * 20}\n**a**\n{body}\n**B**\n{body}"
    assert [t[0] for t in titles(text, extract_by_bold=True)] == ["A", "B"]
    assert [t[0] for t in titles(text, extract_by_bold=True, deduplicate_sections=False)] == ["A", "a", "B"]


def test_page_numbers_and_filter(spark):
    rule = "=" * 80
    assert s.made("t", f"a\n{rule}\nPDF PAGE 4\n{rule}\nb") == s.Section("t", "a b", 0, None, 4)
    for pages in (PageRange(only=(2,)), PageRange(2, 2)):
        text = "\n\n".join(c * 1500 for c in "abc")
        assert [k for k, _, _ in s.sections_of_text(text, DocumentSettings(page_range=pages))] == ["section-2", "section-3"]
    docs = spark.createDataFrame([(0, "d", "\n\n".join(c * 1500 for c in "abc")), (1, "e", None), (2, "f", "")], "doc_ord long, document_id string, text string")
    sections = s.segment(docs).drop("start_offset")
    assert [r["section_id"] for r in page_filter(sections, PageRange(only=(2,))).orderBy("ord").collect()] == ["section-2", "section-3"]
    assert page_filter(sections, PageRange(2, 2)).count() == 2 and page_filter(sections, None).count() == 3


def test_own_settings_and_neighbours(spark):
    docs = spark.createDataFrame([(0, "d", "d", "x" * 40 + "\n\n" + "y" * 40), (1, "e", "e", "x" * 40 + "\n\n" + "y" * 40)], "doc_ord long, document_id string, stem string, text string")
    own = s.settings_table(spark, [("e", DocumentSettings(max_section_size=45))])
    rows = s.segment(docs, own=own).orderBy("doc_ord", "ord").collect()
    assert [(r["document_id"], r["section_id"], r["prev_section_id"], r["next_section_id"]) for r in rows] == [("d", "section-1", None, None), ("e", "section-1", None, "section-2"), ("e", "section-2", "section-1", None)]


def test_settings_from_json():
    found = from_json(DocumentSettings, {"maxSectionSize": 8192, "customHeadingPatterns": ["\\d+\\.\\d+\\s+"], "windowOverlap": 3, "pageRange": None})
    assert found == DocumentSettings(max_section_size=8192, custom_heading_patterns=("\\d+\\.\\d+\\s+",))
    assert found.with_section_size(2000).max_section_size == 2000
    with pytest.raises(ValueError):
        found.with_section_size(10)


def test_preview_and_titles(spark):
    text = "\n\n".join(["p" * 200] * 12)
    docs = spark.createDataFrame([(0, "a", "a", text), (1, "b", "b", "q" * 40), (2, "c", "c", None)], "doc_ord long, document_id string, stem string, text string")
    shown = s.preview(docs, DocumentSettings(max_section_size=150, page_range=PageRange(only=(9,)))).orderBy("document_id", "place").collect()
    assert [r["more"] for r in shown] == [14] * 10 + [0] and shown[0]["preview"] == "p" * 120 + "…" and shown[-1]["preview"] == "q" * 40
    own = s.settings_table(spark, [("b", DocumentSettings(meta={"title": "Big"}))])
    assert [r["title"] for r in s.with_titles(docs, own).orderBy("doc_ord").collect()] == ["a", "Big", "c"]
    assert s.with_titles(docs).where("title <> stem").count() == 0
