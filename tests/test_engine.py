"""Search, navigation, stores, sources, PDF layout, streaming and the server."""

from __future__ import annotations

import io
import json
import math
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators import navigate, pdf_layout, search
from corpusloom.operators.segment import segment
from corpusloom.server import Server
from corpusloom.sources import files
from corpusloom.sources.index_store import build_index, export_json, import_json, open_index
from corpusloom.sources.settings import Cleaning, DocumentSettings, EngineSettings, PageRange, SettingsFolder
from corpusloom.sources.workspace import Workspace, preprocess_folder
from corpusloom.streaming.ingest import ingest

TEXTS = ["alpha beta gamma " * 3 + "\n\n" + "delta " * 300, "beta beta delta epsilon zeta eta theta", "nothing of interest in this short text at all"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, f"doc-{k}", f"doc-{k}", f"doc-{k}.txt", x) for k, x in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_ord long, document_id string, stem string, file_path string, text string")


@pytest.fixture(scope="module")
def sections(docs):
    return segment(docs).cache()


def slow_scores(rows, query, scope=None):
    terms = query.split()
    chosen = [r for r in rows if scope is None or r["document_id"] == scope]
    average = sum(len(r["content"]) for r in chosen) / len(chosen)
    idf = {}
    for w in terms:
        n = sum(w in r["content"].lower() for r in rows)
        idf[w] = math.log((len(rows) - n + 0.5) / (n + 0.5) + 1) if n else 0
    out = []
    for r in chosen:
        text, score = r["content"].lower(), 0.0
        for w in terms:
            if tf := text.count(w):
                score += idf[w] * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(r["content"]) / average)))
        score += 2.0 * (len(terms) > 1 and " ".join(terms) in text)
        if score > 0:
            out.append((-int(score * 100 + 1e-9), r["doc_ord"], r["ord"], r["section_id"]))
    return [(d, i, -s) for s, d, _, i in sorted(out)]


@pytest.mark.parametrize(("query", "scope"), [("beta delta", None), ("beta delta", "doc-1"), ("delta", "doc-0"), ("zzz", None)])
def test_search_against_loop(spark, sections, query, scope):
    rows = sections.orderBy("doc_ord", "ord").collect()
    found = search.search(sections, query, scope, 20).collect()
    assert [(int(r["document_id"][4:]), r["id"], r["relevance_score"]) for r in found] == slow_scores(rows, query, scope)
    batch = search.search_batch(sections, spark.createDataFrame([(7, query), (8, "the a"), (9, None)], "query_id long, query string"), 20).orderBy("rank").collect()
    if scope is None:
        assert [(int(r["document_id"][4:]), r["section_id"], r["relevance_score"]) for r in batch] == slow_scores(rows, query)


def test_batch_with_overlaps_titles_and_keywords(spark, sections):
    """Terms within terms, terms that overlap themselves, bonuses: the batch form gives what single queries give."""
    odd = sections.withColumn("content_lc", F.concat(F.col("content_lc"), F.lit(" aaaa deltadelta"))).withColumn("keywords", F.array(F.lit("Beta-word"), F.lit("x")))
    asked = ["aa delta", "eta beta eta", "elta delt", "beta delta epsilon", "section beta", "aaa"]
    batch = search.search_batch(odd, spark.createDataFrame(list(enumerate(asked)), "query_id long, query string"), 20).collect()
    for k, query in enumerate(asked):
        one = [(r["document_id"], r["id"], r["relevance_score"]) for r in search.search(odd, query, limit=20).collect()]
        assert one and [(r["document_id"], r["section_id"], r["relevance_score"]) for r in sorted(batch, key=lambda r: r["rank"]) if r["query_id"] == k] == one


def test_search_neighbours_and_limits(sections):
    found = {(r["document_id"], r["id"]): r for r in search.search(sections, "beta", limit=20).collect()}
    last = sections.where("doc_ord = 0").agg(F.max_by("section_id", "ord")).first()[0]
    assert found["doc-1", "section-1"]["previous_section_id"] == last and found["doc-1", "section-1"]["next_section_id"] == "section-1"
    assert found["doc-0", "section-1"]["previous_section_id"] is None
    assert [search.clamped(n) for n in (0, 7, 99)] == [1, 7, 20]
    assert search.search(sections, "the of").count() == 0 and search.search(sections, "beta", "none").count() == 0
    keyed = sections.withColumn("keywords", F.array(F.lit("Beta-word")))
    plain = search.search(sections, "beta", "doc-1").first()["relevance_score"]
    assert search.search(keyed, "beta", "doc-1").first()["relevance_score"] != plain


def test_navigation(docs, sections):
    one = navigate.get_section(sections, "section-1", "doc-1").collect()
    assert len(one) == 1 and one[0]["content"] == TEXTS[1]
    assert navigate.get_section(sections, "section-1").first()["document_id"] == "doc-0"
    context = navigate.get_section(sections, "section-1", "doc-0", include_context=True).first()
    assert context["previous"] is None and context["next"]["id"] == "section-2"
    files_ = navigate.file_table(docs, sections)
    assert navigate.list_files(files_).count() == 3
    stats = navigate.statistics(files_).first()
    assert stats["documents"] == 3 and stats["total_characters"] == sections.agg(F.sum("char_count")).first()[0]


def test_pages(spark):
    rule = "=" * 80
    rows = [("A b", f"{rule}\nPDF PAGE 10\n{rule}\nten"), ("c", f"\nPDF PAGE 1\n{rule}\nfirst\nPDF PAGE 2\nsecond")]
    docs = spark.createDataFrame(rows, "stem string, text string")
    loose = {r["document_id"]: r["content"] for r in navigate.pages_from_source(docs, 1).collect()}
    assert loose["A b"].startswith("0") and loose["c"].endswith("first")
    strict = navigate.pages_from_source(docs, 1, strict=True).collect()
    assert [r["document_id"] for r in strict] == ["c"] and strict[0]["content"].endswith("first")
    assert navigate.pages_from_source(docs, 10, "a-b").count() == navigate.pages_from_source(docs, 10, "A B").count() == 1
    with pytest.raises(ValueError):
        navigate.get_page(docs, docs, 0)


def test_document_status(spark):
    texts = spark.createDataFrame([("a", 1536, None, 1, None)], "stem string, size long, only array<int>, start int, end int")
    raw = spark.createDataFrame([("a", "pdf", 10), ("b", "PDF", 2048), ("c", "md", 1)], "stem string, extension string, size long")
    found = {(r["stem"], r["kind"]): (r["size"], r["status"]) for r in navigate.document_status(texts, raw).collect()}
    assert found == {("a", "txt"): ("1.5 KB", ""), ("a", "pdf"): ("10 B", "converted"), ("b", "pdf"): ("2 KB", "pending")}


def test_pdf_layout(spark):
    rows = [("d", 0, 0, k, 0, f"t{k}", font, size) for k, (font, size) in enumerate([("X", 22.0), ("X", 18.0), ("X", 15.0), ("X", 14.0), ("X-BoldItalic", 10.0), ("X", 10.0), ("X", 10.0), ("X", 10.0), ("X", 10.0), ("X", 10.0), ("X", 10.0)])]
    rows += [("d", 0, 1, 0, 0, " 12 ", "X", 10.0), ("d", 1, 0, 0, 0, "  ", "X", 9.0)]
    spans = spark.createDataFrame(rows, pdf_layout.SPANS)
    assert pdf_layout.base_sizes(spans).first()["base_size"] == 10.0
    page = {r["page"]: r["text"] for r in pdf_layout.pages(spans).collect()}
    assert page[0].split("\n")[:5] == ["# t0", "## t1", "### t2", "t3", "***t4***"] and "12" not in page[0] and page[1] == ""
    text = pdf_layout.marked_text(pdf_layout.pages(spans)).first()["text"]
    assert text.startswith("\n" + "=" * 80 + "\nPDF PAGE 1\n") and "PDF PAGE 2" in text
    assert pdf_layout.page_counts(spans).first()["pages"] == 2


def test_files_and_conversion(spark, tmp_path):
    raw = tmp_path / "raw folder"
    raw.mkdir()
    (raw / "a+b.md").write_text("plain")
    (raw / "c.html").write_text("<p>page &amp; more</p>")
    (raw / "d.pdf").write_bytes(b"no pdf")
    (raw / "e.bin").write_bytes(b"x")
    found = {r["stem"]: (r["text"], r["error"] is not None) for r in files.convert_raw(files.scan_raw(spark, str(raw))).collect()}
    assert found == {"a+b": ("plain", False), "c": ("page & more", False), "d": (None, True)}
    scan = files.scan_raw(spark, str(raw))
    done = scan.where("stem = 'c'").select("file_path", F.col("modified").alias("converted"))
    assert sorted(r["stem"] for r in files.newer_than(scan, done).collect()) == ["a+b", "d", "e"]


def test_index_store(spark, docs, tmp_path):
    stamped = docs.withColumn("modified", F.lit(1))
    path = str(tmp_path / "index")
    first = open_index(stamped, path)
    n = first.sections.count()
    assert n and open_index(stamped, path).sections.count() == n
    assert open_index(docs, str(tmp_path / "plain")).sections.count() == n
    other = open_index(stamped, path, own=[("doc-0", '{"maxSectionSize": 100}')])
    assert other.sections.count() > n and other.metadata.first()["total_sections"] == other.sections.count()
    export_json(build_index(docs), str(tmp_path / "json"))
    assert import_json(spark, str(tmp_path / "json")).count() == n


def test_settings_folder(tmp_path):
    folder = SettingsFolder(tmp_path)
    assert folder.engine() == EngineSettings() and (tmp_path / "global" / "engine.json").exists()
    folder.save_engine(EngineSettings(enable_unified_pipeline=False))
    folder.forget()
    assert not folder.engine().enable_unified_pipeline
    folder.save_document("x", DocumentSettings(max_section_size=2000))
    assert folder.documents() == ["x"] and folder.document("x").max_section_size == 2000 and folder.document("y") is None
    (tmp_path / "global" / "preprocessing.json").write_text("﻿" + json.dumps({"preprocessing": {"stripBold": True}}), encoding="utf-8")
    assert folder.cleaning() == Cleaning(strip_bold=True)
    assert Cleaning().toggled().join_short_lines


def test_pages_of_a_document(spark):
    settings = DocumentSettings(max_section_size=2000).with_pages("12, 15-17,, 3 - 4 ")
    assert settings.page_range == PageRange(only=(3, 4, 12, 15, 16, 17)) and settings.max_section_size == 2000
    assert settings.with_pages("  ").page_range is None
    for wrong in ("0", "5-3", "a", "1-", ",", "1 2"):
        with pytest.raises(ValueError):
            settings.with_pages(wrong)
    asked = ["12, 15-17,, 3 - 4 ", "7", "1-3,2"]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(asked)], "k int, x string").select("k", t.page_selection(F.col("x")).alias("pages")).collect()
    assert all(tuple(r["pages"]) == settings.with_pages(asked[r["k"]]).page_range.only for r in rows)


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_text("A first document with enough text to be a section.")
    run = lambda: ingest(spark, str(source), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    run()
    (source / "b.txt").write_text("A second document with enough text to be a section.")
    run()
    run()
    (source / "a.txt").write_text("A first document that has changed, with enough text to be a section.")
    os.utime(source / "a.txt", (2_000_000_000, 2_000_000_000))
    run()
    assert sorted(r["document_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


FITZ = """
class Page:
    def __init__(self, text):
        self.text = text
    def get_text(self, kind=None):
        if kind is None:
            return self.text
        if "plain" in self.text:
            raise ValueError("no layout")
        line = lambda s: {"spans": [{"text": s, "font": "Sans-Bold" if s.startswith("B") else "Sans", "size": 24.0 if s.startswith("H") else 10.0}]}
        return {"blocks": [{"type": 1}, {"type": 0, "lines": [line(s) for s in self.text.split("|")]}]}

class open(list):
    def __init__(self, stream, filetype):
        if not stream.startswith(b"%PDF"):
            raise ValueError("broken")
        super().__init__(Page(p) for p in stream[4:].decode().split("#"))
    def __enter__(self):
        return self
    def __exit__(self, *a):
        return False
"""


def test_workspace_from_raw_files_to_a_fresh_index(spark, tmp_path, monkeypatch):
    """Raw files are converted once, settings reach the texts, and a change of either gives a new index."""
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "fitz.py").write_text(FITZ)
    environment = spark.sparkContext.environment
    monkeypatch.setitem(environment, "PYTHONPATH", f"{tmp_path / 'lib'}:{environment['PYTHONPATH']}")
    space = Workspace(spark, str(tmp_path / "data"))
    space.scaffold()
    root = tmp_path / "data"
    long_ = " with enough words in it to be a section of the index."
    (root / "documents" / "a.txt").write_text(f"\ufeffA **bold** text ├{long_}")
    (root / "documents" / "b.txt").write_text(f"B **bold** text{long_}")
    (root / "raw" / "p.pdf").write_bytes(f"%PDFHeading|Bold line|body of a page|x|y|z{long_}|12#plain page{long_}".encode())
    (root / "raw" / "bad.pdf").write_bytes(b"nothing")
    (root / "raw" / "w.html").write_text(f"<p>A page &amp; more{long_}</p>")
    space.settings.save_document("b", DocumentSettings(preprocessing=Cleaning(preserve_markdown=False, strip_bold=True), max_section_size=1000))
    index = space.refresh()
    texts = {r["stem"]: r["text"] for r in space.documents().collect()}
    assert texts["a"] == f"A **bold** text {long_[1:]}" and texts["b"] == f"B bold text{long_}" and texts["w"] == f"A page & more{long_}"
    rule = "=" * 80
    assert texts["p"] == f"\n{rule}\nPDF PAGE 1\n{rule}\n# Heading\n**Bold line**\nbody of a page\nx\ny\nz{long_}\n\n{rule}\nPDF PAGE 2\n{rule}\nplain page{long_}"
    assert [r["file_path"].rsplit("/", 1)[1] for r in space.errors().collect()] == ["bad.pdf"]
    assert space.counters() == {"documents": 4, "cleaned": 4, "with_traces": 0, "converted": 2, "failed": 1}
    assert sorted(r["document_id"] for r in index.files.collect()) == ["a", "b", "p", "w"]
    stamp = lambda: space.store.current().name
    first, made = stamp(), space.conversions.current().name
    assert space.refresh().metadata.first()["total_sections"] == index.sections.count()
    assert stamp() == first and space.conversions.current().name == made
    space.settings.save_cleaning(Cleaning(preserve_markdown=False, strip_bold=True))
    space.refresh()
    second = stamp()
    assert second != first and {r["stem"]: r["text"] for r in space.documents().collect()}["a"].startswith("A bold")
    space.settings.save_document("b", DocumentSettings())
    (root / "raw" / "w.html").write_text(f"<p>Another page{long_}</p>")
    os.utime(root / "raw" / "w.html", (2_000_000_000, 2_000_000_000))
    space.refresh()
    texts = {r["stem"]: r["text"] for r in space.documents().collect()}
    assert stamp() != second and texts["b"].startswith("B **bold**") and texts["w"] == f"Another page{long_}"
    assert space.conversions.current().name != made and space.converted().count() == 3 and space.counters()["converted"] == 2
    out = preprocess_folder(spark, str(root / "documents"), str(tmp_path / "out"), Cleaning(preserve_markdown=False, strip_bold=True))
    assert sorted(r["text"][:6] for r in out.collect()) == ["A bold", "B bold"]


def test_server(spark, docs, sections):
    server = Server(build_index(docs), docs)
    calls = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize"},
        {"id": 2, "method": "tools/list"},
        {"id": 3, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "beta", "limit": "3"}}},
        {"id": 4, "method": "tools/call", "params": {"name": "get_section", "arguments": {"section_id": "none"}}},
        {"id": 5, "method": "tools/call", "params": []},
        {"id": 6, "method": "nothing"},
        {"method": "notifications/initialized"},
        {"id": 7, "method": "tools/call", "params": {"name": "list_files"}},
        {"id": 8, "method": "tools/call", "params": {"name": "get_page", "arguments": {"page_number": 3}}},
    ]
    sink = io.StringIO()
    server.run(io.StringIO("\n\n".join(map(json.dumps, calls)) + "\n{bad"), sink)
    answers = [json.loads(x) for x in sink.getvalue().splitlines()]
    by_id = {a["id"]: a for a in answers}
    assert len(json.loads(by_id[3]["result"]["content"][0]["text"])) == 2
    assert [by_id[k]["error"]["code"] for k in (4, 5, 6, 8)] == [-32603, -32602, -32601, -32603]
    assert len(by_id[2]["result"]["tools"]) == 4 and by_id[None]["error"]["code"] == -32603
