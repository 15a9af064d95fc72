"""Segmentation: one document becomes many sections.

Cutting is sequential (each cut depends on the one before), so a document is cut in a Python worker that streams Arrow
batches, in time linear in its length. As a document's sections are all made in one place, titles are deduplicated,
numbered, filtered by page and linked to their neighbours there too: no window and no shuffle are needed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.chars import SPACE_CHARS
from corpusloom.functions.text import MAX_TITLE, MIN_SECTION, PAGE_CHARS, SECTION_MARKER
from corpusloom.session import prepare, spread
from corpusloom.sources.settings import DocumentSettings, PageRange, document_settings, to_json

SCHEMA = (
    "doc_ord long, document_id string, ord int, section_id string, title string, content string, content_lc string, "
    "title_lc string, keywords array<string>, summary string, heading_level int, parent_title string, char_count int, "
    "page_number int, start_offset long, prev_section_id string, next_section_id string"
)
_MARKER = re.compile(SECTION_MARKER)
_BOLD = re.compile(r"\*\*([^*]+)\*\*")
_HEADING_MARK, _SECTION_NUMBER = re.compile(r"#+\s*"), re.compile(r"\d+(\.\d+)*\.?\s*")
_WRITTEN_BREAKS = re.compile(r"\\r\\n|\\r|\\n")
_BLANKS = re.compile("  +")
_PARAGRAPHS = re.compile(r"\n\n|\r\n\r\n")
#: Characters of sections that a task holds at a time, beside the document that it cuts.
HELD = 1 << 20


@dataclass(frozen=True)
class Section:
    title: str
    content: str
    level: int = 0
    parent: str | None = None
    page: int = 0


def flat(text: str) -> str:
    """All line breaks, also written-out ones, become blanks; runs of blanks become one; trim."""
    text = text.replace("\r\n", " ").replace("\r", " ").replace("\n", " ")
    if "\\" in text:
        text = _WRITTEN_BREAKS.sub(" ", text)
    if "  " in text:
        text = _BLANKS.sub(" ", text)
    return text.strip(SPACE_CHARS)


def title_of(text: str) -> str:
    if m := _HEADING_MARK.match(text):
        text = text[m.end() :]
    text = text.strip(SPACE_CHARS)
    if m := _SECTION_NUMBER.match(text):
        text = text[m.end() :]
    text = text.strip(SPACE_CHARS)
    return text if len(text) <= MAX_TITLE else text[: MAX_TITLE - 3] + "..."


def made(title: str, body: str, level: int = 0, parent: str | None = None) -> Section:
    """A section: its page is that of the first marker in it, markers go, line breaks become blanks."""
    page = 0
    if "PDF PAGE" in body and (first := _MARKER.search(body)):
        page, body = int(first[1]), _MARKER.sub("", body)
    return Section(title_of(title), flat(body), level, parent, page if page < 2**31 else 0)


def long_enough(text: str) -> bool:
    return len(text.strip(SPACE_CHARS)) >= MIN_SECTION


def by_bold(text: str) -> list[Section]:
    """Lines that begin in bold open a section; the rest of such a line is dropped, text before the first has no title."""
    parts: list[tuple[str, list[str]]] = [("", [])]
    for line in text.split("\n"):
        if m := _BOLD.match(line):
            parts.append((m[1].strip(SPACE_CHARS), []))
        elif line.strip(SPACE_CHARS):
            parts[-1][1].append(line)
    bodies = ((title, "\n".join(lines)) for title, lines in parts)
    return [made(title, body) for title, body in bodies if long_enough(body)]


@lru_cache(maxsize=1024)
def compiled(pattern: str) -> re.Pattern[str] | None:
    try:
        return re.compile(pattern, re.M | re.I)
    except re.error:
        return None


def headings(text: str, patterns: tuple[str, ...]) -> list[tuple[int, str, int]]:
    """(position, title, level) of all headings by position. The first pattern gives level 1, the others level 2, and
    the first pattern to match at a position has it. A pattern that is no regular expression is a keyword: each line
    that holds it is a heading."""
    found: dict[int, tuple[str, int]] = {}
    for i, pattern in enumerate(patterns):
        level = 1 if i == 0 else 2
        if (regex := compiled(pattern)) is not None:
            for m in regex.finditer(text):
                found.setdefault(m.start(), (m[0].strip(SPACE_CHARS), level))
        else:
            word, start = pattern.lower(), 0
            for line in text.split("\n"):
                if word in line.lower():
                    found.setdefault(start, (line.strip(SPACE_CHARS), level))
                start += len(line) + 1
    return [(p, *found[p]) for p in sorted(found)]


def by_patterns(text: str, patterns: tuple[str, ...]) -> list[Section]:
    """Sections between headings: the body begins on the line after the heading and ends at the next one.

    Two headings on one line give the first an empty body, so it is skipped and the document is kept.
    """
    spots, out, parent = headings(text, patterns), [], None
    for (at, title, level), end in zip(spots, [*(s[0] for s in spots[1:]), len(text)]):
        line_end = text.find("\n", at)
        begin = at if line_end < 0 else line_end + 1
        if begin >= len(text):
            begin = at + len(title) + 1
        body = text[begin:end].strip(SPACE_CHARS)
        if len(body) < MIN_SECTION:
            continue
        if level == 1:
            parent = title
        out.append(made(title, body, level, parent if level > 1 else None))
    return out


def by_size(text: str, size: int) -> list[Section]:
    """Paragraphs packed greedily up to ``size`` characters; a pack of under 30 characters is dropped."""
    packs: list[list[str]] = []
    room = 0
    parts = _PARAGRAPHS.split(text) if "\r" in text else text.split("\n\n")
    for paragraph in filter(None, (p.strip(SPACE_CHARS) for p in parts)):
        if packs and room + len(paragraph) <= size:
            packs[-1].append(paragraph)
            room += len(paragraph) + 2
        else:
            packs.append([paragraph])
            room = len(paragraph)
    bodies = filter(long_enough, ("\n\n".join(p) for p in packs))
    return [made(f"Section {k}", body) for k, body in enumerate(bodies, 1)]


def split_large(section: Section, size: int) -> list[Section]:
    """Cut a larger section after the last sentence end (a full stop before white space) within ``size`` characters,
    or at ``size`` where there is none. Parts are a level deeper and have the section as their parent."""
    text = section.content
    if len(text) <= size:
        return [section]
    chunks, at = [], 0
    while len(text) - at > size:
        cut = dot = at + size
        while (dot := text.rfind(".", at, dot)) >= 0:
            if text[dot + 1] in SPACE_CHARS:
                cut = dot + 1
                break
        chunks.append(text[at:cut].strip(SPACE_CHARS))
        at = cut
        while at < len(text) and text[at] in SPACE_CHARS:
            at += 1
    chunks.append(text[at:])
    parts = enumerate(filter(None, chunks), 1)
    return [replace(section, title=f"{section.title}.{k}", content=c, level=section.level + 1, parent=section.title) for k, c in parts]


def on_pages(start: int, size: int, pages: PageRange) -> bool:
    """Does a section from ``start`` touch the wanted virtual pages of 2500 characters?"""
    if pages.only:
        return any(start // PAGE_CHARS + 1 <= p <= -(-(start + size) // PAGE_CHARS) for p in pages.only)
    before_end = pages.end is None or start < pages.end * PAGE_CHARS
    return before_end and start + size > (pages.start - 1) * PAGE_CHARS


def sections_of_text(text: str, settings: DocumentSettings) -> list[tuple[str, int, Section]]:
    """(id, offset, section): the strategies in turn until one finds sections, then size, titles, length and pages."""
    found: list[Section] = []
    if settings.extract_by_bold:
        found = by_bold(text)
    if not found and settings.extract_by_patterns and settings.custom_heading_patterns:
        found = by_patterns(text, settings.custom_heading_patterns)
    if not found:
        found = by_size(text, settings.max_section_size)
    found = [part for section in found for part in split_large(section, settings.max_section_size)]
    if settings.deduplicate_sections:  # before the length filter: a short first one hides a longer later one
        first: dict[str, Section] = {}
        for section in found:
            first.setdefault(section.title.lower(), section)
        found = list(first.values())
    found = [replace(s, content=flat(s.content)) for s in found if len(s.content) >= MIN_SECTION]
    out, offset = [], 0
    for k, section in enumerate(found, 1):
        if settings.page_range is None or on_pages(offset, len(section.content), settings.page_range):
            out.append((f"section-{k}", offset, section))
        offset += len(section.content)
    return out


def segment(docs: DataFrame, settings: DocumentSettings = DocumentSettings(), own: DataFrame | None = None) -> DataFrame:
    """The sections of ``docs`` (doc_ord, document_id, text and, with ``own``, stem), in the SCHEMA above.

    ``own`` has (stem, settings: JSON); a document's own settings replace the given ones as a whole. ord is the
    section's place in its document after filtering; identity is (doc_ord, ord). Null and empty texts give none.
    """
    prepare(docs.sparkSession)
    if own is not None:
        docs = docs.join(own.select("stem", F.col("settings").alias("settings")), "stem", "left")
    else:
        docs = docs.withColumn("settings", F.lit(None).cast("string"))
    default = to_json(settings)
    docs = docs.select(F.col("doc_ord").cast("long").alias("doc_ord"), "document_id", F.col("text").cast("string").alias("text"), "settings")
    return spread(docs).mapInArrow(lambda batches: cut(batches, default), SCHEMA)


_TYPES = {
    "doc_ord": pa.int64(), "ord": pa.int32(), "keywords": pa.list_(pa.string()), "heading_level": pa.int32(),
    "char_count": pa.int32(), "page_number": pa.int32(), "start_offset": pa.int64(),
}


def cut(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """The sections of batches of documents, in batches of about HELD characters: a task's memory is that of one batch of
    texts, one document's sections and HELD, however much it reads."""
    names = [f.strip().split(" ")[0] for f in re.split(r",(?![^<]*>)", SCHEMA)]
    columns: dict[str, list] = {n: [] for n in names}
    held = 0
    for batch in batches:
        for row in zip(*(batch[n] for n in ("doc_ord", "document_id", "text", "settings"))):
            doc_ord, document_id, text, own = (x.as_py() for x in row)
            found = sections_of_text(text or "", document_settings(own or default))
            ids = [None, *(x[0] for x in found), None]
            for k, (name, offset, s) in enumerate(found):
                values = (
                    doc_ord, document_id, k, name, s.title, s.content, s.content.lower(), s.title.lower(),
                    [], "", s.level, s.parent, len(s.content), s.page, offset, ids[k], ids[k + 2],
                )
                for n, v in zip(names, values):
                    columns[n].append(v)
                held += len(s.content)
                if held >= HELD:
                    yield _batch(columns)
                    columns, held = {n: [] for n in names}, 0
    if columns["ord"]:
        yield _batch(columns)


def _batch(columns: dict[str, list]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(v, _TYPES.get(n, pa.string())) for n, v in columns.items()], names=list(columns))


def settings_table(spark, rows: list[tuple[str, DocumentSettings]]) -> DataFrame:
    return spark.createDataFrame([(stem, to_json(s)) for stem, s in rows], "stem string, settings string")


def preview(docs: DataFrame, settings: DocumentSettings = DocumentSettings(), n: int = 10) -> DataFrame:
    """(document_id, place, title, level, preview, more): the first ``n`` sections of each document that unsaved settings
    would give, whatever their pages, shortened to 120 characters, and how many more there are."""
    found = segment(docs, replace(settings, page_range=None))
    content = F.col("content")
    short = F.when(F.length(content) > MAX_TITLE, F.concat(F.substring(content, 1, MAX_TITLE), F.lit("…"))).otherwise(content)
    sizes = found.groupBy("doc_ord").agg(F.greatest(F.count(F.lit(1)) - n, F.lit(0)).alias("more"))
    first = found.where(F.col("ord") < n).join(sizes, "doc_ord")
    return first.select("document_id", (F.col("ord") + 1).alias("place"), "title", F.col("heading_level").alias("level"), short.alias("preview"), "more")


def with_titles(docs: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """Documents with the title of their front matter: ``title`` of their settings' ``meta``, else the file's stem."""
    if own is None:
        return docs.withColumn("title", F.col("stem"))
    names = own.select("stem", F.get_json_object("settings", "$.meta.title").alias("title"))
    return docs.drop("title").join(names, "stem", "left").withColumn("title", F.coalesce("title", "stem"))
