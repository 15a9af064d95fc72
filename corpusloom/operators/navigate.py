"""Reading the index: sections with context, pages, files, statistics and document lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as t

SECTION = [
    "id", "title", "content", "document_id", "heading_level", "parent_title", "keywords", "summary", "char_count",
]


def _as_section(df: DataFrame) -> DataFrame:
    return df.select(F.col("section_id").alias("id"), *[c for c in SECTION if c != "id"])


def get_section(
    sections: DataFrame, section_id: str, document_id: str | None = None, include_context: bool = False
) -> DataFrame:
    """The section of that id, of the first document that has it unless one is named; one row, or none.

    With context, the columns are current, previous and next; neighbours are those of the same document.
    """
    wanted = sections.where(F.col("section_id") == section_id)
    if document_id is not None:
        wanted = wanted.where(F.col("document_id") == document_id)
    wanted = wanted.orderBy("doc_ord", "ord").limit(1)
    if not include_context:
        return _as_section(wanted)
    one = wanted.select("doc_ord", F.col("ord").alias("at"), F.struct(F.col("section_id").alias("id"), *SECTION[1:]).alias("current"))
    near = sections.select("doc_ord", "ord", F.struct(F.col("section_id").alias("id"), "title", "content", "summary").alias("item"))
    both = near.join(F.broadcast(one.select("doc_ord", "at")), "doc_ord").where(F.abs(F.col("ord") - F.col("at")) == 1)
    sides = both.groupBy("doc_ord").agg(
        F.max(F.when(F.col("ord") < F.col("at"), F.col("item"))).alias("previous"),
        F.max(F.when(F.col("ord") > F.col("at"), F.col("item"))).alias("next"),
    )
    return one.join(F.broadcast(sides), "doc_ord", "left").select("current", "previous", "next")


def with_neighbours(sections: DataFrame) -> DataFrame:
    """(document_id, section_id, previous_section_id, next_section_id); the links are made at segmentation."""
    return sections.select("document_id", "section_id", F.col("prev_section_id").alias("previous_section_id"), "next_section_id")


def pages_from_source(docs: DataFrame, page: int, file_id: str | None = None, strict: bool = False) -> DataFrame:
    """Text after the first mark of a page up to the next page's mark (or the end), trimmed and non-empty.

    By default the mark of page 1 is also found in that of page 10, as documents were always read; ``strict`` asks for
    the whole number. ``file_id`` is a document's stem, in either case, or its slug.
    """
    mark, following = f"PDF PAGE {page}", f"PDF PAGE {page + 1}"
    if file_id:
        docs = docs.where((F.lower("stem") == file_id.lower()) | (t.document_slug(F.col("stem")) == file_id))
    text = F.col("text")
    at = F.position(F.lit(mark), text)
    if strict:
        at = F.coalesce(F.nullif(F.length(F.regexp_extract(text, rf"(?s)\A(.*?)PDF PAGE {page}(?!\d)", 1)), F.lit(-1)), F.lit(0))
        at = F.when(text.rlike(rf"PDF PAGE {page}(?!\d)"), at + 1).otherwise(0)
    rest = F.substring(text, at + len(mark), F.length(text))
    end = F.position(F.lit(following), rest)
    if strict:
        end = F.when(rest.rlike(rf"PDF PAGE {page + 1}(?!\d)"), F.length(F.regexp_extract(rest, rf"(?s)\A(.*?)PDF PAGE {page + 1}(?!\d)", 1)) + 1).otherwise(0)
    content = t.trim_space(F.when(end > 0, F.substring(rest, F.lit(1), end - 1)).otherwise(rest))
    found = docs.where(at > 0).select(
        F.lit(file_id).alias("document_id") if file_id else F.col("stem").alias("document_id"),
        F.lit(f"Page {page}").alias("title"),
        content.alias("content"),
        F.lit(page).alias("page_number"),
        F.lit("source_document").alias("source"),
        F.array().cast("array<string>").alias("keywords"),
    )
    return found.where("content <> ''")


def pages_from_index(sections: DataFrame, page: int, file_id: str | None = None) -> DataFrame:
    found = sections.where(F.col("page_number") == page)
    if file_id:
        found = found.where(F.col("document_id") == file_id)
    return found.select("document_id", "title", "content", "page_number", F.lit("index").alias("source"), "keywords")


def get_page(docs: DataFrame, sections: DataFrame, page: int, file_id: str | None = None, strict: bool = False) -> DataFrame:
    """A page from the source texts, else from the index."""
    if page < 1:
        raise ValueError("Missing or invalid page_number")
    source = pages_from_source(docs, page, file_id, strict)
    return pages_from_index(sections, page, file_id) if source.isEmpty() else source


def file_table(docs: DataFrame, sections: DataFrame) -> DataFrame:
    """One row for each document, with or without sections."""
    counts = sections.groupBy("doc_ord").agg(F.count(F.lit(1)).alias("n"), F.sum("char_count").alias("chars"))
    return docs.join(counts, "doc_ord", "left").select(
        "doc_ord",
        "document_id",
        "file_path",
        F.lit("Generic").alias("document_type"),
        F.coalesce("n", F.lit(0)).cast("int").alias("section_count"),
        F.coalesce("chars", F.lit(0)).cast("long").alias("total_characters"),
        F.lit("").alias("summary"),
    )


def list_files(files: DataFrame) -> DataFrame:
    return files.select(F.col("document_id").alias("file_id"), F.col("file_path").alias("file"), "document_type", "total_characters")


def index_totals(sections: DataFrame) -> DataFrame:
    """Sections, characters and virtual pages of the corpus, in one row."""
    chars = F.coalesce(F.sum("char_count"), F.lit(0)).cast("long")
    return sections.agg(F.count(F.lit(1)).alias("total_sections"), chars.alias("total_characters")).withColumn(
        "total_pages", F.ceil(F.col("total_characters") / t.PAGE_CHARS).cast("int")
    )


# Names of heading levels.
LEVELS = {0: "Paragraphs", 1: "Top-level headings", 2: "Sub-headings", 3: "Deep headings"}


def heading_levels(sections: DataFrame) -> DataFrame:
    level = F.col("heading_level")
    name = F.concat(F.lit("Level "), level.cast("string"))
    for k, v in LEVELS.items():
        name = F.when(level == k, v).otherwise(name)
    return sections.groupBy("heading_level").agg(F.count(F.lit(1)).alias("sections")).withColumn("level_name", name).orderBy("heading_level")


def statistics(files: DataFrame) -> DataFrame:
    """Documents, sections, characters and whole characters a section, in one row, from the file table."""
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    totals = files.agg(
        F.count(F.lit(1)).alias("documents"), whole("section_count").alias("total_sections"), whole("total_characters").alias("total_characters")
    )
    mean = F.when(F.col("total_sections") > 0, F.floor(F.col("total_characters") / F.col("total_sections"))).otherwise(0)
    return totals.withColumn("average_characters", mean.cast("long"))


def document_status(texts: DataFrame, raw: DataFrame) -> DataFrame:
    """Text files with size and page status, and PDF files with whether they have been converted.

    texts: stem, size, only, start, end of the page range. raw: stem, extension, size.
    """
    own = texts.select(
        "stem", F.lit("txt").alias("kind"), t.format_bytes(F.col("size")).alias("size"),
        t.page_status(F.col("only"), F.col("start"), F.col("end")).alias("status"),
    )
    pdf = raw.where(F.lower("extension") == "pdf")
    done = texts.select("stem", F.lit(True).alias("done")).distinct()
    state = F.when(F.col("done"), "converted").otherwise("pending")
    converted = pdf.join(done, "stem", "left").select("stem", F.lit("pdf").alias("kind"), t.format_bytes(F.col("size")).alias("size"), state.alias("status"))
    return own.unionByName(converted)
