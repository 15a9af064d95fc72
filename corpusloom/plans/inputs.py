"""Inputs of the registered queries, derived from the tables in the same way for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.segment import segment
from corpusloom.session import stash
from corpusloom.sources.settings import DocumentSettings

RULE = "=" * 80
#: Appended to turns of conversations, so that every section is long enough to count.
CLOSING = "This closing line makes every turn long enough."
WS = r"[\t-\r \x{85}\p{Z}]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose lines are paragraphs."""
    stem = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("doc_ord"), stem.alias("document_id"), stem.alias("stem"),
        F.concat(stem, F.lit(".txt")).alias("file_path"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"),
    )


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(documents(spark, sf_dir))


def stored_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections as a stored index, which search reads several times."""
    return stash(sections(spark, sf_dir), "sections")


def conversations(spark: SparkSession, sf_dir: str, turn: Column) -> DataFrame:
    """One document for each conversation: its turns in order, each as ``turn`` says."""
    stem = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", turn.alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("turn", "part")))
    text = F.array_join(F.transform(parts, lambda p: p["part"]), "\n")
    return rows.groupBy("conv_id").agg(text.alias("text")).select(
        F.col("conv_id").alias("doc_ord"), stem.alias("document_id"), stem.alias("stem"), F.concat(stem, F.lit(".txt")).alias("file_path"), "text"
    )


def bold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat_ws(" ", "role", F.col("turn").cast("string"))
    return conversations(spark, sf_dir, F.concat(F.lit("**"), name, F.lit("** rest\n"), F.col("text"), F.lit(f"\n{CLOSING}")))


def bold_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(bold_documents(spark, sf_dir), DocumentSettings(extract_by_bold=True))


def heading_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("turn") % 2 == 0, "# ").otherwise("## ")
    name = F.concat_ws(" ", "role", F.col("turn").cast("string"))
    return conversations(spark, sf_dir, F.concat(mark, name, F.lit("\n"), F.col("text"), F.lit(f"\n{CLOSING}")))


PATTERNS = DocumentSettings(extract_by_patterns=True, custom_heading_patterns=(r"^# .*$", r"^##? .*$"))


def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(heading_documents(spark, sf_dir), PATTERNS)


def paged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = (F.col("turn") + 1).cast("string")
    return conversations(spark, sf_dir, F.concat(F.lit(f"\n{RULE}\nPDF PAGE "), page, F.lit(f"\n{RULE}\n"), F.col("text"), F.lit(f"\n\n{CLOSING}")))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A span for each word of a turn; page, block and line by turn and position, style by position."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", " ")).alias("at", "text"))
    font = F.element_at(F.array(*map(F.lit, ("Sans", "Sans-Bold", "Sans-Italic", "Sans-BoldItalic"))), (F.col("at") % 4 + 1).cast("int"))
    size = F.element_at(F.array(*map(F.lit, (10.0, 10.0, 12.0, 15.0, 18.0, 22.0))), (F.col("at") % 6 + 1).cast("int"))
    return rows.select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("document_id"), F.col("turn").cast("int").alias("page"),
        F.floor(F.col("at") / 50).cast("int").alias("block"), F.floor(F.col("at") / 10).cast("int").alias("line"),
        F.col("at").alias("span"), "text", font.alias("font"), size.alias("size"),
    )


# The same in SQL. Each constant is a list of common table expressions.

class Template(str):
    """SQL with one place, {0}; other braces are plain text."""

    def format(self, value: str) -> str:  # type: ignore[override]
        return self.replace("{0}", value)


FLAT = Template(r"regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace({0}, chr(13) || chr(10), ' '), chr(13), ' '), chr(10), ' '), '\r\n', ' '), '\r', ' '), '\n', ' '), ' +', ' ', 'g'), '^%s+|%s+$', '', 'g')" % (WS, WS))
TRIM = Template(r"regexp_replace({0}, '^%s+|%s+$', '', 'g')" % (WS, WS))

#: base(doc_ord, seq, title, content, level, parent, page) -> sec: size limit, length filter, ids, offsets.
SECTIONS = rf"""
cut(doc_ord, seq, title, level, parent, page, long_, k, chunk, rest) AS (
  SELECT doc_ord, seq, title, level, parent, page, length(content) > 1500, 0, '', content FROM base
  UNION ALL
  SELECT doc_ord, seq, title, level, parent, page, long_, k + 1,
         CASE WHEN length(rest) <= 1500 THEN rest ELSE {TRIM.format("rest[1:cut]")} END,
         CASE WHEN length(rest) <= 1500 THEN '' ELSE regexp_replace(rest[cut + 1:], '^{WS}+', '') END
  FROM (SELECT *, coalesce(nullif(length(regexp_extract(rest[1:1501], '(?s)^(.*\.){WS}', 1)), 0), 1500) AS cut FROM cut WHERE rest <> '')),
sec AS (
  SELECT doc_ord, CASE WHEN long_ THEN title || '.' || k ELSE title END AS title, CASE WHEN long_ THEN level + 1 ELSE level END AS heading_level,
         CASE WHEN long_ THEN title ELSE parent END AS parent_title, chunk AS content, page AS page_number,
         row_number() OVER (PARTITION BY doc_ord ORDER BY seq, k) - 1 AS ord,
         coalesce(sum(length(chunk)) OVER (PARTITION BY doc_ord ORDER BY seq, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset
  FROM cut WHERE k > 0 AND length(chunk) >= 30),
sections AS (
  SELECT *, 'section-' || (ord + 1) AS section_id, lower(content) AS content_lc, lower(title) AS title_lc, length(content) AS char_count,
         'section-' || lag(ord + 1) OVER d AS prev_section_id, 'section-' || lead(ord + 1) OVER d AS next_section_id
  FROM sec WINDOW d AS (PARTITION BY doc_ord ORDER BY ord))"""

#: Packed paragraphs of documents, as base.
DOCUMENTS = rf"""
lines AS (SELECT doc_id, {TRIM.format("line")} AS para, i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
para AS (SELECT doc_id, para, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i FROM lines WHERE para <> ''),
pack(doc_id, i, grp, cur) AS (
  SELECT doc_id, i, 1, para FROM para WHERE i = 1
  UNION ALL
  SELECT p.doc_id, p.i, CASE WHEN length(cur) + length(para) > 1500 THEN grp + 1 ELSE grp END,
         CASE WHEN length(cur) + length(para) > 1500 THEN para ELSE cur || chr(10) || chr(10) || para END
  FROM pack r JOIN para p ON p.doc_id = r.doc_id AND p.i = r.i + 1),
packed AS (SELECT doc_id, grp, arg_max(cur, i) AS body FROM pack GROUP BY doc_id, grp),
base AS (
  SELECT doc_id AS doc_ord, grp AS seq, 'Section ' || row_number() OVER (PARTITION BY doc_id ORDER BY grp) AS title,
         {FLAT.format("body")} AS content, 0 AS level, NULL::VARCHAR AS parent, 0 AS page
  FROM packed WHERE length(body) >= 30)"""

#: One section for each turn, as base.
BOLD = rf"""
base AS (
  SELECT conv_id AS doc_ord, turn AS seq, role || ' ' || turn AS title, {FLAT.format(f"text || chr(10) || '{CLOSING}'")} AS content,
         0 AS level, NULL::VARCHAR AS parent, 0 AS page
  FROM conversations)"""

#: Turns under headings of two levels, as base.
HEADINGS = rf"""
base AS (
  SELECT conv_id AS doc_ord, turn AS seq, role || ' ' || turn AS title, {FLAT.format(f"text || chr(10) || '{CLOSING}'")} AS content,
         1 + turn % 2 AS level,
         CASE WHEN turn % 2 = 1 THEN last_value(CASE WHEN turn % 2 = 0 THEN '# ' || role || ' ' || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) END AS parent,
         0 AS page
  FROM conversations)"""
