"""From PDF spans (text, font and size by page, block and line) to markdown text with page markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.chars import WIDE_SPACE
from corpusloom.functions.text import sub, trim_space

SPANS = "document_id string, page int, block int, line int, span int, text string, font string, size double"
# Heading sizes as multiples of the base size, the size of a page without text, the marker's rule.
HEADING_RATIOS = [(2.2, 1), (1.8, 2), (1.5, 3)]
DEFAULT_SIZE = 12.0
RULE = "=" * 80


def is_bold(font: Column) -> Column:
    return F.lower(font).contains("bold") | F.lower(font).contains("bd")


def is_italic(font: Column) -> Column:
    name = F.lower(font)
    return name.contains("italic") | name.contains("it") | name.contains("oblique")


def heading_level(size: Column, base: Column) -> Column:
    level = F.lit(0)
    for ratio, n in reversed(HEADING_RATIOS):
        level = F.when(size >= base * ratio, n).otherwise(level)
    return level


def span_markdown(text: Column, font: Column, size: Column, base: Column) -> Column:
    """A heading mark wins over bold and italic; a blank span stays as it is."""
    level, bold, italic = heading_level(size, base), is_bold(font), is_italic(font)
    wrapped = lambda mark: F.concat(F.lit(mark), text, F.lit(mark))
    styled = F.when(bold & italic, wrapped("***")).when(bold, wrapped("**")).when(italic, wrapped("_")).otherwise(text)
    headed = F.when(level > 0, F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).otherwise(styled)
    return F.when(trim_space(text, WIDE_SPACE) == "", text).otherwise(headed)


def base_sizes(spans: DataFrame) -> DataFrame:
    """Upper median of the sizes on each document's first page; 12 where it has no text."""
    sizes = F.array_sort(F.collect_list(F.when(F.col("page") == 0, F.col("size"))))
    middle = F.try_element_at(sizes, F.floor(F.size(sizes) / 2).cast("int") + 1)
    return spans.groupBy("document_id").agg(F.coalesce(middle, F.lit(DEFAULT_SIZE)).alias("base_size"))


def lines(spans: DataFrame) -> DataFrame:
    """Markdown lines: formatted non-blank spans joined by a blank."""
    sized = spans.join(base_sizes(spans), "document_id")
    text = trim_space(F.col("text"), WIDE_SPACE)
    marked = sized.where(text != "").withColumn("marked", span_markdown(text, F.col("font"), F.col("size"), F.col("base_size")))
    parts = F.array_sort(F.collect_list(F.struct("span", "marked")))
    return marked.groupBy("document_id", "page", "block", "line").agg(F.array_join(F.transform(parts, lambda p: p["marked"]), " ").alias("text"))


def clean_page(c: Column) -> Column:
    """Trim lines, drop those of one to four digits only, leave one blank line between parts."""
    kept = F.filter(F.transform(F.split(c, "\n"), lambda x: trim_space(x, WIDE_SPACE)), lambda x: ~x.rlike(r"\A\p{Nd}{1,4}\z"))
    return trim_space(sub(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), WIDE_SPACE)


def pages(spans: DataFrame) -> DataFrame:
    """(document_id, page, text): a page's lines in order, cleaned."""
    parts = F.array_sort(F.collect_list(F.struct("block", "line", "text")))
    text = F.array_join(F.transform(parts, lambda p: p["text"]), "\n")
    found = lines(spans).groupBy("document_id", "page").agg(text.alias("text"))
    every = spans.select("document_id", "page").distinct()
    return every.join(found, ["document_id", "page"], "left").withColumn("text", clean_page(F.coalesce("text", F.lit(""))))


def page_counts(spans: DataFrame) -> DataFrame:
    return spans.groupBy("document_id").agg((F.max("page") + 1).cast("int").alias("pages"))


def marked_text(pages_: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """(document_id, text): pages ``start`` to ``end`` (counted from 0; none or 0: the last) in order, each after a marker with its number."""
    if end:
        pages_ = pages_.where(F.col("page") <= end)
    marker = F.concat(F.lit(f"\n{RULE}\nPDF PAGE "), (F.col("page") + 1).cast("string"), F.lit(f"\n{RULE}\n"), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("page", marker.alias("text"))))
    return pages_.where(F.col("page") >= start).groupBy("document_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("text"))
