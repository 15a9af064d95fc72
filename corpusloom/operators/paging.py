"""Page filters over virtual pages of 2500 characters of a document's concatenated sections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.functions.text import PAGE_CHARS
from corpusloom.sources.settings import PageRange


def with_offsets(sections: DataFrame) -> DataFrame:
    """Add start_offset, the characters of the document's earlier sections, where the table lacks it."""
    if "start_offset" in sections.columns:
        return sections
    before = Window.partitionBy("doc_ord").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return sections.withColumn("start_offset", F.coalesce(F.sum(F.length("content")).over(before), F.lit(0)).cast("long"))


def page_filter(sections: DataFrame, pages: PageRange | None) -> DataFrame:
    """Sections that touch a listed page, else sections that overlap the range; all without a range.

    Sections made by ``segment`` carry their offsets, so this is a row filter without a shuffle.
    """
    if pages is None:
        return sections
    sections = with_offsets(sections)
    start, size = F.col("start_offset"), F.length("content")
    if pages.only:
        first, last = F.floor(start / PAGE_CHARS) + 1, F.ceil((start + size) / PAGE_CHARS)
        wanted = [F.lit(p).between(first, last) for p in sorted(set(pages.only))]
        keep = wanted[0]
        for w in wanted[1:]:
            keep |= w
        return sections.where(keep)
    keep = start + size > (pages.start - 1) * PAGE_CHARS
    return sections.where(keep if pages.end is None else keep & (start < pages.end * PAGE_CHARS))
