"""The cleaning pipeline over a text column, with settings for all documents or for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as t
from corpusloom.operators.lines import join_short_lines, normalize_line_breaks
from corpusloom.session import unused
from corpusloom.sources.settings import Cleaning

#: The steps in their order: switch, function, and whether it strips formatting.
STEPS = (
    ("clean_encoding", t.clean_encoding, False),
    ("remove_page_markers", t.remove_page_markers, False),
    ("strip_headers", t.strip_headers, True),
    ("strip_bold", t.strip_bold, True),
    ("strip_italic", t.strip_italic, True),
    ("normalize_line_breaks", normalize_line_breaks, False),
    ("join_short_lines", join_short_lines, False),
)


def clean(column: Column, settings: Cleaning = Cleaning()) -> Column:
    """Apply the steps that the settings switch on."""
    column = t.drop_bom(column)
    for name, step, formatting in STEPS:
        if getattr(settings, name) and (not formatting or settings.strips_formatting()):
            column = step(column)
    return column


def clean_documents(docs: DataFrame, settings: Cleaning = Cleaning(), own: DataFrame | None = None) -> DataFrame:
    """``docs`` with its text cleaned and the quality flag ``has_traces``.

    ``own`` has (stem, cleaning: struct of the switches): a document's own switches replace the global ones as a whole.
    A config table has a row for each configured document; Spark picks the join by its size.
    """
    if own is None:
        return docs.withColumn("text", clean(F.col("text"), settings)).withColumn("has_traces", t.has_encoding_traces(F.col("text")))
    mine, before = unused("own", docs.columns), unused("before", docs.columns)
    columns = docs.columns
    docs = docs.join(own.select("stem", F.col("cleaning").alias(mine)), "stem", "left").select(*columns, mine)
    text = t.drop_bom(F.col("text"))
    flag = lambda name: F.coalesce(F.col(f"{mine}.{name}"), F.lit(getattr(settings, name)))
    for name, step, formatting in STEPS:
        on = flag(name) & ~flag("preserve_markdown") if formatting else flag(name)
        docs = docs.withColumn(before, text).withColumn("text", F.when(on, step(F.col(before))).otherwise(F.col(before)))
        text = F.col("text")
    return docs.drop(before, mine).withColumn("has_traces", t.has_encoding_traces(F.col("text")))
