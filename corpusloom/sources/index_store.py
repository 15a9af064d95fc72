"""The stored index: versioned tables that are updated by what has changed, and JSON for exchange."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions import text as t
from corpusloom.operators import navigate, postings, search
from corpusloom.operators.ranking import ranked
from corpusloom.operators.segment import SCHEMA, segment
from corpusloom.session import discard, stash
from corpusloom.sources.settings import DocumentSettings, to_json
from corpusloom.sources.versions import Draft, Store, Version, bucket_of, buckets_for

FILES = (
    "doc_key long, doc_ord long, document_id string, stem string, file_path string, mark long, document_type string, section_count int, "
    "total_characters long, summary string, has_traces boolean, first_section_id string, last_section_id string"
)
#: Columns of a file that stay as long as the file does.
CUT = ["section_count", "total_characters", "has_traces", "first_section_id", "last_section_id"]
#: Rows of a page of the tables that search reads by document or token, so that it skips the others.
PAGES = {"parquet.page.row.count.limit": "200", "parquet.block.size": str(16 << 20)}
#: Postings and n-grams are runs of near numbers and of tokens, which zstd makes small. A token seldom repeats in a file;
#: pages of 1000 rows take fewer calls of the compressor, and still are a small part of a bucket.
SMALL = {"compression": "zstd", "parquet.enable.dictionary#token": "false", "parquet.enable.dictionary#tokens": "false"}
TOKEN_PAGES = PAGES | {"parquet.page.row.count.limit": "1000"}
#: Documents up to which their keys are broadcast to the stored tables' rows; beyond, rows are shuffled.
KEYS = 4_000_000


def _sent(keys: DataFrame, n: int) -> DataFrame:
    return F.broadcast(keys) if n <= KEYS else keys


def _lean(sections: DataFrame) -> DataFrame:
    """Sections as they are stored: a lower-case text only where Spark's lower() gives another one."""
    for name, source in (("content_lc", "content"), ("title_lc", "title")):
        sections = sections.withColumn(name, F.when(~F.col(name).eqNullSafe(F.lower(source)), F.struct(F.col(name).alias("text"))))
    return sections


def _full(stored: DataFrame) -> DataFrame:
    """Sections from ``_lean`` ones; from an index of the older layout as they are."""
    for name, source in (("content_lc", "content"), ("title_lc", "title")):
        if stored.schema[name].dataType == T.StringType():
            continue
        stored = stored.withColumn(name, F.when(F.col(name).isNull(), F.lower(source)).otherwise(F.col(f"{name}.text")))
    return stored


@dataclass
class Index:
    """sections and files; a stored index has postings and n-grams of their tokens, too, and its own totals."""

    sections: DataFrame
    files: DataFrame
    postings: DataFrame | None = None
    grams: DataFrame | None = None
    facts: dict[str, Any] | None = None

    @property
    def totals(self) -> tuple[int, int]:
        """Sections and their characters."""
        if self.facts is not None:
            return self.facts["sections"], self.facts["characters"]
        return tuple(navigate.index_totals(self.sections).select("total_sections", "total_characters").first())

    @property
    def metadata(self) -> DataFrame:
        """One row: total_sections, total_characters, total_pages, parsed_at."""
        if self.facts is None:
            return navigate.index_totals(self.sections).withColumn("parsed_at", F.current_timestamp())
        n, chars = self.totals
        row = [(n, chars, -(-chars // t.PAGE_CHARS), datetime.fromisoformat(self.facts["parsed_at"]))]
        return self.sections.sparkSession.createDataFrame(row, "total_sections long, total_characters long, total_pages int, parsed_at timestamp")

    def search(self, query: str, document_id: str | None = None, limit: int = search.DEFAULT_LIMIT) -> DataFrame:
        if self.postings is None:
            return search.search(self.sections, query, document_id, limit)
        return search.search_index(self, query, document_id, limit)


def build_index(docs: DataFrame, settings: DocumentSettings = DocumentSettings(), own: DataFrame | None = None) -> Index:
    """Sections and files of ``docs`` (doc_ord, document_id, stem, file_path, text), not stored: both are computed when
    they are read."""
    sections = segment(docs, settings, own)
    return Index(sections, navigate.file_table(docs, sections))


def marked(docs: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """(doc_ord, document_id, stem, file_path, mark): the mark changes with a file's path, its modification time (its
    text, where there is none) and its own settings."""
    what = "modified" if "modified" in docs.columns else "text"
    rows = docs.select("doc_ord", "document_id", "stem", "file_path", F.xxhash64("file_path", what).alias("mark"))
    if own is None:
        return rows
    mine = own.select("stem", F.xxhash64("settings").alias("set"))
    return rows.join(mine, "stem", "left").withColumn("mark", F.xxhash64("mark", F.coalesce("set", F.lit(0)))).drop("set")


def load_index(spark: SparkSession, path: str) -> Index:
    """The published version of an index; it stays readable while the next one is written."""
    store = Store(spark, path)
    version = store.current()
    if version is None:
        raise FileNotFoundError(f"no index in {path}")
    return of_version(store, version)


def of_version(store: Store, version: Version) -> Index:
    files = store.read(version, "files")

    def placed(table: str, made: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Tables keep a file's key; its place by path differs from that once files have come or gone."""
        rows = made(store.read(version, table))
        if not version.facts["moved"]:
            return rows
        names = rows.columns
        places = _sent(files.select("doc_key", "doc_ord"), version.facts["documents"])
        return rows.withColumnRenamed("doc_ord", "doc_key").join(places, "doc_key").select(names)

    return Index(placed("sections", _full), files, placed("postings", postings.unpacked), postings.unpacked_grams(store.read(version, "grams")), version.facts)


def open_index(
    docs: DataFrame, path: str, settings: DocumentSettings = DocumentSettings(), own: list[tuple[str, str]] | DataFrame | None = None, rebuild: bool = False
) -> Index:
    """The stored index of ``docs`` (doc_ord, document_id, stem, file_path, text), brought up to date first.

    Paths are unique; ``own`` has (stem, settings). Only documents that are new or changed are cut.
    """
    spark = docs.sparkSession
    if own is not None and not isinstance(own, DataFrame):
        own = spark.createDataFrame(list(own), "stem string, settings string") if own else None

    def load(files: DataFrame) -> DataFrame:
        return docs.drop("doc_ord", "document_id", "stem").join(files, "file_path")

    return refreshed(spark, path, marked(docs, own), load, settings, own, to_json(settings), rebuild, whole=docs)


def refreshed(
    spark: SparkSession,
    path: str,
    listing: DataFrame,
    load: Callable[[DataFrame], DataFrame],
    settings: DocumentSettings = DocumentSettings(),
    own: DataFrame | None = None,
    context: str = "",
    rebuild: bool = False,
    texts: bool = False,
    more: Callable[[], dict[str, Any]] = dict,
    whole: DataFrame | None = None,
) -> Index:
    """The stored index after an update by what has changed.

    ``listing`` is ``marked``; ``load`` gives the documents (text, ...) of rows (doc_ord, document_id, stem, file_path)
    that are new or have another mark. Only these are read and cut. Buckets that hold a changed document are written
    anew, with the sections of their other documents as they were; all other buckets are shared with the version before.
    The table of files is narrow and written whole; totals are observed while it is. Another ``context`` (settings that
    hold for all documents) or ``rebuild`` cuts everything. With ``texts`` the documents are kept beside the sections.
    ``more`` gives further numbers for the version; ``whole`` has all documents with the listing's doc_ord, which are cut
    as they are where all are new.
    """
    store = Store(spark, path)
    before = store.current()
    old = before if before and not rebuild and before.facts["context"] == context and _same_layout(before) else None
    was = store.read(old, "files") if old else spark.createDataFrame([], FILES)
    state = stash(_compared(listing, was), "state")
    counts = {r["kind"]: r["n"] for r in state.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect()}
    moved = state.where("kind = 'same' AND doc_ord <> old_ord").limit(1).count()
    if old and not moved and set(counts) <= {"same"}:
        discard(state)
        return of_version(store, old)
    if old and counts.get("new"):
        top = was.agg(F.max("doc_key")).first()[0] or 0
        named = ranked(state.where("kind = 'new'").select("file_path"), ["file_path"], "new_key", top + 1)
        keyed = state.join(named, "file_path", "left").withColumn("doc_key", F.coalesce("doc_key", "new_key")).drop("new_key")
    else:
        keyed = state.withColumn("doc_key", F.coalesce("doc_key", "doc_ord"))
    buckets = old.buckets if old else buckets_for(sum(counts.values()))
    keyed = stash(keyed.withColumn("bucket", bucket_of(F.col("doc_key"), buckets)), "keyed")
    touched = keyed.where("kind <> 'same'")
    dirty = sorted(r["bucket"] for r in touched.select("bucket").distinct().collect())  # MOST numbers at most
    draft = store.draft(buckets)
    if dirty:
        docs = whole if whole is not None and not old else load(keyed.where("kind IN ('new', 'changed')").select(F.col("doc_key").alias("doc_ord"), "document_id", "stem", "file_path"))
        _cut(draft, old, dirty, keyed, docs, sum(counts.get(k, 0) for k in ("changed", "gone")), settings, own, texts)
    facts = _files(draft, old, dirty, keyed, texts)
    facts |= {"context": context, "parsed_at": datetime.now(timezone.utc).isoformat(), "changed": sum(n for k, n in counts.items() if k != "same"), "written": len(dirty)} | more()
    everything = list(range(before.buckets)) if before and not old else dirty
    version = draft.publish(before, everything, facts)
    discard(state)
    discard(keyed)
    return of_version(store, version)


def _same_layout(version: Version) -> bool:
    """Are postings and n-grams packed? An index with a row for each can be read, but is made anew by its next update."""
    return {"hits", "tokens"} <= {f["name"] for table in ("postings", "grams") for f in version.schemas[table]["fields"]}


def _compared(listing: DataFrame, was: DataFrame) -> DataFrame:
    """Each file of now or then, and whether it is new, changed, gone or the same."""
    then = was.select("file_path", "doc_key", F.col("doc_ord").alias("old_ord"), F.col("mark").alias("old_mark"), *CUT)
    both = listing.join(then, "file_path", "full_outer")
    kind = F.when(F.col("mark").isNull(), "gone").when(F.col("old_mark").isNull(), "new").when(F.col("mark") != F.col("old_mark"), "changed").otherwise("same")
    return both.withColumn("kind", kind)


def _cut(
    draft: Draft, old: Version | None, dirty: list[int], keyed: DataFrame, docs: DataFrame, leaving: int, settings: DocumentSettings, own: DataFrame | None, texts: bool
) -> None:
    """Write the buckets that change: what stays of them (all but ``leaving`` documents), and what the documents that are
    new or changed give. Postings and n-grams are made where the stored sections are read, without an exchange of them."""
    store, fresh = draft.store, keyed.where("kind IN ('new', 'changed')")
    left = _sent(keyed.where("kind IN ('changed', 'gone')").select(F.col("doc_key").alias("doc_ord")), leaving)
    bucket = bucket_of(F.col("doc_ord"), draft.version.buckets)

    def write(table: str, rows: DataFrame, order: list[str], **options: Any) -> None:
        if old:
            stay = store.read(old, table, dirty).join(left, "doc_ord", "left_anti")
            rows = rows.unionByName(stay.select(rows.columns))
        draft.write(table, rows.withColumn("bucket", bucket), order, **options)

    if texts:
        write("documents", docs, ["doc_ord"])
        docs = store.read(draft.version, "documents", dirty).join(fresh.select(F.col("doc_key").alias("doc_ord")), "doc_ord", "left_semi")
    write("sections", _lean(segment(docs, settings, own)), ["doc_ord", "ord"], **PAGES)
    found = _full(store.read(draft.version, "sections", dirty))
    draft.write("postings", postings.packed(found, bucket), ["token", "place"], dealt=True, **TOKEN_PAGES, **SMALL)
    draft.write("grams", postings.packed_grams(draft.written("postings")), ["gram"], dealt=True, **PAGES, **SMALL)


def _files(draft: Draft, old: Version | None, dirty: list[int], keyed: DataFrame, texts: bool) -> dict[str, Any]:
    """Write the table of files and give the totals that were observed meanwhile."""
    now = keyed.where("kind <> 'gone'")
    if dirty:
        sections = draft.store.read(draft.version, "sections", dirty)
        cut = sections.groupBy(F.col("doc_ord").alias("doc_key")).agg(
            F.count(F.lit(1)).cast("int").alias("section_count"), F.sum("char_count").alias("total_characters"),
            F.min_by("section_id", "ord").alias("first_section_id"), F.max_by("section_id", "ord").alias("last_section_id"),
        )
        if texts:
            flags = draft.store.read(draft.version, "documents", dirty).select(F.col("doc_ord").alias("doc_key"), "has_traces")
            cut = flags.join(cut, "doc_key", "left")
        else:
            cut = cut.withColumn("has_traces", F.lit(None).cast("boolean"))
        cut = cut.select("doc_key", F.struct(*CUT).alias("cut"))
        inside = F.col("bucket").isin(dirty) if len(dirty) < draft.version.buckets else F.lit(True)
        now = now.join(cut, "doc_key", "left")
        for name in CUT:
            now = now.withColumn(name, F.when(inside, F.col(f"cut.{name}")).otherwise(F.col(name)))
    number = lambda name, kind: F.coalesce(name, F.lit(0)).cast(kind).alias(name)
    files = now.select(
        "doc_key", "doc_ord", "document_id", "stem", "file_path", "mark", F.lit("Generic").alias("document_type"), number("section_count", "int"),
        number("total_characters", "long"), F.lit("").alias("summary"), "has_traces", "first_section_id", "last_section_id",
    )
    seen = Observation()
    files = files.observe(
        seen, F.count(F.lit(1)).alias("documents"), F.sum("section_count").alias("sections"), F.sum("total_characters").alias("characters"),
        F.count("has_traces").alias("cleaned"), F.count_if("has_traces").alias("with_traces"), F.count_if(F.col("doc_key") != F.col("doc_ord")).alias("moved"),
    )
    draft.whole("files", files)
    for table, kind in (("sections", SCHEMA), ("postings", postings.PACKED), ("grams", postings.PACKED_GRAMS)):
        if table not in draft.version.schemas and not old:  # nothing to cut: empty tables
            none = draft.store.spark.createDataFrame([], f"{kind}, bucket int")
            draft.write(table, _lean(none) if table == "sections" else none, [])
    return {k: v or 0 for k, v in seen.get.items()}


def export_json(index: Index, path: str) -> None:
    """One JSON object a line for each document, with its sections in order: no document is bound to the driver."""
    sections = index.sections.groupBy("doc_ord").agg(
        F.array_sort(F.collect_list(F.struct("ord", "section_id", "title", "content", "keywords", "summary", "heading_level", "parent_title", "char_count", "page_number"))).alias("sections")
    )
    index.files.join(sections, "doc_ord", "left").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """The exported sections again, one row each."""
    item = "ord int, section_id string, title string, content string, keywords array<string>, summary string, heading_level int, parent_title string, char_count int, page_number int"
    kinds = ", ".join(f"{x.split()[0]}:{x.split()[1]}" for x in item.split(", "))
    read = spark.read.schema(f"doc_ord long, document_id string, sections array<struct<{kinds}>>").json(path)
    return read.select("doc_ord", "document_id", F.explode("sections").alias("s")).select("doc_ord", "document_id", "s.*")
