"""A data folder from raw files to a fresh index: ``raw`` is converted, ``documents`` are cleaned, cut and indexed."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.cleaning import clean_documents
from corpusloom.session import discard, stash
from corpusloom.sources import files
from corpusloom.sources.index_store import Index, marked, refreshed
from corpusloom.sources.settings import Cleaning, DocumentSettings, SettingsFolder, cleaning_table, to_json
from corpusloom.sources.versions import Store, bucket_of, buckets_for

FOLDERS = ("documents", "raw", "config", "index")
CONVERTED = "file_path string, stem string, modified timestamp, text string, error string, converted timestamp"
KINDS = (*files.TEXT_KINDS, *files.HTML_KINDS, "pdf")
#: Files up to which a refresh asks for them by name, so that the others are not opened.
FEW = 1000


def preprocess_folder(spark: SparkSession, source: str, target: str, settings: Cleaning = Cleaning(), own: DataFrame | None = None) -> DataFrame:
    """Clean all ``*.txt`` files of a folder into a new table of (file_path, stem, ..., text, has_traces)."""
    files.write_texts(clean_documents(files.scan_texts(spark, source), settings, own), target)
    return spark.read.parquet(target)


class Workspace:
    """``documents`` (texts), ``raw`` (files to convert), ``config`` (settings) and ``index`` (all tables) of one root.

    All tables are versioned: ``index/converted`` holds the last conversion of each raw file, ``index`` itself the cleaned
    texts, the sections and what search reads. Paths may be any that Spark reads; settings are a local folder.
    """

    def __init__(self, spark: SparkSession, root: str, config: str | None = None, documents: str | None = None, index: str | None = None) -> None:
        self.spark = spark
        self.documents_path, self.raw_path, self.config_path, self.index_path = (
            given or f"{root.rstrip('/')}/{name}" for name, given in zip(FOLDERS, (documents, None, config, index))
        )
        self.settings = SettingsFolder(self.config_path)
        self.store = Store(spark, self.index_path)
        self.conversions = Store(spark, f"{self.index_path}/converted")

    def scaffold(self) -> None:
        """Make the folders that are missing."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in (self.documents_path, self.raw_path, self.index_path):
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).mkdirs(target)

    def converted(self) -> DataFrame:
        """The last conversion of each raw file; errors are rows with a null text."""
        version = self.conversions.current()
        return self.conversions.read(version, "texts") if version else self.spark.createDataFrame([], CONVERTED)

    def convert(self) -> None:
        """Convert raw files that are new, or changed since they were converted, and drop those that are gone: the buckets
        that hold such files are written anew."""
        version = self.conversions.current()
        raw = files.scan_raw(self.spark, self.raw_path).where(F.col("extension").isin(*KINDS))
        was = self.converted().select("file_path", "converted")
        both = raw.select("file_path", "modified").join(was, "file_path", "full_outer")
        kind = F.when(F.col("modified").isNull(), "gone").when(F.col("converted").isNull() | (F.col("converted") < F.col("modified")), "stale").otherwise("same")
        state = stash(both.select("file_path", kind.alias("kind")), "raw")
        buckets = version.buckets if version else buckets_for(state.count())
        bucket = bucket_of(F.col("file_path"), buckets)
        dirty = sorted(r["bucket"] for r in state.where("kind <> 'same'").select(bucket.alias("bucket")).distinct().collect())  # a number a bucket
        if dirty:
            stale = raw.join(state.where("kind = 'stale'").select("file_path"), "file_path", "left_semi")
            rows = files.convert_raw(stale).withColumn("converted", F.greatest(F.current_timestamp(), F.col("modified")))
            if version:
                stay = self.conversions.read(version, "texts", dirty)
                rows = rows.unionByName(stay.join(state.where("kind = 'same'").select("file_path"), "file_path", "left_semi"))
            draft, seen = self.conversions.draft(buckets), Observation()
            rows = rows.observe(seen, F.count("text").alias("converted"), F.count("error").alias("failed"))
            draft.write("texts", rows.withColumn("bucket", bucket), ["file_path"])
            # totals: what was, less what the buckets held, and what they hold now
            gone = self._totals(dirty) if version else {"converted": 0, "failed": 0}
            had = version.facts if version else {"converted": 0, "failed": 0}
            draft.publish(version, dirty, {k: had[k] - gone[k] + (seen.get[k] or 0) for k in had})
        discard(state)

    def _totals(self, buckets: list[int]) -> dict[str, int]:
        held = self.conversions.read(self.conversions.current(), "texts", buckets)
        return held.agg(F.count("text").alias("converted"), F.count("error").alias("failed")).first().asDict()

    def listing(self) -> DataFrame:
        """Texts of ``documents`` and converted raw files, by path; nothing is read of them. Of one stem the newest counts,
        and a text before a raw file."""
        texts = files.list_texts(self.spark, self.documents_path).select("file_path", "stem", "modified", F.lit(True).alias("own"))
        made = self.converted().where("error IS NULL").select("file_path", "stem", "modified", F.lit(False).alias("own"))
        every = texts.unionByName(made)
        newest = every.groupBy("stem").agg(F.max(F.struct("modified", "own", "file_path")).alias("last"))
        return files.ordered(newest.select("stem", "last.file_path", "last.modified", "last.own"))

    def errors(self) -> DataFrame:
        return self.converted().where("error IS NOT NULL").select("file_path", "error")

    def refresh(self, rebuild: bool = False) -> Index:
        """Convert what is stale; clean, cut and store what has changed since the index was stored, or all of it if
        settings for all documents have. Broken settings of a document are left out (see ``settings_errors``)."""
        engine, cleaning, settings = self.settings.engine(), self.settings.cleaning(), DocumentSettings()
        own = self.settings.table(self.spark).where("error IS NULL").drop("error")
        self.convert()
        listing = stash(self.listing(), "listing")

        def load(wanted: DataFrame) -> DataFrame:
            docs = self._texts(wanted.join(listing.select("file_path", "own"), "file_path"))
            if engine.enable_unified_pipeline:
                return clean_documents(docs, cleaning, cleaning_table(own))
            return docs.withColumn("has_traces", F.lit(None).cast("boolean"))

        context = "\n".join(map(to_json, (engine, cleaning, settings)))
        try:
            return refreshed(self.spark, self.index_path, marked(listing, own), load, settings, own, context, rebuild, texts=True)
        finally:
            discard(listing)

    def _texts(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (file_path, own, ...) with their texts: files by name where they are few."""
        few = [r["file_path"] for r in wanted.where("own").select("file_path").limit(FEW + 1).collect()]
        read = files.read_texts(self.spark, self.documents_path, few if len(few) <= FEW else None)
        own = wanted.where("own").join(read.select("file_path", "text"), "file_path")
        made = wanted.where("NOT own").join(self.converted().select("file_path", "text"), "file_path")
        return own.unionByName(made).drop("own")

    def settings_errors(self) -> DataFrame:
        """(stem, error) of documents whose own settings can't be used."""
        return self.settings.table(self.spark).where("error IS NOT NULL").select("stem", "error")

    def documents(self) -> DataFrame:
        """The cleaned texts that the index was made from."""
        return self.store.read(self.store.current(), "documents")

    def counters(self) -> dict[str, Any]:
        """Documents, how many of these were cleaned and still hold traces of wrong decoding, raw files converted and
        failed: numbers that were observed while the tables were written. No table is read."""
        index, made = self.store.current(), self.conversions.current()
        found = {k: index.facts[k] if index else 0 for k in ("documents", "cleaned", "with_traces")}
        return found | {k: made.facts[k] if made else 0 for k in ("converted", "failed")}
