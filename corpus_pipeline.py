"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import language_id, ngram_join, pieces, secret_scan, source_mixing
from corpusloom.session import discard, prepare, settled

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


# All stages: an empty table gives an empty result; columns that an operator adds, under names that documents may have
# (lang_pred, score, spans, copy, ids, ...), replace those, and only the columns of documents go on.


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents whose language is undetermined (null or empty text, no letter); the others get the predicted
    language, whatever they declare, also where lang or doc_id is null. Equal code lengths go to the first name."""
    found = language_id.identify(docs, language_id.learn(docs)).where(F.col("lang_pred") != language_id.UNDETERMINED)
    return found.withColumn("lang", F.col("lang_pred")).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingles, similarity 0.8 or more.

    Rows go, not ids: the one with the smallest doc_id stays (null is largest; then the text's MD5, then the row's hash
    decide), and another text under the same id is judged by its own group. Texts without words are all kept."""
    return ngram_join.near_duplicates(docs, k=5, percent=80).select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret in the texts by a mark; no document goes. Null texts stay null with a null n_chars; repeated
    rows are redacted alike; overlapping secrets become one mark."""
    found = secret_scan.secret_scan(docs, secret_scan.learn(docs), replacement="[SECRET]")
    return found.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that all sources weigh the same, and shuffle them globally. A null source is a source; a null
    doc_id is replaced by the text's MD5 in the hash seed; rows that repeat an id get the same count."""
    return source_mixing.mix_sources(docs).select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every document into piece ids. A null text has null ids and 0 tokens, an empty one empty ids; repeated
    rows are encoded alike; texts of any length are encoded whole."""
    return pieces.encode(docs).select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids")


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix),
    ("sentencepiece", tokenize),
]

#: SQL can't express the models of the first, third and last stages; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's input and what it wrote on its way are removed when its result is written."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, settled(lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
