"""Token counts by section: whole documents are encoded once and each token is attributed through its character span."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import prepare

RULES = ("most", "first", "last")


def default_vocabulary() -> tuple[str, str]:
    """Path and word pattern of the public byte-level vocabulary for many languages."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """An encoding without special tokens, and the bytes of each id."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    sizes[list(ranks.values())] = [len(x) for x in ranks]
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def line_starts(data: np.ndarray) -> np.ndarray:
    """Byte starts of the sections of a text: its lines, each with the newline that ends it; one if it is empty."""
    starts = np.concatenate([[0], np.flatnonzero(data == 10) + 1])
    return starts[:-1] if len(starts) > 1 and starts[-1] == len(data) else starts


def attribute(begin: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """The section of each token [begin, end), -1 for none, and whether it crosses a section's boundary.

    Sections [start, end) are disjoint and sorted; a token touches a section where they share a character.
    """
    first, last = np.searchsorted(ends, begin, "right"), np.searchsorted(starts, end, "left") - 1
    outside = last < first
    if not len(starts):
        return np.full(len(begin), -1), np.zeros(len(begin), bool)
    one = np.minimum(first, len(starts) - 1)
    crossing = ~outside & ((first != last) | (starts[one] > begin) | (ends[one] < end))
    out = np.where(outside, -1, last if rule == "last" else first)
    if rule == "most":
        for t in np.flatnonzero(crossing & (first != last)):
            some = slice(first[t], last[t] + 1)
            out[t] = first[t] + int(np.argmax(np.minimum(ends[some], end[t]) - np.maximum(starts[some], begin[t])))
    return out, crossing


def count_text(text: str, coder: tiktoken.Encoding, sizes: np.ndarray, rule: str, sections: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, ...]:
    """For each section (character starts and ends; default: the lines): start, end, tokens, how many of these cross a
    boundary; and as a last number the tokens in no section."""
    raw = np.frombuffer(text.encode(), np.uint8)
    ids = np.asarray(coder.encode_ordinary(text), np.int64)
    stops = np.cumsum(sizes[ids])
    character = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # characters begun before each byte
    begin, end = character[stops - sizes[ids] + 1] - 1, character[stops]
    if sections is None:
        starts = character[line_starts(raw)]
        ends = np.append(starts[1:], character[-1])
    else:
        starts, ends = sections
    full, n = np.flatnonzero(ends > starts), len(starts)
    section, crossing = attribute(begin, end, starts[full], ends[full], rule)
    section = np.append(full, -1)[section]
    tokens, crossed = np.bincount(section + 1, minlength=n + 1), np.bincount(section[crossing] + 1, minlength=n + 1)
    return starts, ends, tokens[1:], crossed[1:], int(tokens[0])


def token_counts(docs: DataFrame, rule: str = "most", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """One row for each document's line: doc_id, section, start_char, end_char, n_tokens, n_crossing.

    A document is encoded once as a whole; a token's characters are those that its bytes touch. A token that crosses a
    section boundary goes, by ``rule``, to the section with most of its characters (ties: the first of them), to the
    ``first`` section it touches or to the ``last``. So sections sum up to the whole document's tokens exactly.

    Defined cases: a null or empty text has one empty section without tokens; repeated rows are counted alike; a null
    doc_id stays null; other columns are ignored; an empty table gives an empty result.
    """
    count = _counter(rule, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [count(x or "")[:4] for x in batch["text"].to_pylist()]
            if not found:
                continue
            lengths = np.array([len(x[0]) for x in found])
            first = np.cumsum(lengths) - lengths
            start, end, tokens, crossed = (pa.array(np.concatenate(x), pa.int64()) for x in zip(*found))
            yield pa.record_batch(
                {
                    "doc_id": batch["doc_id"].take(pa.array(np.repeat(np.arange(len(found)), lengths))),
                    "section": pa.array((np.arange(lengths.sum()) - np.repeat(first, lengths)).astype(np.int32)),
                    "start_char": start,
                    "end_char": end,
                    "n_tokens": tokens,
                    "n_crossing": crossed,
                }
            )

    prepare(docs.sparkSession)
    schema = "doc_id long, section int, start_char long, end_char long, n_tokens long, n_crossing long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def _counter(rule: str, vocabulary: tuple[str, str] | None) -> Callable[..., tuple]:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    vocabulary = vocabulary or default_vocabulary()
    return lambda text, sections=None: count_text(text, *encoding(*vocabulary), rule, sections)


NAMED = "doc_id long, name string, start_char long, end_char long, n_tokens long, n_crossing long"


def _named(batches: Iterator[pa.RecordBatch], count: Callable[..., tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of NAMED from doc_id, text and parts (list of name, start, end)."""
    for batch in batches:
        rows = []
        for doc_id, text, parts in zip(*(batch[c].to_pylist() for c in ("doc_id", "text", "parts"))):
            text, kept, at = text or "", [], 0
            for name, start, end in sorted(((p["name"], p["start"], p["end"]) for p in parts or ()), key=lambda p: (p[1], p[2], p[0] or "")):
                at = max(at, min(start, len(text)))
                kept.append((name, at, at := max(at, min(end, len(text)))))
            starts, ends = (np.array([p[i] for p in kept], np.int64) for i in (1, 2))
            *found, outside = count(text, (starts, ends))
            rows += [(doc_id, name, *map(int, x)) for (name, _, _), *x in zip(kept, *found)]
            rows.append((doc_id, None, 0, len(text), outside, 0))
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = (pa.int64(), pa.string(), *[pa.int64()] * 4)
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["doc_id", "name", "start_char", "end_char", "n_tokens", "n_crossing"])


PARTS = "array<struct<name:string,start:bigint,end:bigint>>"


def token_counts_by_section(docs: DataFrame, sections: DataFrame, rule: str = "most", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """One row for each row of ``sections`` (doc_id, name, start, end in code points) whose document is in ``docs``, and one
    with a null name for each document's tokens outside all of them, as NAMED.

    Whole documents are encoded once; token spans meet the sections of their document by an interval join in one pass.
    A token that touches two sections goes to one by ``rule``; one that sticks out of its only section counts there, as
    crossing. Defined cases: sections are cut to the text, one that begins inside an earlier one begins where that ends;
    null starts or ends, negative or reversed ones give empty sections; sections of no document are left out; null doc_ids
    match nothing but their tokens are counted; repeated documents are counted each; other columns are ignored.
    """
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    start, end = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("start", "end"))
    part = F.struct(F.col("name").cast("string").alias("name"), F.greatest(start, F.lit(0)).alias("start"), end.alias("end"))
    parts = sections.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(part).alias("parts"))  # of one document
    joined = docs.join(parts, "doc_id", "left").select("doc_id", "text", F.col("parts").cast(PARTS).alias("parts"))
    count = _counter(rule, vocabulary)
    return joined.mapInArrow(lambda batches: _named(batches, count), NAMED)


def token_counts_by_field(docs: DataFrame, fields: list[str], rule: str = "most", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """One row for each document and text column of ``fields``, and one with a null name for the newlines between them.

    The columns, joined by newlines, are the document that is encoded once. Null and empty columns are empty sections.
    """
    prepare(docs.sparkSession)
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    parts, at = [], F.lit(0).cast("long")
    for c, text in zip(fields, texts):
        end = at + F.length(text)
        parts.append(F.struct(F.lit(c).alias("name"), at.alias("start"), end.alias("end")))
        at = end + 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat_ws("\n", *texts).alias("text"), F.array(*parts).cast(PARTS).alias("parts"))
    count = _counter(rule, vocabulary)
    return rows.mapInArrow(lambda batches: _named(batches, count), NAMED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
