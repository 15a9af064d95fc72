"""Target-distribution importance resampling: hashed word runs from a streaming CRC ring, weights, Gumbel top scores."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import words
from corpusloom.operators.ranking import ranked
from corpusloom.session import prepare, stash, unused

#: Bytes of a text that are split into words at a time.
PIECE = 1 << 18


def _plain() -> bytes:
    """Each byte of a text: A-Z in lower case, word bytes as they are (digits, a-z, beyond ASCII), others as a blank."""
    kept = [*range(48, 58), *range(97, 123), *range(128, 256)]
    table = bytearray(b" " * 256)
    for b in kept:
        table[b] = b
    for b in range(65, 91):
        table[b] = b + 32
    return bytes(table)


PLAIN = _plain()


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a whole text, piece by piece; a word is never cut."""
    text = text.translate(PLAIN)
    start = 0
    while start < len(text):
        end = text.find(b" ", start + PIECE)
        end = len(text) if end < 0 else end
        if found := text[start:end].split():
            yield found
        start = end


class Ring:
    """CRC-32 of every run of 1 to n consecutive words, each joined by one blank, in one scan.

    The ring holds zlib's running state of the runs that began at the last n starts and are not yet n words long: each
    word extends all of them by a blank and itself and begins a new one. Words come in lists, so one call of ``map``
    extends all runs of a length; the states carried from list to list are one for each length.
    """

    def __init__(self, n: int) -> None:
        self.open: list[int | None] = [None] * n  # the state of the last run of 1, 2, ... words

    def extend(self, found: list[bytes]) -> np.ndarray:
        """The states of all runs that end in these words."""
        spaced = [b" " + w for w in found]
        states = list(map(zlib.crc32, found))
        every = [states]
        last, self.open[0] = self.open[0], states[-1]
        for k in range(1, len(self.open)):
            before = states[:-1] if last is None else [last, *states[:-1]]
            if not before:
                break
            states = list(map(zlib.crc32, spaced[-len(before) :], before))
            every.append(states)
            last, self.open[k] = self.open[k], states[-1]
        return np.fromiter(chain.from_iterable(every), np.uint32, sum(map(len, every)))


@dataclass(frozen=True)
class Features:
    """Runs of 1 to ``n`` words in ``buckets`` buckets."""

    n: int = 2
    buckets: int = 10_000

    def of(self, text: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """Words and buckets of a text, piece by piece."""
        ring = Ring(self.n)
        for found in pieces(text):
            yield len(found), ring.extend(found) % np.uint32(self.buckets)


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, offsets = words.buffer(batch["text"])
    return (data[a:b].tobytes() for a, b in zip(offsets, offsets[1:]))


def _counts(batches: Iterator[pa.RecordBatch], features: Features) -> Iterator[pa.RecordBatch]:
    total = np.zeros(features.buckets, np.int64)
    for batch in batches:
        for text in _texts(batch):
            for _, buckets in features.of(text):
                total += np.bincount(buckets, minlength=features.buckets)
    held = np.flatnonzero(total)
    yield pa.record_batch({"bucket": pa.array(held.astype(np.int32)), "n": pa.array(total[held])})


def counted(texts: DataFrame, features: Features) -> np.ndarray:
    """Features of all texts by bucket: one number a bucket comes to the driver."""
    found = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(partial(_counts, features=features), "bucket int, n long")
    table = found.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(features.buckets, np.int64)
    counts[table["bucket"].to_numpy()] = table["n"].to_numpy()
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed shares, rounded down."""
    buckets, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((b + 1.0) * (s + buckets) / ((a + 1.0) * (t + buckets)))) for a, b in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def _weighed(batches: Iterator[pa.RecordBatch], features: Features, gain: np.ndarray, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = np.zeros((3, batch.num_rows), np.int64)
        for row, text in enumerate(_texts(batch)):
            n_words = n = total = 0
            for count, buckets in features.of(text):
                n_words, n, total = n_words + count, n + len(buckets), total + int(gain[buckets].sum())
            out[:, row] = n_words, n, total // n if n else 0
        keep = [c for c in batch.schema.names if c != "text"]
        yield pa.record_batch([*(batch[c] for c in keep), *map(pa.array, out)], names=[*keep, *names])


def scored(docs: DataFrame, target: DataFrame, features: Features = Features(), seed: int = 7) -> DataFrame:
    """(doc_id, text_hash, n_words, n_features, weight, score) of each row of ``docs`` (doc_id, text); ``target`` has text."""
    spark = prepare(docs.sparkSession)
    text = F.col("text").cast("string")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    gain = spark.sparkContext.broadcast(gains(counted(docs, features), counted(target, features)))
    names = ("n_words", "n_features", "weight")
    schema = "doc_id long, text_hash long, n_words long, n_features long, weight long"
    found = docs.mapInArrow(lambda batches: _weighed(batches, features, gain.value, names), schema)
    seeded = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(seeded, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return found.withColumn("score", F.col("weight") + noise)


def _placed(docs: DataFrame, target: DataFrame, percent: int, min_words: int, features: Features, seed: int) -> DataFrame:
    """``scored`` with the rank of drawn rows. All rows are numbered, those with enough words first."""
    rows = scored(docs, target, features, seed).withColumn("enough", F.col("n_words") >= min_words)
    rows = stash(rows, "scores")  # dealing by range reads its input twice
    placed = ranked(rows, [F.desc("enough"), F.desc("score"), F.asc_nulls_last("doc_id"), "text_hash"], "rank", start=1)
    drawn = placed.where("enough").count() * percent // 100
    return placed.withColumn("rank", F.when(F.col("enough") & (F.col("rank") <= drawn), F.col("rank"))).drop("enough")


def importance_resampling(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, features: Features = Features(), seed: int = 7
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of ``docs`` (doc_id, text).

    Features are the runs of words that ``features`` says, hashed into buckets. A bucket's gain is the log ratio of its
    shares in ``target`` (text) and in ``docs``, smoothed by one, in thousandths; a document's weight is the mean gain
    of its features. Gumbel noise, seeded by ``seed`` and doc_id, is added, so that the highest scores are a sample
    without replacement by those weights. Of the documents with ``min_words`` words, ``percent`` percent are drawn and
    have a rank from 1 on. Counts, weights and ranks cover all rows and whole texts; ranks are numbered in ranges.

    Defined cases: a null or empty text, and one without words, has no features, weight 0 and no rank; a null doc_id
    seeds as empty text and ties go to it last; repeated rows are documents of their own with equal scores, numbered in
    any order; without target texts all gains come from smoothing; empty tables give an empty result; other columns are
    ignored.
    """
    return _placed(docs, target, percent, min_words, features, seed).drop("text_hash")


def resampled(
    docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, features: Features = Features(), seed: int = 7
) -> DataFrame:
    """The drawn rows of ``docs`` themselves, with all their columns. Rows that repeat a doc_id and text of a drawn row
    come with it; that is all that can exceed ``percent``."""
    drawn = _placed(docs, target, percent, min_words, features, seed).where("rank IS NOT NULL")
    taken, own = [], {}
    for name in ("doc_id", "text_hash"):
        own[name] = unused(name, [*docs.columns, *taken])
        taken.append(own[name])
    keys = drawn.select(*[F.col(a).alias(b) for a, b in own.items()]).distinct()
    same = docs["doc_id"].cast("long").eqNullSafe(keys[own["doc_id"]]) & (F.xxhash64(docs["text"].cast("string")) == keys[own["text_hash"]])
    return docs.join(keys, same, "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return importance_resampling(read("documents"), read("benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


SQL = r"""
WITH tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS tab),
texts AS (
  SELECT row_number() OVER () AS rid, doc_id, text, true AS own FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark),
w AS (
  SELECT rid, doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM texts),
f AS (SELECT rid, own, unnest(list_concat(words, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS f FROM w WHERE len(words) > 0),
n AS (SELECT rid, own, f, count(*) AS n FROM f GROUP BY ALL),
d AS (SELECT f, hex(encode(f)) AS hx FROM (SELECT DISTINCT f FROM n)),
b AS (
  SELECT f, xor(list_reduce(list_transform(range(length(hx) // 2), lambda k: ('0x' || substr(hx, 2 * k + 1, 2))::BIGINT),
                            lambda c, x: xor(tab[(xor(c, x) & 255) + 1], c >> 8), 4294967295), 4294967295) % 10000 AS bucket
  FROM d, tab),
c AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM n JOIN b USING (f) GROUP BY bucket),
tot AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM c),
g AS (SELECT bucket, floor(1000 * ln((t::DOUBLE + 1) * (s_all + 10000) / ((s::DOUBLE + 1) * (t_all + 10000)))) AS gain FROM c, tot),
u AS (SELECT rid, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight FROM n JOIN b USING (f) JOIN g USING (bucket) WHERE own GROUP BY rid),
v AS (
  SELECT rid, doc_id, len(words) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM w LEFT JOIN u USING (rid) WHERE own),
z AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296)))::BIGINT AS score FROM v),
r AS (SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM z WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank
FROM z LEFT JOIN r USING (rid)
"""
