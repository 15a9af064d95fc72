"""Finding hashes that occur twice or more in the whole corpus, without a row for each hash.

Documents are dealt into blocks of bounded text. Each block sends its distinct 64-bit hashes, as one packed segment for
each hash range ("bucket"), to the task that counts that range; a bucket answers each block with one bit for each hash.
Blocks then pick up their bits in a cogroup, in the same order. What repeats inside one block the block knows itself, so
a hash that a third of all documents share reaches its bucket once for each block, as a few bytes, and is counted there
by a sort: there are no pairs and no lists.

Segments may carry some bytes of each hash only: then the answer proposes candidates. Where that isn't enough, a second
pass confirms them by an independent 64-bit hash, which only candidates send.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import stash

#: Text of one block, and hashes of one bucket, that a Python worker holds at a time.
BLOCK_BYTES, BUCKET_HASHES = 4 << 20, 1_500_000
#: Hash ranges up to which blocks send to them directly, and the factor between coarse and fine ranges beyond.
FAN = 1024
#: Bytes that one task of an exchange reads, where the session's number of partitions would give more.
TASK_BYTES = 64 << 20


#: Copies of a row that one task makes.
SPAN = 1024


@dataclass(frozen=True)
class Rows:
    """Different rows (doc_id, text, copies) of a table, their UTF-8 bytes, and how often a row occurs at most."""

    docs: DataFrame
    bytes: int
    most: int

    def dealt(self) -> DataFrame:
        """Add ``block``: rows are dealt by a hash of id and text, so neither a hot source nor copies of a text under
        different ids meet in one block; rows that repeat both are one row here."""
        n = max(1, math.ceil(self.bytes / BLOCK_BYTES))
        return self.docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int"))

    def expanded(self, result: DataFrame) -> DataFrame:
        """``result`` (copies, ...) with each row as often as it says. Rows of many copies go through an exchange in
        spans, so that no task makes all copies of a row."""
        if self.most > SPAN:
            spans = result.withColumn("span", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {SPAN}"))))
            result = spans.repartition(*spans.columns).withColumn("copies", F.least(F.col("copies") - F.col("span") * SPAN, F.lit(SPAN))).drop("span")
        if self.most > 1:
            result = result.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
        return result.drop("copies")


def different(docs: DataFrame) -> Rows:
    """The different rows of ``docs`` (doc_id, text). One scan tells whether any row is repeated; where one is, rows are
    grouped, with partial counts before the exchange. One number each comes to the driver."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = docs.groupBy(F.xxhash64("doc_id", "text").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("size"))
    total, most = keyed.agg(F.sum("size"), F.max("n")).first()
    if (most or 0) > 1:
        docs = docs.groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    else:
        docs = docs.withColumn("copies", F.lit(1).cast("long"))
    return Rows(docs, int(total or 0), int(most or 0))


def in_order(table: pa.Table) -> pa.Table:
    """A block's rows in an order that does not depend on how they arrived; a recomputed task gets the same."""
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")])


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def dealt(df: DataFrame, total_bytes: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many partitions as its bytes need; up to the session's number Spark deals itself."""
    wanted = math.ceil(total_bytes / TASK_BYTES)
    return df.repartition(wanted, *keys) if wanted > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts the hashes, and which of the sorted ones are the first of their value."""
    order = np.argsort(hashes)
    fresh = np.ones(len(hashes), bool)
    fresh[1:] = hashes[order[1:]] != hashes[order[:-1]]
    return order, fresh


def pack(hashes: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each hash, as one row of bytes each."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def unpack(packed: list[pa.Scalar], width: int) -> tuple[np.ndarray, np.ndarray]:
    """All values of packed segments one after the other, and the n+1 offsets of the segments."""
    at = np.cumsum([0, *(len(x.as_buffer()) // width for x in packed)])
    out = np.zeros((int(at[-1]), 8), np.uint8)
    for x, a, b in zip(packed, at, at[1:]):
        out[a:b, :width] = np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, width)
    return out.view("<u8").ravel().astype(np.uint64, copy=False), at


def segments(block: int, hashes: np.ndarray, buckets: int, width: int) -> pa.Table:
    order, fresh = distinct(hashes)
    ranked = hashes[order[fresh]]  # by bucket, too
    edges = np.searchsorted(bucket_of(ranked, buckets), np.arange(buckets + 1))
    packed = pack(ranked, width)
    full = np.flatnonzero(np.diff(edges))
    return pa.table(
        {
            "bucket": pa.array(full.astype(np.int32)),
            "block": pa.array(np.full(len(full), block, np.int32)),
            "hashes": pa.array([packed[edges[b] : edges[b + 1]].tobytes() for b in full], pa.binary()),
        }
    )


def count_bucket(table: pa.Table, width: int, keys: tuple[str, ...]) -> pa.Table:
    """For each segment, named by ``keys``, a bit for each hash: does it occur anywhere else?"""
    every, at = unpack(list(table["hashes"]), width)
    order, fresh = distinct(every)
    same = np.append(~fresh, False)
    twice = np.empty(len(every), bool)
    twice[order] = same[:-1] | same[1:]
    bits = pa.array([np.packbits(twice[a:b]).tobytes() for a, b in zip(at, at[1:])], pa.binary())
    return pa.table({**{k: table[k] for k in keys}, "bits": bits})


def fine_order(table: pa.Table, width: int) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The segments of one share of a bucket by block, all their hashes, the order that sorts these by fine bucket."""
    table = table.sort_by("block")
    every, at = unpack(list(table["hashes"]), width)
    fine = (every & np.uint64(0xFFFFFFFF)) * np.uint64(FAN) >> np.uint64(32)
    return table, every, at, fine, np.argsort(fine, kind="stable")


def spread(table: pa.Table, width: int) -> pa.Table:
    """One share of a bucket cut into its fine buckets."""
    table, every, _, fine, order = fine_order(table, width)
    edges = np.searchsorted(fine[order], np.arange(FAN + 1))
    full, packed = np.flatnonzero(np.diff(edges)), pack(every[order], width)
    fill = lambda name: pa.array(np.full(len(full), table[name][0].as_py(), np.int32))
    cut = pa.array([packed[edges[f] : edges[f + 1]].tobytes() for f in full], pa.binary())
    return pa.table({"bucket": fill("bucket"), "fine": pa.array(full.astype(np.int32)), "share": fill("share"), "hashes": cut})


def gather(table: pa.Table, bits: pa.Table, width: int) -> pa.Table:
    """Undo ``spread``: bits for each segment of the share."""
    table, every, at, fine, order = fine_order(table, width)
    sizes = np.bincount(fine.astype(np.int64), minlength=FAN)
    have = dict(zip(bits["fine"].to_pylist(), bits["bits"]))
    flags = [np.unpackbits(np.frombuffer(have[f].as_buffer(), np.uint8), count=sizes[f]) for f in np.flatnonzero(sizes)]
    twice = np.empty(len(every), bool)
    twice[order] = np.concatenate(flags).astype(bool)
    packed = pa.array([np.packbits(twice[a:b]).tobytes() for a, b in zip(at, at[1:])], pa.binary())
    return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": packed})


def answers(sent: DataFrame, buckets: int, width: int, sent_bytes: int) -> DataFrame:
    """(block, bucket, bits) for each segment (bucket, block, hashes), whose ranges are ``coarse(buckets)``.

    Up to FAN ranges are counted as they are. With more, a block's segments would come down to single hashes, so ranges
    are FAN times as wide; the segments of a range meet in FAN shares of the blocks, which deal them on, packed again,
    to the range's FAN fine buckets. A task then holds about as many hashes as it does without that step.
    """
    if buckets <= FAN:
        keys = ("block", "bucket")
        counted = dealt(sent, sent_bytes, "bucket").groupBy("bucket")
        return counted.applyInArrow(lambda t: count_bucket(t, width, keys), "block int, bucket int, bits binary")
    sent = dealt(sent.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(FAN)).cast("int")), sent_bytes, "bucket", "share")
    fine = sent.groupBy("bucket", "share").applyInArrow(lambda t: spread(t, width), "bucket int, fine int, share int, hashes binary")
    keys = ("bucket", "share", "fine")
    counted = dealt(fine, sent_bytes, "bucket", "fine").groupBy("bucket", "fine").applyInArrow(
        lambda t: count_bucket(t, width, keys), "bucket int, share int, fine int, bits binary"
    )
    counted = dealt(counted, sent_bytes, "bucket", "share")
    return sent.groupBy("bucket", "share").cogroup(counted.groupBy("bucket", "share")).applyInArrow(
        lambda t, b: gather(t, b, width), "block int, bucket int, bits binary"
    )


def coarse(buckets: int) -> int:
    return buckets if buckets <= FAN else math.ceil(buckets / FAN)


def repeated(bits: pa.Table, hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Undo ``segments``: a flag for each of the block's hashes, in its own order; what the block itself repeats has one."""
    order, fresh = distinct(hashes)
    sizes = np.bincount(bucket_of(hashes[order[fresh]], buckets), minlength=buckets)
    have = dict(zip(bits["bucket"].to_pylist(), bits["bits"]))
    flags = [np.unpackbits(np.frombuffer(have[b].as_buffer(), np.uint8), count=sizes[b]) for b in np.flatnonzero(sizes)]
    elsewhere = np.concatenate([np.zeros(0, np.uint8), *flags]).astype(bool)
    group = np.cumsum(fresh) - 1
    out = np.zeros(len(hashes), bool)
    out[order] = (elsewhere | (np.bincount(group, minlength=len(elsewhere)) > 1))[group]
    return out


def with_repeats(
    blocks: DataFrame,
    hashes_of: Callable[[pa.Table, int], list[np.ndarray]],
    finish: Callable[[pa.Table, np.ndarray], pa.Table],
    schema: str,
    total_bytes: int,
    total_hashes: int,
    width: int,
    confirm: bool = False,
) -> DataFrame:
    """``finish(rows of a block, flag for each hash of the block)`` for every block.

    ``hashes_of(rows, 1)`` gives one array of 64-bit hashes, ``hashes_of(rows, 2)`` a second, independent one beside it.
    ``width`` bytes of each hash are compared inside its range of BUCKET_HASHES or so: at 4, one in 3000 hashes that
    occur once is flagged too, at 5 one in 700,000. That will do for hashes that only propose candidates. With
    ``confirm``, the flagged ones are counted again by their second hash, whole: a false flag then needs two chances of
    which one has 2**-64 for each candidate there is.

    ``hashes_of`` runs in every pass; that costs less than keeping the hashes between them. The answers to the first
    pass, some bits a hash, are written where a second one follows, so that its segments' files can go.
    """
    wanted = max(1, math.ceil(total_hashes / BUCKET_HASHES))
    buckets = coarse(wanted)
    blocks = dealt(blocks, total_bytes, "block")
    kind = "bucket int, block int, hashes binary"

    def send(table: pa.Table) -> pa.Table:
        return segments(table["block"][0].as_py(), hashes_of(in_order(table), 1)[0], buckets, width)

    def send_again(rows: pa.Table, bits: pa.Table) -> pa.Table:
        rows = in_order(rows)
        first, second = hashes_of(rows, 2)
        return segments(rows["block"][0].as_py(), second[repeated(bits, first, buckets)], buckets, 8)

    def answer(rows: pa.Table, bits: pa.Table) -> pa.Table:
        rows = in_order(rows)
        return finish(rows, repeated(bits, hashes_of(rows, 1)[0], buckets))

    def answer_again(rows: pa.Table, bits: pa.Table) -> pa.Table:
        rows, last = in_order(rows), bits["last"].to_numpy()
        first, second = hashes_of(rows, 2)
        at = np.flatnonzero(repeated(bits.filter(pa.array(~last)), first, buckets))
        flags = np.zeros(len(first), bool)
        flags[at[repeated(bits.filter(pa.array(last)), second[at], buckets)]] = True
        return finish(rows, flags)

    sent = blocks.groupBy("block").applyInArrow(send, kind)
    bits = answers(sent, wanted, width, total_hashes * width)
    if not confirm:
        return blocks.groupBy("block").cogroup(dealt(bits, total_bytes, "block").groupBy("block")).applyInArrow(answer, schema)
    bits = stash(bits, "bits")
    sent = blocks.groupBy("block").cogroup(dealt(bits, total_bytes, "block").groupBy("block")).applyInArrow(send_again, kind)
    both = bits.withColumn("last", F.lit(False)).unionByName(answers(sent, wanted, 8, total_hashes * 8).withColumn("last", F.lit(True)))
    return blocks.groupBy("block").cogroup(dealt(both, total_bytes, "block").groupBy("block")).applyInArrow(answer_again, schema)
