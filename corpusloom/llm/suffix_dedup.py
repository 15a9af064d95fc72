"""Suffix-array dedup: remove bytes covered by a 50-byte string that also starts in a document with a smaller doc_id.

Suffixes of whole documents can't be sorted together on one machine, and a column-wise construction takes a round for
each symbol of its longest string. So the windows of the corpus are dealt by content first: each window's anchor is the
least of the hashes of its ANCHOR-byte strings, and neighbouring windows of one anchor travel as one short string. Equal
windows have equal anchors, so they meet in one collection, however far apart they stand. Each collection's suffix array
is built column by column (``suffix_array``); windows next to each other in it that share 50 symbols are the same string.

* Anchors that occur once in the corpus have windows that do: these strings stay at home.
* Strings that hold a very frequent passage and something else would all have an anchor in that passage. So hashes are
  counted in 2**SLOT_BITS slots first, and those of crowded slots are taken only where a window has no other.
* A block of documents sends each different string once, with its smallest doc_id; equal strings of several blocks are
  inserted once. A string that is alone with its anchor shares no window with another and is not inserted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import blocks, words
from corpusloom.llm.suffix_array import Collection
from corpusloom.session import discard, prepare, stash

U = np.uint64
WINDOW, ANCHOR = 50, 24
#: Slots in which anchors are counted, and times the mean from which a slot is crowded.
SLOT_BITS, CROWDED = 18, 4
#: Bytes of strings in one bucket of anchors, and of one collection that is built at a time.
BUCKET_BYTES, COLLECTION_BYTES = 8 << 20, 1 << 20
#: A missing doc_id counts as the largest.
LAST = np.iinfo(np.int64).max
STRINGS_AT_ONCE = 1 << 15


def _pieces(offsets: np.ndarray, window: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, end, document edges inside): parts of the texts that hold each window once; long documents are cut."""
    for i, j in words.spans_of_documents(offsets):
        low, high, step = int(offsets[i]), int(offsets[j]), 2 * words.PIECE
        if j == i + 1 and high - low > step + window:
            for a in range(low, high - window + 1, step):
                b = min(a + step + window - 1, high)
                yield a, b, np.array([a, b])
        else:
            yield low, high, offsets[i : j + 1]


def _hashes(part: np.ndarray, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of the bytes' hash, and a hash of each string of ``anchor`` bytes."""
    sums = np.zeros(len(part) + 1, U)
    np.cumsum(words.BYTE_VALUE[part] * words.powers(words.BASE, len(part)), out=sums[1:])
    n = max(len(part) - anchor + 1, 0)
    return sums, words.mix((sums[anchor:] - sums[:n]) * words.powers(words.BASE_INVERSE, n)) if n else np.zeros(0, U)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U(64 - SLOT_BITS)).astype(np.int64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbouring values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


@dataclass
class Runs:
    """Runs of neighbouring windows of one anchor: first byte, number of windows, the anchor's hash, the string's hash."""

    start: np.ndarray
    count: np.ndarray
    key: np.ndarray
    hash: np.ndarray


def runs_of(data: np.ndarray, offsets: np.ndarray, window: int, anchor: int, crowded: np.ndarray) -> Runs:
    width, out = window - anchor + 1, []
    for low, high, edges in _pieces(offsets, window):
        if high - low < window:
            continue
        sums, hashes = _hashes(data[low:high], anchor)
        value = (hashes >> U(1)) | (crowded[_slots(hashes)].astype(U) << U(63))
        value = _least(value, width)
        outside = np.zeros(high - low + 1, np.int32)
        ends = edges[1:] - low
        np.add.at(outside, np.maximum(edges[:-1] - low, ends - window + 1), 1)
        np.add.at(outside, ends, -1)
        at = np.flatnonzero(np.cumsum(outside)[: len(value)] == 0)
        if not len(at):
            continue
        value = value[at]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) != 1) | (value[1:] != value[:-1])
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(at)))
        # periodic text has one anchor for long; strings stay short all the same
        cut = -(-size // width)
        which = np.repeat(np.arange(len(first)), cut)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(cut) - cut, cut)
        start, count = at[first[which]] + nth * width, np.minimum(width, size[which] - nth * width)
        length = count + window - 1
        whole = words.mix((sums[start + length] - sums[start]) * words.powers(words.BASE_INVERSE, len(sums))[start] + length.astype(U))
        out.append((start + low, count, words.mix(value[first[which]]), whole))
    if not out:
        return Runs(*(np.zeros(0, kind) for kind in (np.int64, np.int64, U, U)))
    return Runs(*map(np.concatenate, zip(*out)))


def _ragged(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each length, one after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Are the strings at ``a`` and ``b`` the same? Bytes are compared."""
    out = np.ones(len(a), bool)
    for i in range(0, len(a), STRINGS_AT_ONCE):
        x, y, n = a[i : i + STRINGS_AT_ONCE], b[i : i + STRINGS_AT_ONCE], length[i : i + STRINGS_AT_ONCE]
        differ = data[_ragged(x, n)] != data[_ragged(y, n)]
        out[i : i + STRINGS_AT_ONCE] = ~np.logical_or.reduceat(differ, np.cumsum(n) - n)
    return out


def same_strings(data: np.ndarray, start: np.ndarray, length: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each string the first string that equals it. Hashes propose, bytes decide."""
    order = np.argsort(hashes, kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = hashes[order[1:]] != hashes[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = order[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    again = np.flatnonzero(out != np.arange(len(out)))
    good = (length[again] == length[out[again]]) & _equal(data, start[again], start[out[again]], np.minimum(length[again], length[out[again]]))
    out[again[~good]] = again[~good]
    return out


def _doc_of(table: pa.Table, offsets: np.ndarray, start: np.ndarray) -> np.ndarray:
    docs = table["doc_id"].fill_null(LAST).to_numpy()
    return docs[np.searchsorted(offsets, start, "right") - 1]


def _count(batches: Iterator[pa.RecordBatch], anchor: int) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    for batch in batches:
        data, offsets = words.buffer(batch["text"])
        for low, high, _ in _pieces(offsets, anchor):
            counts += np.bincount(_slots(_hashes(data[low:high], anchor)[1]), minlength=len(counts))
    parts = counts.reshape(64, -1)
    yield pa.record_batch({"part": pa.array(range(64), pa.int32()), "counts": pa.array([p.tobytes() for p in parts], pa.binary())})


def _sum(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_buffer(), np.int64) for c in table["counts"])
    return pa.table({"part": table["part"].slice(0, 1), "counts": pa.array([total.tobytes()], pa.binary())})


def crowded_slots(docs: DataFrame, anchor: int) -> np.ndarray:
    """Which slots hold CROWDED times as many strings of ``anchor`` bytes as the mean. One scan; 2**SLOT_BITS numbers a
    task are summed in 64 parts, and as many come to the driver. This only steers the choice of anchors."""
    found = docs.select("text").mapInArrow(lambda b: _count(b, anchor), "part int, counts binary")
    parts = found.groupBy("part").applyInArrow(_sum, "part int, counts binary").toArrow().sort_by("part")
    counts = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(c.as_buffer(), np.int64) for c in parts["counts"])])
    counts = counts if len(counts) else np.zeros(1 << SLOT_BITS, np.int64)
    return counts > CROWDED * counts.mean() + 16


def _send(table: pa.Table, flags: np.ndarray, window: int, anchor: int, crowded: np.ndarray, buckets: int) -> pa.Table:
    """The block's different strings with repeated anchors, packed by bucket, with the smallest doc_id of each."""
    data, offsets = words.buffer(table["text"])
    runs = runs_of(data, offsets, window, anchor, crowded)
    sent = np.flatnonzero(flags)
    start, length = runs.start[sent], runs.count[sent] + window - 1
    same = same_strings(data, start, length, runs.hash[sent])
    docs = np.full(len(sent), LAST)
    np.minimum.at(docs, same, _doc_of(table, offsets, start))
    own = np.flatnonzero(same == np.arange(len(sent)))
    bucket = blocks.bucket_of(runs.key[sent[own]], buckets)
    own = own[np.argsort(bucket, kind="stable")]
    edges = np.searchsorted(np.sort(bucket), np.arange(buckets + 1))
    full = np.flatnonzero(np.diff(edges))
    columns: dict[str, list[bytes]] = {"first": [], "counts": [], "docs": [], "keys": [], "data": []}
    for b in full:
        at = own[edges[b] : edges[b + 1]]
        columns["first"].append(sent[at].astype(np.int32).tobytes())
        columns["counts"].append(runs.count[sent[at]].astype(np.uint8).tobytes())
        columns["docs"].append(docs[at].tobytes())
        columns["keys"].append(runs.key[sent[at]].astype(np.uint32).tobytes())
        columns["data"].append(b"".join(data[_ragged(start[x], length[x])].tobytes() for x in np.array_split(at, len(at) // STRINGS_AT_ONCE + 1)))
    block = table["block"][0].as_py() if table.num_rows else 0
    return pa.table(
        {
            "bucket": pa.array(full.astype(np.int32)), "block": pa.array(np.full(len(full), block, np.int32)),
            **{name: pa.array(x, pa.binary()) for name, x in columns.items()},
        }
    )


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x.as_buffer(), kind) for x in column)])


def _solve(table: pa.Table, window: int) -> pa.Table:
    """For each window of each string sent, whether it occurs in a document before the sender's."""
    table = table.sort_by("block")
    counts, docs, keys = (_joined(table[name], kind) for name, kind in (("counts", np.uint8), ("docs", np.int64), ("keys", np.uint32)))
    counts, data = counts.astype(np.int64), _joined(table["data"], np.uint8)
    length = counts + window - 1
    start = np.cumsum(length) - length
    same = same_strings(data, start, length, words.hashes(data, start, start + length))
    own = np.flatnonzero(same == np.arange(len(same)))
    low = np.full(len(same), LAST)
    np.minimum.at(low, same, docs)
    first = np.cumsum(counts[own]) - counts[own]  # windows of the different strings
    earliest = np.repeat(low[own], counts[own])
    for x in collections(keys[own], length[own]):
        strings = own[x]
        built = Collection(data, start[strings], length[strings])
        group = built.equal(window)[1]
        built.close()
        windows = _ragged(first[x], counts[strings])
        least = np.full(int(group.max()) + 1, LAST)
        np.minimum.at(least, group, earliest[windows])
        earliest[windows] = least[group]
    number = np.empty(len(same), np.int64)
    number[own] = np.arange(len(own))
    before = earliest[_ragged(first[number[same]], counts)] < np.repeat(docs, counts)
    sizes = [len(x.as_buffer()) for x in table["counts"]]
    ends = np.append(0, np.cumsum(counts))[np.cumsum([0, *sizes])]
    bits = pa.array([np.packbits(before[a:b]).tobytes() for a, b in zip(ends, ends[1:])], pa.binary())
    return pa.table({"block": table["block"], "first": table["first"], "bits": bits})


def collections(keys: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
    """Strings that share their anchor with others, some anchors at a time."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    alone = np.ones(len(keys) + 1, bool)
    alone[1:-1] = ranked[1:] != ranked[:-1]
    order = order[~(alone[:-1] & alone[1:])]
    ranked = keys[order]
    edges = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(order) else np.zeros(0, np.int64)
    size = np.append(0, np.cumsum(length[order]))
    a = 0
    while a < len(order):
        b = int(np.searchsorted(size, size[a] + COLLECTION_BYTES, "right")) - 1  # where it would be full
        nearest = edges[max(int(np.searchsorted(edges, b, "right")) - 1, 0)] if b < len(order) else len(order)
        if nearest <= a:
            after = int(np.searchsorted(edges, a, "right"))
            nearest = edges[after] if after < len(edges) else len(order)
        yield order[a:nearest]
        a = int(nearest)


def _removed(table: pa.Table, answers: pa.Table, runs: Runs, data: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """First bytes of the block's windows that occur in an earlier document."""
    first = _joined(answers["first"], np.int32).astype(np.int64)
    sizes = [len(x.as_buffer()) // 4 for x in answers["first"]]
    counts = runs.count[first]
    parts = np.cumsum([0, *sizes])
    flags = [np.unpackbits(np.frombuffer(x.as_buffer(), np.uint8), count=int(counts[a:b].sum())) for x, a, b in zip(answers["bits"], parts, parts[1:])]
    before = np.concatenate([np.zeros(0, np.uint8), *flags]).astype(bool)
    place = np.cumsum(counts) - counts
    order = np.lexsort((first, runs.hash[first]))
    have = runs.hash[first[order]]
    at = np.minimum(np.searchsorted(have, runs.hash), max(len(have) - 1, 0))
    answer = np.full(len(runs.start), -1)
    if len(have):
        found = np.flatnonzero(have[at] == runs.hash)
        near = order[at[found]]
        a, b = runs.start[found], runs.start[first[near]]
        n = runs.count[found] + window - 1
        good = (runs.count[found] == runs.count[first[near]]) & _equal(data, a, b, np.minimum(n, len(data) - np.maximum(a, b)))
        answer[found[good]] = near[good]
        answer[first] = np.arange(len(first))
    members = np.flatnonzero(answer >= 0)
    answer = answer[members]
    docs = _doc_of(table, offsets, runs.start[members])
    low = np.full(len(first), LAST)
    np.minimum.at(low, answer, docs)
    n = runs.count[members]
    gone = before[_ragged(place[answer], n)] | np.repeat(docs > low[answer], n)
    return _ragged(runs.start[members], n)[gone]


def _finish(table: pa.Table, answers: pa.Table, window: int, anchor: int, crowded: np.ndarray, texts: bool) -> pa.Table:
    table = blocks.in_order(table)
    data, offsets = words.buffer(table["text"])
    runs = runs_of(data, offsets, window, anchor, crowded)
    depth = np.zeros(len(data) + window, np.int8)  # at most ``window`` windows cover a byte
    starts = _removed(table, answers, runs, data, offsets, window)
    depth[starts] = 1
    depth[starts + window] -= 1
    gone = np.cumsum(depth, dtype=np.int8)[: len(data)] > 0
    n_removed, n_spans, digests, kept, removed = [], [], [], [], []
    for a, b in zip(offsets, offsets[1:]):
        inside = gone[a:b]
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        left = data[a:b][~inside].tobytes()
        n_removed.append(int(inside.sum()))
        n_spans.append(len(edges) // 2)
        digests.append(hashlib.sha256(left).hexdigest())
        if texts:
            kept.append(left)
            removed.append([{"start": x, "end": y} for x, y in edges.reshape(-1, 2).tolist()])
    columns = {
        "doc_id": table["doc_id"], "copies": table["copies"], "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(n_removed, pa.int64()),
        "n_spans": pa.array(n_spans, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
    }
    if texts:
        columns["kept"] = pa.array(kept, pa.binary())
        columns["removed"] = pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    return pa.table(columns)


def suffix_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, texts: bool = True) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) without the bytes that an earlier document has, too.

    Texts are UTF-8 bytes. A byte goes if a string of ``window`` bytes covers it that also starts in a document with a
    smaller doc_id; strings are judged on the input. Result: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 and, with ``texts``, kept (the remaining bytes, which may cut a character) and removed (the runs).
    ``anchor`` is smaller than ``window``; results don't depend on it. Hashes only say which strings meet: equality is
    decided by the collection's common prefixes, or by comparing the bytes of whole strings.

    Defined cases: a null or empty text has no bytes and gives the hash of nothing; a null doc_id counts as the largest
    number, so such a row keeps nothing that a named one has, and doesn't take from others; rows that repeat a doc_id
    are not before each other, so repeated rows give the same result each; texts shorter than the window are kept whole;
    columns besides doc_id and text are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = blocks.different(docs)
    crowded = docs.sparkSession.sparkContext.broadcast(crowded_slots(rows.docs, anchor))
    strings_each = (window + 1) / (window - anchor + 2)  # bytes of strings for a byte of text, if all are sent
    buckets = max(1, math.ceil(rows.bytes * strings_each / BUCKET_BYTES))

    def anchors(table: pa.Table, many: int) -> list[np.ndarray]:
        return [runs_of(*words.buffer(table["text"]), window, anchor, crowded.value).key]

    def send(table: pa.Table, flags: np.ndarray) -> pa.Table:
        return _send(table, flags, window, anchor, crowded.value, buckets)

    def solve(table: pa.Table) -> pa.Table:
        return _solve(table, window)

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        return _finish(table, answers, window, anchor, crowded.value, texts)

    dealt = rows.dealt()
    kind = "bucket int, block int, first binary, counts binary, docs binary, keys binary, data binary"
    strings = blocks.with_repeats(dealt, anchors, send, kind, rows.bytes, rows.bytes * 2 // (window - anchor + 2) + 1, width=4)
    strings = stash(strings, "strings", compression="zstd")
    met = blocks.dealt(strings, int(rows.bytes * strings_each), "bucket").groupBy("bucket")
    solved = stash(met.applyInArrow(solve, "block int, first binary, bits binary"), "windows", compression="zstd")
    discard(strings)
    kind = "doc_id long, copies long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if texts:
        kind += ", kept binary, removed array<struct<start:long,end:long>>"
    sides = [blocks.dealt(x, rows.bytes, "block").groupBy("block") for x in (dealt, solved)]
    return rows.expanded(sides[0].cogroup(sides[1]).applyInArrow(finish, kind))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, 9223372036854775807) AS place, hex(encode(coalesce(text, ''))) AS hx FROM documents),
c AS (SELECT rid, place, o, substr(hx, 2 * o + 1, 226) AS part FROM (SELECT *, unnest(range(0, length(hx) // 2 - 49, 64)) AS o FROM d)),
w AS (SELECT rid, place, o + j AS p, md5_number(substr(part, 2 * j + 1, 100)) AS h
      FROM (SELECT *, unnest(range(0, least(64, length(part) // 2 - 49))) AS j FROM c)),
m AS (SELECT h, min(place) AS low FROM w GROUP BY h),
s AS (SELECT rid, p, CASE WHEN p <= 50 + lag(p) OVER (PARTITION BY rid ORDER BY p) THEN 0 ELSE 1 END AS fresh FROM w JOIN m USING (h) WHERE low < place),
i AS (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS run FROM s),
r AS (SELECT rid, run, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY rid, run),
k AS (SELECT r.rid, run, a, b, substr(hx, 2 * lag(b, 1, 0) OVER (PARTITION BY r.rid ORDER BY run) + 1, 2 * (a - lag(b, 1, 0) OVER (PARTITION BY r.rid ORDER BY run))) AS kept
      FROM r JOIN d USING (rid)),
g AS (SELECT rid, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS b, string_agg(kept, '' ORDER BY run) AS kept FROM k GROUP BY rid)
SELECT doc_id, length(hx) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept || substr(hx, 2 * b + 1), hx))) AS kept_sha256
FROM d LEFT JOIN g USING (rid)
"""
