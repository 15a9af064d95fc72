"""Substring dedup: remove words covered by a window of 35 words that starts anywhere else in the corpus."""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import blocks, words
from corpusloom.session import prepare

WINDOW = 35


def _hashes(table: pa.Table, many: int, window: int) -> list[np.ndarray]:
    """Rabin-Karp hashes of all windows; with ``many`` 2 also those to another base over words hashed anew."""
    data, offsets = words.buffer(table["text"])
    out: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)] for _ in range(many)]
    for i, j in words.spans_of_documents(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = words.split(part, at)
        hashes = words.hashes(part, starts, ends)
        out[0].append(words.rolling(hashes, first, window)[0])
        if many > 1:
            out[1].append(words.rolling(words.mix(hashes + np.uint64(1)), first, window, words.SECOND_BASE)[0])
    return [np.concatenate(x) for x in out]


def covered(first: np.ndarray, flags: np.ndarray, window: int) -> np.ndarray:
    """Words that lie in a flagged window. Adjacent and overlapping windows merge into maximal intervals."""
    counts = np.maximum(np.diff(first) - window + 1, 0)
    at = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=at[1:])
    start = (np.repeat(first[:-1] - at[:-1], counts) + np.arange(at[-1]))[flags]
    depth = np.zeros(int(first[-1]) + 1, np.int64)
    np.add.at(depth, start, 1)
    np.add.at(depth, start + window, -1)
    return np.cumsum(depth)[:-1] > 0


def _finish(table: pa.Table, flags: np.ndarray, window: int, texts: bool) -> pa.Table:
    data, offsets = words.buffer(table["text"])
    copied = table["copies"].to_numpy() > 1  # a row that occurs twice repeats all its windows
    n_words, n_removed, digests, kept_texts, intervals, done = [], [], [], [], [], 0
    for i, j in words.spans_of_documents(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = words.split(part, at)
        size = int(np.maximum(np.diff(first) - window + 1, 0).sum())
        own = np.repeat(copied[i:j], np.maximum(np.diff(first) - window + 1, 0))
        gone = covered(first, flags[done : done + size] | own, window)
        done += size
        n_words.append(np.diff(first))
        totals = np.concatenate([[0], np.cumsum(gone)])
        n_removed.append(totals[first[1:]] - totals[first[:-1]])
        kept = np.flatnonzero(~gone)
        # the byte before a kept word becomes its joining space, but for a document's first kept word
        owner = np.searchsorted(first, kept, "right") - 1
        lead = np.ones(len(kept), bool)
        lead[1:] = owner[1:] != owner[:-1]
        left = starts[kept] - ~lead
        text = part.copy()
        text[left[~lead]] = 32
        depth = np.zeros(len(part) + 1, np.int8)
        depth[left] += 1
        # a kept word may begin (with its space) where the one before it ends
        np.add.at(depth, ends[kept], np.int8(-1))
        mask = np.cumsum(depth, dtype=np.int8)[:-1] > 0
        out = text[mask]
        cut = np.concatenate([[0], np.cumsum(mask)])[at]
        for d in range(j - i):
            body = out[cut[d] : cut[d + 1]].tobytes()
            digests.append(hashlib.sha256(body).hexdigest())
            if texts:
                kept_texts.append(body.decode("utf-8"))
                inside = gone[first[d] : first[d + 1]].astype(np.int8)
                edges = np.flatnonzero(np.diff(inside, prepend=0, append=0)).tolist()
                intervals.append([{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
    columns = {
        "doc_id": table["doc_id"],
        "copies": table["copies"],
        "n_words": pa.array(np.concatenate(n_words).astype(np.int64)),
        "n_removed": pa.array(np.concatenate(n_removed).astype(np.int64)),
        "kept_sha256": pa.array(digests, pa.string()),
    }
    if texts:
        columns["kept_text"] = pa.array(kept_texts, pa.string())
        columns["removed"] = pa.array(intervals, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    return pa.table(columns)


def substring_dedup(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """Rows of ``docs`` (doc_id, text) with what is left when repeated windows are removed.

    Every run of ``window`` words of one document has a Rabin-Karp hash; runs whose hash starts at two places or more
    (same document included) are removed. What one hash flags a second, independent one confirms, so a run that occurs
    once is removed with a chance of about (runs flagged) / 2**64 / 700,000. Windows are judged on the input. Result: doc_id, n_words, n_removed,
    kept_sha256 and, with ``texts``, kept_text (kept words joined by a space) and removed (maximal intervals of word
    positions, end exclusive).

    Defined cases: a null or empty text has no words and gives the hash of the empty string; a null doc_id stays null;
    repeated rows count as documents of their own, so copies remove each other entirely; documents shorter than the
    window are kept whole; columns besides doc_id and text are ignored; an empty table gives an empty result.
    """
    prepare(docs.sparkSession)
    rows = blocks.different(docs)
    schema = "doc_id long, copies long, n_words long, n_removed long, kept_sha256 string"
    if texts:
        schema += ", kept_text string, removed array<struct<start:int,end:int>>"
    found = blocks.with_repeats(
        rows.dealt(),
        partial(_hashes, window=window),
        partial(_finish, window=window, texts=texts),
        schema,
        rows.bytes,
        rows.bytes // 6,
        width=5,
        confirm=True,
    )
    return rows.expanded(found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), texts=False)


SQL = r"""
WITH w AS (
  SELECT doc_id, row_number() OVER () AS rid, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents),
s AS (SELECT rid, unnest(range(1, len(words) - 33)) AS p FROM w WHERE len(words) >= 35),
g AS (SELECT s.rid, s.p, md5(array_to_string(list_slice(w.words, s.p, s.p + 34), ' ')) AS h FROM s JOIN w USING (rid)),
r AS (SELECT h FROM g GROUP BY h HAVING count(*) > 1),
c AS (SELECT DISTINCT rid, unnest(range(p, p + 35)) AS i FROM g SEMI JOIN r USING (h)),
i AS (SELECT rid, doc_id, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM w),
k AS (SELECT i.rid, count(c.i) AS n_removed, coalesce(string_agg(CASE WHEN c.i IS NULL THEN i.word END, ' ' ORDER BY i.i), '') AS kept
      FROM i LEFT JOIN c ON i.rid = c.rid AND i.i = c.i GROUP BY i.rid)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (rid)
"""
