"""The best sections for each query of a batch, found by tasks that read the sections and keep a few rows a query."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from corpusloom.operators.postings import counted, counted_tokens, token_lists
from corpusloom.session import prepare

# BM25's constants, and the weights of the bonuses.
K1, B = 1.5, 0.75
TITLE_BONUS, PHRASE_BONUS, KEYWORD_BONUS = 3.0, 2.0, 0.5
#: Added to a hundredfold score before its decimals are cut, so that sums in another order give the same number.
ROUNDING = 1e-9
#: Cells of a block of scores and entries of a block of sums, whatever the numbers of queries, terms and sections.
CELLS = 1 << 22
#: Tokens whose terms a task remembers.
KNOWN = 200_000


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all spans, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


@dataclass
class Batch:
    """Queries by number: their ids and phrases, their terms' numbers, and for each term the queries that have it."""

    ids: np.ndarray
    phrases: list[str]
    sizes: np.ndarray
    numbers: dict[str, int]
    first: np.ndarray
    asking: np.ndarray
    limit: int

    @staticmethod
    def of(asked: list[Row], limit: int) -> Batch:
        """A batch of rows (q, phrase, terms), whose terms differ."""
        numbers: dict[str, int] = {}
        terms = np.array([numbers.setdefault(w, len(numbers)) for r in asked for w in r["terms"]], np.int64)
        sizes = np.array([len(r["terms"]) for r in asked], np.int64)
        order = np.argsort(terms, kind="stable")
        first = np.searchsorted(terms[order], np.arange(len(numbers) + 1))
        return Batch(np.array([r["q"] for r in asked], np.int64), [r["phrase"] for r in asked], sizes, numbers, first, np.repeat(np.arange(len(asked)), sizes)[order], limit)


class Hits:
    """Terms in sections' tokens. Each different token is looked at once while it is remembered."""

    def __init__(self, numbers: dict[str, int]) -> None:
        self.terms, self.known = len(numbers), {}
        self.automaton = ahocorasick.Automaton()
        for term, number in numbers.items():
            self.automaton.add_word(term, (number, len(term)))
        self.automaton.make_automaton()

    def of_token(self, token: str) -> tuple[np.ndarray, np.ndarray]:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            hits = counted(self.automaton, token) if self.terms else {}
            found = self.known[token] = (np.fromiter(hits, np.int64, len(hits)), np.fromiter(hits.values(), np.int64, len(hits)))
        return found

    def of(self, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, term, how often), by row and term, for a column of token lists."""
        tokens, row, token, n = counted_tokens(lists)
        found = [self.of_token(x) for x in tokens]
        sizes = np.array([len(f[0]) for f in found], np.int64)
        if not sizes.sum():
            none = np.zeros(0, np.int64)
            return none, none, none
        term, times = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        each = sizes[token]
        at = spans((np.cumsum(sizes) - sizes)[token], each)
        key, counts = np.repeat(row, each) * self.terms + term[at], np.repeat(n, each) * times[at]
        if len(lists) * self.terms <= 2 * CELLS:
            sums = np.bincount(key, counts)
            key = np.flatnonzero(sums)
            return key // self.terms, key % self.terms, sums[key]
        key, place = np.unique(key, return_inverse=True)
        return key // self.terms, key % self.terms, np.bincount(place, counts)


def frequencies(sections: DataFrame, batch: Batch) -> np.ndarray:
    """In how many sections' texts each term stands: a task sends one number a term."""
    numbers = batch.numbers

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, total = Hits(numbers), np.zeros(len(numbers), np.int64)
        for part in batches:
            total += np.bincount(hits.of(part["content"])[1], minlength=len(numbers))
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["t", "df"])

    prepare(sections.sparkSession)
    found = token_lists(sections).select("content").mapInArrow(read, "t long, df long").groupBy("t").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(len(numbers))
    df[[r["t"] for r in found]] = [r["df"] for r in found]
    return df


class Best:
    """The best rows (query, score, doc_ord, ord) so far, ``limit`` a query at most."""

    def __init__(self, queries: int, limit: int) -> None:
        self.limit, self.least = limit, np.full(queries, -1, np.int64)
        self.rows = np.zeros((4, 0), np.int64)

    def add(self, scores: np.ndarray, places: np.ndarray) -> None:
        """Scores of sections (rows; below 0: none) for queries (columns), and the sections' places."""
        bound = np.maximum(self.least, 0)
        if len(scores) > self.limit:
            bound = np.maximum(bound, np.partition(scores, -self.limit, axis=0)[-self.limit])
        row, query = np.nonzero(scores >= bound)
        rows = np.concatenate([self.rows, np.stack([query, scores[row, query], *places[:, row]])], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], -rows[1], rows[0]))]
        at = np.arange(rows.shape[1])
        place = at - np.searchsorted(rows[0], rows[0])
        self.rows = rows[:, place < self.limit]
        full = rows[:, place == self.limit - 1]
        self.least[full[0]] = full[1]


def best(sections: DataFrame, batch: Batch, n: int, average: float) -> DataFrame:
    """(q, doc_ord, ord, relevance_score): for each query the best ``limit`` sections of each task."""
    df = frequencies(sections, batch)
    idf = np.where(df > 0, np.log((n - df + 0.5) / (df + 0.5) + 1.0), 0.0)
    asked = np.diff(batch.first)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, top = Hits(batch.numbers), Best(len(batch.ids), batch.limit)
        for part in batches:
            size = part["char_count"].to_numpy(zero_copy_only=False).astype(float)
            texts, places = part["content_lc"], np.stack([part[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("doc_ord", "ord")])
            row, term, tf = hits.of(part["content"])
            added = [(row, term, idf[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[row] / average))), np.ones(len(row), bool))]
            for place, bonus in (("title", TITLE_BONUS), ("keywords", KEYWORD_BONUS)):
                row, term, _ = hits.of(part[place])
                added.append((row, term, idf[term] * bonus, np.zeros(len(row), bool)))
            row, term, weight, spoken = (np.concatenate(x) for x in zip(*added))
            order = np.argsort(row, kind="stable")
            row, term, weight, spoken = row[order], term[order], weight[order], spoken[order]
            first = np.searchsorted(row, np.arange(len(size) + 1))
            work = np.concatenate([[0], np.cumsum(asked[term])])[first]  # sums up to each section
            begin = 0
            while begin < len(size):
                end = int(np.searchsorted(work, work[begin] + CELLS, "right")) - 1
                end = min(max(end, begin + 1), begin + max(1, CELLS // max(len(batch.ids), 1)), len(size))
                here = slice(first[begin], first[end])
                _block(batch, top, texts, places, begin, end, row[here] - begin, term[here], weight[here], spoken[here], asked)
                begin = end
        query, score, *place = top.rows
        yield pa.record_batch([pa.array(batch.ids[query], pa.int64()), pa.array(place[0], pa.int64()), pa.array(place[1], pa.int32()), pa.array(score, pa.int32())], names=["q", "doc_ord", "ord", "relevance_score"])

    rows = token_lists(sections, "doc_ord", "ord", "char_count", "content_lc")
    return rows.mapInArrow(read, "q long, doc_ord long, ord int, relevance_score int")


def _block(batch: Batch, top: Best, texts: pa.Array, places: np.ndarray, begin: int, end: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray, spoken: np.ndarray, asked: np.ndarray) -> None:
    """Score some sections for all queries; phrases are looked for where all terms stand and the bonus could count."""
    queries, each = len(batch.ids), asked[term]
    cell = np.repeat(row * queries, each) + batch.asking[spans(batch.first[term], each)]
    shape = (end - begin, queries)
    score = np.bincount(cell, np.repeat(weight, each), shape[0] * shape[1]).reshape(shape)
    held = np.bincount(cell[np.repeat(spoken, each)], minlength=shape[0] * shape[1]).reshape(shape)
    rated = np.where(score > 0, (score * 100 + ROUNDING).astype(np.int64), -1)
    with_phrase = ((score + PHRASE_BONUS) * 100 + ROUNDING).astype(np.int64)
    may = (held == batch.sizes) & (batch.sizes > 1) & (score > 0) & (with_phrase >= top.least)
    for r, q in zip(*np.nonzero(may)):
        if batch.phrases[q] in (texts[begin + int(r)].as_py() or ""):
            rated[r, q] = with_phrase[r, q]
    top.add(rated, places[:, begin:end])
