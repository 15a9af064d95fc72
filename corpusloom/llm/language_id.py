"""Language identification by prediction by partial matching (PPM) over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import words
from corpusloom.session import extended, prepare, stash, unused

#: Bytes of context; every text is read as if newlines stood before it.
ORDER = 3
PAD = 10
#: Labelled documents that one language's tree is learned from: the expected number, taken by hashes of id and text.
SAMPLE_ROWS = 400
#: Languages whose trees share a table, as long as all such tables have so many bytes; and bytes of trees that one pass
#: over the documents broadcasts.
TOGETHER, TABLE_BYTES, MODEL_BYTES = 8, 256 << 20, 256 << 20
#: Languages up to which their numbers of rows are broadcast.
BROADCAST_LANGUAGES = 100_000
UNDETERMINED = "und"


@dataclass
class Tree:
    """Frozen statistics of one language, for what it has seen.

    For each order k: grams, the sorted codes of k + 1 bytes; bits, what the last byte costs after the others; contexts,
    the sorted codes of k bytes; escapes, what leaving the context costs.
    """

    language: str
    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def nbytes(self) -> int:
        return sum(x.nbytes for part in (self.grams, self.bits, self.contexts, self.escapes) for x in part)

    def packed(self) -> list[bytes]:
        return [x.tobytes() for part in (self.grams, self.bits, self.contexts, self.escapes) for x in part]

    @classmethod
    def unpacked(cls, language: str, arrays: list[bytes]) -> Tree:
        kinds = (np.uint32, np.float32, np.uint32, np.float32)
        read = [[np.frombuffer(x, kind) for x in arrays[i * (ORDER + 1) : (i + 1) * (ORDER + 1)]] for i, kind in enumerate(kinds)]
        return cls(language, *read)


def tree_of(language: str, code: np.ndarray, weight: np.ndarray) -> Tree:
    """A language's tree from four bytes as a number and their occurrences.

    Escape method C: a context with n occurrences of d different symbols gives a seen symbol c/(n+d), and gives the
    escape to the next shorter context d/(n+d). A context that the language never saw costs nothing to leave. Below the
    empty context all 256 bytes weigh the same. There is no exclusion and no update: statistics are frozen.
    """
    tree = Tree(language, [], [], [], [])
    for k in range(ORDER + 1):
        grams, own = np.unique(code & (1 << 8 * (k + 1)) - 1, return_inverse=True)
        seen = np.bincount(own, weight)
        contexts, context = np.unique(grams >> 8, return_inverse=True)
        occurrences, different = np.bincount(context, seen), np.bincount(context)
        tree.grams.append(grams.astype(np.uint32))
        tree.bits.append((-np.log2(seen / (occurrences + different)[context])).astype(np.float32))
        tree.contexts.append(contexts.astype(np.uint32))
        tree.escapes.append((-np.log2(different / (occurrences + different))).astype(np.float32))
    return tree


@dataclass
class Table:
    """Trees of some languages over what any of them has seen: bits [language, gram] and escapes [language, context], with
    a column of zeros for contexts that none has seen."""

    grams: list[np.ndarray]
    bits: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    @classmethod
    def of(cls, trees: list[Tree]) -> Table:
        table = cls([], [], [], [])
        for k in range(ORDER + 1):
            grams = np.unique(np.concatenate([t.grams[k] for t in trees])).astype(np.int64)
            contexts, context = np.unique(grams >> 8, return_inverse=True)
            bits, escapes = np.zeros((len(trees), len(grams)), np.float32), np.zeros((len(trees), len(contexts) + 1), np.float32)
            for i, t in enumerate(trees):
                escapes[i, np.searchsorted(contexts, t.contexts[k])] = t.escapes[k]
                shorter = table.bits[k - 1][i][np.searchsorted(table.grams[k - 1], grams & (1 << 8 * k) - 1)] if k else 8.0
                bits[i] = escapes[i][context] + shorter
                bits[i, np.searchsorted(grams, t.grams[k])] = t.bits[k]
            table.grams.append(grams)
            table.bits.append(bits)
            table.contexts.append(contexts)
            table.escapes.append(escapes)
        return table


class Model:
    """Trees by language. A worker lays those of TOGETHER languages in one table, which makes them faster to read; where
    all these tables would be too large, each tree has its own, which is as large as the tree."""

    def __init__(self, trees: list[Tree]) -> None:
        self.trees = sorted(trees, key=lambda t: t.language)
        self._tables: list[Table] | None = None

    def __getstate__(self) -> dict:
        return {"trees": self.trees, "_tables": None}

    @property
    def languages(self) -> list[str]:
        return [t.language for t in self.trees]

    def nbytes(self) -> int:
        return sum(t.nbytes() for t in self.trees)

    def tables(self) -> list[Table]:
        if self._tables is None:
            parts = [self.trees[i : i + TOGETHER] for i in range(0, len(self.trees), TOGETHER)]
            if sum(len(p) * t.nbytes() for p in parts for t in p) > TABLE_BYTES:
                parts = [[t] for t in self.trees]
            self._tables = [Table.of(p) for p in parts]
        return self._tables

    def parts(self) -> list[Model]:
        """Models of MODEL_BYTES each, or of one language."""
        out: list[list[Tree]] = [[]]
        room = MODEL_BYTES
        for t in self.trees:
            if out[-1] and t.nbytes() > room:
                out.append([])
                room = MODEL_BYTES
            out[-1].append(t)
            room -= t.nbytes()
        return [Model(p) for p in out]


def build(counts: list[tuple[str, int, int]]) -> Model:
    """A model from (language, four bytes as a number, occurrences)."""
    of: dict[str, list[tuple[int, int]]] = {}
    for language, code, n in counts:
        of.setdefault(language, []).append((code, n))
    return Model([tree_of(x, *np.array(rows, np.int64).T) for x, rows in of.items()])


def code_lengths(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits that each language's tree needs for each document: [documents, languages].

    A document longer than a piece is summed over pieces that repeat the bytes of context before them.
    """
    if len(offsets) == 2 and len(data) > 2 * words.PIECE:
        cuts = range(0, len(data), words.PIECE)
        parts = [(max(0, p - ORDER), data[max(0, p - ORDER) : p + words.PIECE], p) for p in cuts]
        return sum(_sums(model, x, np.zeros(1, int), np.array([p - low, len(x)])) for low, x, p in parts)
    return _sums(model, data, offsets[:-1][offsets[:-1] < len(data)], offsets)


def _sums(model: Model, data: np.ndarray, begin: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    found = [_table_sums(table, data, begin, offsets) for table in model.tables()]
    return np.concatenate([np.zeros((len(offsets) - 1, 0)), *found], axis=1)


def _found(ranked: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the codes among the sorted ones, and whether they are there."""
    at = np.minimum(np.searchsorted(ranked, codes), max(0, len(ranked) - 1))
    return at, ranked[at] == codes if len(ranked) else np.zeros(len(codes), bool)


def _table_sums(model: Table, data: np.ndarray, begin: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offsets) - 1, len(model.bits[0])))
    full = np.flatnonzero(np.diff(offsets))
    if not len(full):
        return out
    before, code = data.astype(np.int64), data.astype(np.int64)
    for k in range(1, ORDER + 1):
        last = np.empty_like(before)
        last[1:] = before[:-1]
        last[begin] = PAD
        before, code = last, code | last << 8 * k
    # from the longest context down, what is known there; the rest escapes to the next shorter one
    steps, left = [], np.arange(len(code))
    for k in range(ORDER, -1, -1):
        own = code[left] & (1 << 8 * (k + 1)) - 1
        at, known = _found(model.grams[k], own)
        rest = own[~known] >> 8
        context, there = _found(model.contexts[k], rest)
        steps.append((k, left[known], at[known], left[~known], np.where(there, context, len(model.contexts[k]))))
        left = left[~known]
    for i in range(out.shape[1]):
        bits = np.zeros(len(code), np.float32)
        bits[left] = 8.0
        for k, have, at, go, context in steps:
            bits[have] += model.bits[k][i][at]
            bits[go] += model.escapes[k][i][context]
        out[full, i] = np.add.reduceat(bits, offsets[:-1][full], dtype=np.float64)
    return out


def learned_rows(docs: DataFrame, sample_rows: int) -> DataFrame:
    """The labelled rows to learn from: (lang, text), about ``sample_rows`` a language, chosen by a hash of id and text.

    A language's rows are counted first; a row is taken where its hash, as a number in [0, 1), is below
    ``sample_rows`` over that count. So no task gathers a language's rows, however common it is, and rows that repeat
    language, id and text count once.
    """
    allowed = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id")) != 2)).select("lang", "doc_id", "text")
    counts = stash(allowed.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    if counts.count() <= BROADCAST_LANGUAGES:
        counts = F.broadcast(counts)
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    taken = allowed.withColumn("chance", chance).join(counts, "lang").where(F.col("chance") < F.lit(float(sample_rows)) / F.col("n"))
    return taken.dropDuplicates(["lang", "doc_id", "text"]).select("lang", "text")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, texts = batch["lang"].to_pylist(), batch["text"].to_pylist()
        out_lang, out_gram, out_n = [], [], []
        for lang in sorted(set(langs)):
            joined = [b"\n" * ORDER + t.encode() for x, t in zip(langs, texts) if x == lang]
            data = np.frombuffer(b"".join(joined), np.uint8).astype(np.int64)
            edges = np.cumsum([0, *map(len, joined)])
            inside = np.ones(len(data), bool)
            for j in range(ORDER):
                inside[edges[:-1] + j] = False
            at = np.flatnonzero(inside)
            codes = data[at - 3] << 24 | data[at - 2] << 16 | data[at - 1] << 8 | data[at]
            grams, n = np.unique(codes, return_counts=True)
            out_lang += [lang] * len(grams)
            out_gram.append(grams)
            out_n.append(n)
        if out_gram:
            yield pa.record_batch(
                {"lang": pa.array(out_lang, pa.string()), "gram": np.concatenate(out_gram), "n": np.concatenate(out_n)}
            )


def _trees(table: pa.Table) -> pa.Table:
    language = table["lang"][0].as_py()
    tree = tree_of(language, table["gram"].to_numpy(), table["n"].to_numpy())
    return pa.table({"lang": pa.array([language], pa.string()), "arrays": pa.array([tree.packed()], pa.list_(pa.binary()))})


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from a bounded sample of each language. Its gram counts are summed in Spark, a task makes a language's tree,
    and the trees come to the driver, packed: some hundred kB for each language, whatever the number of documents."""
    prepare(docs.sparkSession)
    grams = learned_rows(docs, sample_rows).mapInArrow(_grams, "lang string, gram long, n long")
    counts = grams.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    trees = counts.groupBy("lang").applyInArrow(lambda t: _trees(t), "lang string, arrays array<binary>").toArrow()
    return Model([Tree.unpacked(x.as_py(), a.as_py()) for x, a in zip(trees["lang"], trees["arrays"])])


@dataclass
class Verdict:
    """The best language of each text so far, its code length, and the sum over languages of 2**(that - their length)."""

    names: list[str | None]
    bits: np.ndarray
    share: np.ndarray

    def joined(self, other: Verdict) -> Verdict:
        """Over the languages of both; equal lengths go to the first."""
        first = self.bits <= other.bits
        bits = np.where(first, self.bits, other.bits)
        scale = lambda v: v.share * np.exp2(np.maximum(bits - v.bits, -1000.0))
        with np.errstate(invalid="ignore"):
            share = np.nan_to_num(scale(self)) + np.nan_to_num(scale(other))
        return Verdict([a if x else b for a, b, x in zip(self.names, other.names, first)], bits, share)


def judge(model: Model, column: pa.Array) -> Verdict:
    """For each text the language with the shortest code (ties: the first by name); none where nothing was learned."""
    data, offsets = words.buffer(column)
    n = len(offsets) - 1
    out = Verdict([None] * n, np.full(n, np.inf), np.zeros(n))
    names = model.languages
    for i, j in words.spans_of_documents(offsets, words.PIECE) if names else ():
        bits = code_lengths(model, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        best = bits.argmin(1)
        out.names[i:j] = [names[x] for x in best]
        out.bits[i:j] = bits[np.arange(j - i), best]
        out.share[i:j] = np.exp2(np.maximum(out.bits[i:j, None] - bits, -1000.0)).sum(1)
    return out


def lettered(column: pa.Array) -> np.ndarray:
    """Which texts have a letter."""
    data, offsets = words.buffer(column)
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = True
    out = np.zeros(len(offsets) - 1, bool)
    for d, (a, b) in enumerate(zip(offsets, offsets[1:])):
        out[d] = letter[data[a:b]].any() or any(map(str.isalpha, data[a:b].tobytes().decode()))
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score.

    Each language's tree gives the exact code length of the whole text; the shortest wins, and the score is its share
    of 2**-length over all languages. Trees of more than MODEL_BYTES go over the documents in several passes, each of
    which writes them with the best language so far. Defined cases: ``und`` with score 0 where the text is null, has no
    letter, or nothing was learned; equal lengths go to the first name; input columns of these two names are replaced;
    repeated rows are judged alike; an empty table gives an empty result. No other column is an input of the prediction.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    parts, names, schema = model.parts(), docs.columns, docs.schema
    so_far = [unused(x, names) for x in ("so_far", "bits", "share")]
    for k, part in enumerate(parts):
        shared, last = spark.sparkContext.broadcast(part), k == len(parts) - 1  # of MODEL_BYTES at most, or one tree

        def run(batches: Iterator[pa.RecordBatch], shared=shared, last=last, k=k) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = judge(shared.value, batch["text"])
                if k:
                    before = Verdict(batch[so_far[0]].to_pylist(), batch[so_far[1]].to_numpy(), batch[so_far[2]].to_numpy())
                    found = before.joined(found)
                own = [batch[x] for x in names]
                if not last:
                    yield pa.record_batch([*own, pa.array(found.names, pa.string()), pa.array(found.bits), pa.array(found.share)], names=[*names, *so_far])
                    continue
                good = lettered(batch["text"])
                pred = [x if g and x is not None else UNDETERMINED for x, g in zip(found.names, good)]
                score = np.divide(1.0, found.share, out=np.zeros(len(good)), where=good & (found.share > 0))
                yield pa.record_batch([*own, pa.array(pred, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

        more = "lang_pred string, score double" if last else f"{so_far[0]} string, {so_far[1]} double, {so_far[2]} double"
        docs = docs.mapInArrow(run, extended(schema, more))
        if not last:
            docs = stash(docs, "judged")
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    return found.select("doc_id", held, "lang_pred", "score")
