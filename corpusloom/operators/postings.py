"""Where the words of sections stand: what search reads instead of the sections.

A term of a query is a run of letters, digits and connectors, so a substring hit of it lies inside one token of the text.
Tokens are looked up by their character n-grams; their postings tell how often each section holds them.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import prepare

#: What ends a token: no character that a term of a query may have.
NOT_TOKEN = r"[^\p{L}\p{M}\p{N}\p{Pc}]+"
#: Places of a section that search looks at.
CONTENT, TITLE, KEYWORDS = 0, 1, 2
GRAM = 3
SCHEMA = "token string, place int, doc_ord long, ord int, n int, size int"
#: Postings of a place and token together, as they are stored.
PACKED = "token string, place int, hits array<struct<doc_ord: long, ord: int, n: int, size: int>>"
#: Postings that a task packs at a time.
SEGMENT = 1 << 20


def postings(sections: DataFrame, *keys: str) -> DataFrame:
    """(token, place, doc_ord, ord, n, size, *keys): how often each place of each section holds a token. Terms have two
    characters at least, and so have the tokens here. Counts are summed before the exchange."""
    spoken = F.lower(F.array_join(F.coalesce("keywords", F.array()), "\n"))
    places = [F.struct(F.lit(k).alias("place"), x.alias("text")) for k, x in ((CONTENT, F.col("content_lc")), (TITLE, F.col("title_lc")), (KEYWORDS, spoken))]
    rows = sections.select("doc_ord", "ord", F.col("char_count").alias("size"), *keys, F.explode(F.array(*places)).alias("at"))
    rows = rows.select("doc_ord", "ord", "size", *keys, "at.place", F.explode(F.split("at.text", NOT_TOKEN)).alias("token"))
    counted = rows.where(F.length("token") > 1).groupBy("token", "place", "doc_ord", "ord", "size", *keys).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return counted.select("token", "place", "doc_ord", "ord", "n", "size", *keys)


def token_lists(sections: DataFrame, *columns: str) -> DataFrame:
    """(*columns, content, title, keywords): the tokens of each place of each section, as arrays."""
    spoken = F.lower(F.array_join(F.coalesce("keywords", F.array()), "\n"))
    return sections.select(*columns, *[F.split(x, NOT_TOKEN).alias(k) for k, x in (("content", F.col("content_lc")), ("title", F.col("title_lc")), ("keywords", spoken))])


def counted_tokens(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The different tokens of a column of ``token_lists``, and (row, token's number, count) of what each row holds, by row."""
    tokens, *counts = _counted(lists)
    return tokens.to_pylist(), *counts


def _counted(lists: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    flat, row = lists.flatten(), pc.list_parent_indices(lists)
    keep = pc.fill_null(pc.greater(pc.utf8_length(flat), 1), False)
    coded = flat.filter(keep).dictionary_encode()
    if not len(coded):
        none = np.zeros(0, np.int64)
        return coded.dictionary, none, none, none
    code, row = coded.indices.to_numpy().astype(np.int64), row.filter(keep).to_numpy().astype(np.int64)
    key, n = np.unique(row * len(coded.dictionary) + code, return_counts=True)
    return coded.dictionary, key // len(coded.dictionary), key % len(coded.dictionary), n


def packed(sections: DataFrame, bucket: Column) -> DataFrame:
    """``postings`` as rows (bucket, token, place, hits), packed where the sections are read: no row is exchanged. A token
    may have several rows in a bucket, one for each segment of it. Texts go to the tasks whole, and are cut there by the
    classes of characters that NOT_TOKEN has."""
    prepare(sections.sparkSession)
    spoken = F.lower(F.array_join(F.coalesce("keywords", F.array()), "\n"))
    rows = sections.select(bucket.alias("bucket"), "doc_ord", "ord", F.col("char_count").alias("size"), F.col("content_lc").alias("content"), F.col("title_lc").alias("title"), spoken.alias("keywords"))
    chars = token_chars(sections.sparkSession)
    return rows.mapInArrow(lambda batches: _pack(batches, chars), f"bucket int, {PACKED}")


@lru_cache(maxsize=1)
def token_chars(spark: SparkSession) -> bytes:
    """A bit for each code point, packed: is it part of a token? Spark's own regular expressions say so, once a session,
    as other libraries know other versions of Unicode."""
    codes = [k for k in range(sys.maxunicode + 1) if not 0xD800 <= k < 0xE000]
    texts = [(k, "".join(map(chr, codes[k : k + 4096]))) for k in range(0, len(codes), 4096)]
    spaced = F.regexp_replace("text", NOT_TOKEN.removesuffix("+"), "\n").alias("text")
    is_token = np.zeros(sys.maxunicode + 1, bool)
    for r in spark.createDataFrame(texts, "k int, text string").select("k", spaced).collect():
        is_token[codes[r["k"] : r["k"] + 4096]] = [c != "\n" for c in r["text"]]
    return zlib.compress(np.packbits(is_token).tobytes())


def _pack(batches: Iterator[pa.RecordBatch], chars: bytes) -> Iterator[pa.RecordBatch]:
    ends = np.unpackbits(np.frombuffer(zlib.decompress(chars), np.uint8))[: sys.maxunicode + 1] == 0
    held: list[tuple] = []
    tokens: list[pa.Array] = []
    for batch in batches:
        own = [batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("bucket", "doc_ord", "ord", "size")]
        for place, name in ((CONTENT, "content"), (TITLE, "title"), (KEYWORDS, "keywords")):
            different, row, token, n = _counted(cut_by(ends, batch[name].to_pylist()))
            bucket, doc, ord_, size = (x[row] for x in own)
            held.append((bucket, token + sum(map(len, tokens)), np.full(len(row), place, np.int64), doc, ord_, n, size))
            tokens.append(different)
        if sum(len(x[0]) for x in held) >= SEGMENT:
            yield _segment(held, tokens)
            held, tokens = [], []
    if held:
        yield _segment(held, tokens)


def cut_by(ends: np.ndarray, texts: list[str | None]) -> pa.Array:
    """The tokens of each text. Texts are cut together: characters that end a token become blanks, and texts lines."""
    codes = np.frombuffer("\n".join(x or "" for x in texts).encode("utf-32-le"), np.uint32)
    codes = np.where(ends[codes], np.uint32(32), codes)
    codes[np.cumsum([len(x or "") + 1 for x in texts])[:-1] - 1] = 10
    return pc.split_pattern(pa.array(codes.tobytes().decode("utf-32-le").split("\n"), pa.string()), " ")


def _segment(held: list[tuple], tokens: list[pa.Array]) -> pa.RecordBatch:
    """Rows of a segment by bucket, token and place, so that the sort before writing finds runs; hits as they were read.
    Tokens' numbers count on through ``tokens``, which repeat from one to the next."""
    coded = pa.concat_arrays(tokens).dictionary_encode()
    bucket, token, place, doc, ord_, n, size = (np.concatenate(x) for x in zip(*held))
    words, token = coded.dictionary, coded.indices.to_numpy()[token]
    rank = np.empty(len(words), np.int64)
    rank[pc.array_sort_indices(words).to_numpy()] = np.arange(len(words))
    order, new = _grouped((bucket * max(len(words), 1) + rank[token]) * 3 + place)
    at = order[new]
    ends = pa.array(np.append(np.flatnonzero(new), len(order)), pa.int32())
    kinds = {"doc_ord": pa.int64(), "ord": pa.int32(), "n": pa.int32(), "size": pa.int32()}
    hits = pa.StructArray.from_arrays([pa.array(x[order], k) for x, k in zip((doc, ord_, n, size), kinds.values())], list(kinds))
    return pa.record_batch([pa.array(bucket[at], pa.int32()), words.take(pa.array(token[at])), pa.array(place[at], pa.int32()), pa.ListArray.from_arrays(ends, hits)], names=["bucket", "token", "place", "hits"])


def _grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of rows by key and place, and which of the rows in that order open a group."""
    n = max(len(key), 1)
    mixed = np.sort(key * n + np.arange(len(key)))  # some 2**55 at most
    key, new = mixed // n, np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return mixed - key * n, new


def unpacked(found: DataFrame) -> DataFrame:
    """``postings`` from ``packed`` rows. A filter on tokens reaches the files below. Plain rows stay as they are."""
    if "hits" not in found.columns:
        return found
    return found.select("token", "place", F.explode("hits").alias("hit")).select("token", "place", "hit.doc_ord", "hit.ord", "hit.n", "hit.size")


def grams(found: DataFrame, *keys: str) -> DataFrame:
    """(gram, token, *keys) of the tokens of ``postings``: each character n-gram of a token, the whole of a shorter one."""
    words = found.select("token", *keys).distinct()
    return grams_of_tokens(words, *keys)


def grams_of_tokens(words: DataFrame, *keys: str) -> DataFrame:
    """The same of different tokens (token, *keys)."""
    every = words.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.length("token") - (GRAM - 1), F.lit(1)))))
    return every.select(F.substring("token", F.col("at"), F.lit(GRAM)).alias("gram"), "token", *keys)


#: N-grams of tokens, as they are stored: the tokens that hold one, joined by blanks, which no token has.
PACKED_GRAMS = "gram string, tokens string"
#: Tokens whose n-grams a task packs at a time, and the length up to which tokens are cut together.
TOKENS, LONG = 1 << 17, 64


def packed_grams(words: DataFrame) -> DataFrame:
    """``grams`` of tokens (bucket, token) as rows (bucket, gram, tokens), packed where the tokens are read: no row is
    exchanged. Repeats of a token are left out where they stand together."""
    prepare(words.sparkSession)
    return words.select("bucket", "token").mapInArrow(_pack_grams, f"bucket int, {PACKED_GRAMS}")


def _pack_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, pa.Array]] = []
    for batch in batches:
        bucket, token = batch["bucket"].to_numpy(), batch["token"]
        new = np.ones(len(bucket), bool)
        new[1:] = pc.not_equal(token[1:], token[:-1]).to_numpy(zero_copy_only=False) | (bucket[1:] != bucket[:-1])
        held.append((bucket[new].astype(np.int64), token.filter(pa.array(new))))
        if sum(len(x) for x, _ in held) >= TOKENS:
            yield _gram_rows(held)
            held = []
    if held:
        yield _gram_rows(held)


def _gram_rows(held: list[tuple[np.ndarray, pa.Array]]) -> pa.RecordBatch:
    bucket, tokens = np.concatenate([x for x, _ in held]), pa.concat_arrays([x for _, x in held])
    size = pc.utf8_length(tokens).to_numpy()
    at = [np.flatnonzero((size <= LONG) & (size >= (k + GRAM if k else 0))) for k in range(LONG - GRAM + 1)]
    parts = [pc.utf8_slice_codeunits(tokens.take(pa.array(x)), k, k + GRAM) for k, x in enumerate(at)]
    for k in np.flatnonzero(size > LONG):
        own = grams_of(tokens[int(k)].as_py())
        parts.append(pa.array(own, pa.string()))
        at.append(np.full(len(own), k))
    token, coded = np.concatenate(at), pa.concat_arrays(parts).dictionary_encode()
    by_name = pc.array_sort_indices(coded.dictionary)
    rank, n = np.empty(len(by_name), np.int64), max(len(by_name), 1)
    rank[by_name.to_numpy()] = np.arange(len(by_name))
    key = np.sort((bucket[token] * n + rank[coded.indices.to_numpy()]) * len(tokens) + token)
    key = key[np.diff(key, prepend=-1) > 0]  # a token has an n-gram once
    group, token = key // len(tokens), key % len(tokens)
    first = np.flatnonzero(np.diff(group, prepend=-1))
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), tokens.take(pa.array(token)))
    names = coded.dictionary.take(by_name).take(pa.array(group[first] % n))
    return pa.record_batch([pa.array(group[first] // n, pa.int32()), names, pc.binary_join(lists, " ")], names=["bucket", "gram", "tokens"])


def unpacked_grams(found: DataFrame) -> DataFrame:
    """``grams`` from ``packed_grams`` rows. A filter on n-grams reaches the files below. Plain rows stay as they are."""
    return found.select("gram", F.explode(F.split("tokens", " ")).alias("token")) if "tokens" in found.columns else found


def grams_of(term: str) -> list[str]:
    """The n-grams of a term."""
    return [term[i : i + GRAM] for i in range(max(len(term) - GRAM + 1, 1))]


def hits_in(term: Column, token: Column) -> Column:
    """How often a term stands in a token, without overlapping itself."""
    return F.floor((F.length(token) - F.length(F.replace(token, term, F.lit("")))) / F.length(term)).cast("int")


def matched_few(terms: list[str], found: DataFrame) -> DataFrame:
    """``matched`` for some terms by name: files skip the pages that lack their n-grams. Of a term one n-gram is asked
    for: in the middle, as words begin and end alike."""
    long_ = [grams_of(w)[(len(w) - GRAM + 1) // 2] for w in terms if len(w) >= GRAM]
    short = [w for w in terms if len(w) < GRAM]
    asked = F.col("gram").isin(long_)
    for w in short:  # a token that holds a pair has it at either end of an n-gram
        asked |= F.col("gram").startswith(w) | F.col("gram").endswith(w)
    every = F.array(*map(F.lit, terms))
    rows = found.where(asked).select("token").distinct().select("token", F.explode(every).alias("term"))
    return rows.where(F.contains("token", "term")).select("term", "token", hits_in(F.col("term"), F.col("token")).alias("times"))


#: Terms of a batch up to which one automaton of them all is sent to the tasks: some tens of bytes a character of them.
AUTOMATON_TERMS = 100_000


def matched(terms: DataFrame, found: DataFrame) -> DataFrame:
    """(t, token, times) for each token of ``found`` (postings) that holds a term of ``terms`` (t, term).

    An automaton of the terms reads each different token once. Beyond AUTOMATON_TERMS terms meet tokens by n-grams.
    """
    tokens = found.select("token").distinct()
    asked = terms.select("t", "term").limit(AUTOMATON_TERMS + 1).collect()
    if len(asked) > AUTOMATON_TERMS:
        return matched_by_grams(terms, grams(tokens))
    prepare(terms.sparkSession)
    numbers = {r["term"]: r["t"] for r in asked}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ahocorasick.Automaton()
        for term, t in numbers.items():
            automaton.add_word(term, (t, len(term)))
        automaton.make_automaton()
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for token in batch["token"].to_pylist():
                for t, n in counted(automaton, token).items() if numbers else ():
                    for column, value in zip(out, (t, token, n)):
                        column.append(value)
            yield pa.record_batch([pa.array(x, k) for x, k in zip(out, (pa.int64(), pa.string(), pa.int32()))], names=["t", "token", "times"])

    return tokens.mapInArrow(read, "t long, token string, times int")


def counted(automaton: ahocorasick.Automaton, text: str) -> dict[int, int]:
    """For each term in the text, how often it occurs without overlapping itself."""
    counts: dict[int, int] = {}
    free: dict[int, int] = {}
    for last, (i, size) in automaton.iter(text):
        if last - size >= free.get(i, -1):
            free[i] = last
            counts[i] = counts.get(i, 0) + 1
    return counts


def matched_by_grams(terms: DataFrame, found: DataFrame) -> DataFrame:
    """``matched`` for any number of terms, from ``grams``.

    A token has all n-grams of a term that it holds; the lists of the term's n-grams are intersected by reading the
    shortest of them, which a count of the lists names, and looking at its tokens.
    """
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.length("term") - (GRAM - 1), F.lit(1))))
    asked = terms.where(F.length("term") >= GRAM).select("t", "term", at.alias("at")).select("t", "term", F.substring("term", F.col("at"), F.lit(GRAM)).alias("gram"))
    sizes = found.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    shortest = asked.join(sizes, "gram").groupBy("t", "term").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    # a token that holds a pair of characters has it at either end of an n-gram
    ends = sizes.select("gram", F.explode(F.array(F.left("gram", F.lit(GRAM - 1)), F.right("gram", F.lit(GRAM - 1)))).alias("term"))
    pairs = terms.where(F.length("term") < GRAM).join(ends, "term").select("t", "term", "gram")
    met = shortest.unionByName(pairs).join(found.select("gram", "token"), "gram").where(F.contains("token", "term"))
    return met.select("t", "term", "token").distinct().select("t", "token", hits_in(F.col("term"), F.col("token")).alias("times"))
