"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import extended, prepare

SPACE = "▁"
#: Words kept with their pieces by one Python worker, and the longest word that is kept.
CACHE_WORDS, CACHE_LENGTH = 150_000, 40
#: Characters of one Viterbi run, beyond which a text is cut where no piece crosses.
RUN = 1 << 16
#: What a character without a piece scores below the lowest piece.
UNKNOWN_PENALTY = 10.0


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Encoder(dict):
    """Word -> packed int32 ids, for the word with a space symbol before it. Words are encoded on first use.

    A path's score is the sum of its pieces' scores; among paths of the same score the longer last piece wins, at every
    position. Characters without a piece become byte pieces (or the unknown id where the model has none).
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        texts = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.automaton = ahocorasick.Automaton()
        for i in plain:
            self.automaton.add_word(texts[i], (len(texts[i]), model.get_score(i), i))
        self.automaton.make_automaton()
        self.longest = max(len(texts[i]) for i in plain)
        self.unknown = min(model.get_score(i) for i in plain) - UNKNOWN_PENALTY
        self.unknown_id = model.unk_id()
        self.byte_ids = {int(texts[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        #: Bytes that each id stands for; control pieces stand for nothing.
        self.surface = [b""] * n
        for i in plain:
            self.surface[i] = texts[i].replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.surface[i] = bytes([b])
        self.surface[self.unknown_id] = " ⁇ ".encode()
        #: Where no piece has a space symbol after another character, words can be encoded one by one.
        self.by_word = all(SPACE not in texts[i].lstrip(SPACE) for i in plain)

    def __missing__(self, word: str) -> bytes:
        packed = self.packed(SPACE + word)
        if len(word) <= CACHE_LENGTH:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = packed
        return packed

    def viterbi(self, text: str) -> list[int]:
        """The best path: pieces that end at a position come from the automaton's state and its output links."""
        n, unknown = len(text), self.unknown
        best, size_at, piece_at = [0.0] * (n + 1), [1] * (n + 1), [-1] * (n + 1)
        at, single = 0, True
        for last, (size, score, piece) in self.automaton.iter(text):
            if last >= at:  # the first piece that ends here, so what ended before is final
                if not single and best[at - 1] + unknown > best[at]:
                    best[at], size_at[at], piece_at[at] = best[at - 1] + unknown, 1, -1
                for at in range(at + 1, last + 1):
                    best[at] = best[at - 1] + unknown
                at, single = last + 1, False
                best[at] = best[at - size] + score
                size_at[at], piece_at[at] = size, piece
            elif (sum_ := best[at - size] + score) > best[at]:
                best[at], size_at[at], piece_at[at] = sum_, size, piece
            if size == 1:
                single = True
        if not single and best[at - 1] + unknown > best[at]:
            best[at], size_at[at], piece_at[at] = best[at - 1] + unknown, 1, -1
        out, p = [], n
        while p:
            if (piece := piece_at[p]) >= 0:
                out.append(piece)
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in reversed(text[p - 1].encode()))
            else:
                out.append(self.unknown_id)
            p -= size_at[p]
        out.reverse()
        return out

    def cuts(self, text: str) -> list[int]:
        """Ends of runs of about RUN characters that no piece of the text crosses, so that every path passes them."""
        out, at = [], 0
        while len(text) - at > RUN + 2 * self.longest:
            reach = RUN
            while True:  # from here on, look for a place between pieces; a text of overlapping ones is one run
                low, high = at + reach, min(len(text), at + 2 * reach)
                crossed = np.zeros(high - low + 1, np.int32)
                begin = max(at, low - self.longest)
                for last, (size, _, _) in self.automaton.iter(text[begin : min(len(text), high + self.longest)]):
                    a, b = begin + last + 2 - size, begin + last + 1  # a piece crosses the places a .. b - 1
                    if a < b and b > low and a <= high:
                        crossed[max(a, low) - low] += 1
                        if b <= high:
                            crossed[b - low] -= 1
                free = np.flatnonzero(np.cumsum(crossed) == 0)
                if len(free) or high == len(text):
                    break
                reach *= 2
            if not len(free):
                break
            at = low + int(free[0])
            out.append(at)
        return [*out, len(text)]

    def packed(self, text: str) -> bytes:
        """Packed ids of the best path, in runs of bounded memory."""
        if len(text) <= 2 * RUN:
            return np.array(self.viterbi(text), np.int32).tobytes()
        ends = self.cuts(text)
        return b"".join(np.array(self.viterbi(text[a:b]), np.int32).tobytes() for a, b in zip([0, *ends], ends) if a < b)

    def encode(self, text: str) -> bytes:
        """Packed int32 ids of a whole text; a space symbol stands before it, as the models are made for."""
        if not text:
            return b""
        if not self.by_word:
            return self.packed(SPACE + text.replace(" ", SPACE))
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = [x[1:] for x in _RUNS.findall(SPACE + text.replace(" ", SPACE))]
        else:
            words = text.split(" ")
        return b"".join(map(self.__getitem__, words))

    def decode(self, ids: np.ndarray) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        return raw[raw.startswith(b" ") :].decode("utf-8", "replace")


_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for a Python worker, kept between tasks."""
    return Encoder(path)


def encode(docs: DataFrame, column: str = "text", model_path: str | None = None) -> DataFrame:
    """``docs`` with ids (array<int>) and n_tokens: the best-scoring pieces of each whole text.

    Defined cases: a null text gives null ids and 0 tokens, an empty one gives empty ids; input columns of these two
    names are replaced; repeated rows are encoded alike; texts of any length are encoded whole; an empty table gives
    an empty result. ``model_path`` is a SentencePiece model file that every executor can open.
    """
    prepare(docs.sparkSession)
    docs, path = docs.drop("ids", "n_tokens"), model_path or default_model()
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            ids, n = _encode(coder, batch[column])
            yield pa.record_batch([*batch.columns, ids, n], names=[*names, "ids", "n_tokens"])

    return docs.mapInArrow(run, extended(docs.schema, "ids array<int>, n_tokens long"))


def _encode(coder: Encoder, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    packed = [None if x is None else coder.encode(x) for x in texts.to_pylist()]
    n = np.array([len(x or b"") // 4 for x in packed], np.int64)
    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), mask=np.array([x is None for x in packed] + [False]))
    values = pa.array(np.frombuffer(b"".join(x for x in packed if x), np.int32))
    return pa.ListArray.from_arrays(offsets, values), pa.array(n)


def decode(encoded: DataFrame, column: str = "ids", model_path: str | None = None) -> DataFrame:
    """``encoded`` with decoded: the text of each id list (null for null, empty for empty).

    Decoding undoes encoding exactly, except that a U+2581 of the text comes back as a space, and a character that a
    model without byte pieces doesn't know comes back as its unknown mark. An input column named decoded is replaced.
    """
    prepare(encoded.sparkSession)
    encoded, path = encoded.drop("decoded"), model_path or default_model()
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            lists = batch[column]
            texts = [coder.decode(x.values.to_numpy()) if x.is_valid else None for x in lists]
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, extended(encoded.schema, "decoded string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding them gives the text back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    back = decode(encode(docs))
    return back.select("doc_id", "n_tokens", "ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))
