"""The column-wise suffix array and the dedup on it against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from corpusloom.llm import blocks, suffix_array, suffix_dedup, words

SCHEMA = "doc_id long, text string, block string, copies string, bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)


@pytest.mark.parametrize("seed", range(12))
def test_collection(monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(suffix_array, "SLICE", rng.choice([3, 50, 1 << 20]))
    strings = [bytes(rng.choice(b"ab\x00c"[: rng.randint(1, 4)]) for _ in range(rng.randint(1, 14))) for _ in range(rng.randint(1, 14))]
    lengths = np.array([len(s) for s in strings])
    built = suffix_array.Collection(np.frombuffer(b"".join(strings), np.uint8), np.cumsum(lengths) - lengths, lengths)
    every = [(s[len(s) - k :], i) for i, s in enumerate(strings) for k in range(len(s) + 1)]
    every.sort(key=lambda x: ([b + 1 for b in x[0]] + [0], x[1]))
    before = [suffix_array.BEGIN if len(s) == len(strings[i]) else strings[i][-len(s) - 1] for s, i in every]
    shared = [0]
    for (a, _), (b, _) in zip(every, every[1:]):
        same = [x == y for x, y in zip(a, b)]
        shared.append(same.index(False) if False in same else len(same))
    assert built.transform.values.tolist() == before and built.common.values.tolist() == shared
    for window in (1, 2, 5):
        first, group = built.equal(window)
        named = {}
        for i, s in enumerate(strings):
            for p in range(len(s) - window + 1):
                assert named.setdefault(s[p : p + window], group[first[i] + p]) == group[first[i] + p]
        assert len(set(named.values())) == len(named)
    built.close()


def slow(rows, window):
    place = lambda i: suffix_dedup.LAST if i is None else i
    data = [(t or "").encode() for _, t in rows]
    low: dict[bytes, int] = {}
    for (i, _), b in zip(rows, data):
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            low[w] = min(low.get(w, place(i)), place(i))
    out = []
    for (i, _), b in zip(rows, data):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - window + 1):
            if low[b[p : p + window]] < place(i):
                gone[p : p + window] = True
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" if k % 5 else f"é{k}ü" for k in range(150)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passages = [text(12) for _ in range(4)]
    rows = []
    for k in range(70):
        body = text(rng.randint(0, 40))
        kind = rng.randrange(5)
        if kind == 0:
            body = f"{body} {rng.choice(passages)} {text(3)}"
        elif kind == 1 and rows:
            body = rng.choice(rows)[1][rng.randint(0, 30) :]
        elif kind == 2:
            body += passages[0] + body
        rows.append((rng.randrange(400), body))
    rows += [(500, None), (501, ""), (502, "=" * 700), (503, "=" * 300 + "x"), (None, rows[0][1]), (None, text(30)), (None, None)]
    return rows + [rows[3], rows[3], (rows[4][0], rows[5][1]), (504, "ab" * 200), (505, "b" + "ab" * 90), (506, text(1500))]


@pytest.mark.parametrize(("seed", "window", "anchor"), [(1, 50, 24), (2, 12, 5), (3, 50, 49), (4, 20, 1)])
def test_suffix_dedup(spark, monkeypatch, seed, window, anchor):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 20_000)
    monkeypatch.setattr(suffix_dedup, "COLLECTION_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "STRINGS_AT_ONCE", 7)
    monkeypatch.setattr(words, "PIECE", 500)
    rows = corpus(seed)
    found = suffix_dedup.suffix_dedup(frame(spark, rows), window, anchor).collect()
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in found]
    assert sorted(got, key=repr) == slow(rows, window)
    for r in found:
        assert sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"] and len(r["removed"]) == r["n_spans"]
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))


def test_empty_table(spark):
    assert suffix_dedup.suffix_dedup(frame(spark, [])).collect() == []
    assert [tuple(r)[:4] for r in suffix_dedup.suffix_dedup(frame(spark, [(1, None)])).collect()] == [(1, 0, 0, 0)]


def test_a_common_passage_does_not_gather_its_neighbours():
    """Strings that hold a common passage and text of their own get anchors outside it, so they don't meet."""
    rng = random.Random(5)
    passage = "a passage that a third of all documents hold, word by word, as a licence is"
    texts = ["".join(rng.choice("abcdefghijklmnop ") for _ in range(200)) for _ in range(600)]
    texts = [t[:100] + passage * (k % 3 == 0) + t[100:] for k, t in enumerate(texts)]
    import pyarrow as pa

    data, offsets = words.buffer(pa.array(texts))
    hashes = np.concatenate([suffix_dedup._hashes(data[a:b], 24)[1] for a, b in zip(offsets, offsets[1:])])
    counts = np.bincount(suffix_dedup._slots(hashes), minlength=1 << suffix_dedup.SLOT_BITS)
    none = np.zeros(len(counts), bool)
    largest = []
    for crowded in (none, counts > suffix_dedup.CROWDED * counts.mean() + 16):
        runs = suffix_dedup.runs_of(data, offsets, 50, 24, crowded)
        strings = {}
        for s, n, key in zip(runs.start.tolist(), runs.count.tolist(), runs.key.tolist()):
            strings.setdefault(key, set()).add(data[s : s + n + 49].tobytes())
        largest.append(max(map(len, strings.values())))
    assert largest[0] >= 100 and largest[1] <= 20


@pytest.mark.parametrize("n", [1, 3, 5000])
def test_repeated_rows_are_one(spark, n):
    """However often a row is repeated, a block holds it once, and each copy gets its result."""
    rows = spark.range(n).selectExpr("7L AS doc_id", "'some text' AS text").unionByName(spark.createDataFrame([(None, None)] * 3 + [(8, "x")], "doc_id long, text string"))
    found = blocks.different(rows)
    assert found.bytes == 9 * n + 1 and found.most == max(n, 3) and found.docs.count() == 3
    back = found.expanded(found.dealt())
    assert sorted(((r["doc_id"], r["text"]) for r in back.groupBy("doc_id", "text").count().collect()), key=repr) == [(7, "some text"), (8, "x"), (None, None)]
    assert {r["doc_id"]: r["count"] for r in back.groupBy("doc_id").count().collect()} == {7: n, 8: 1, None: 3}
