"""Importance resampling against a plain version, with odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import importance_resampling as ir

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, score string, Rank string, text_hash string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], SCHEMA)


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def runs(text, n):
    w = split(text)
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def slow(rows, target, n=2, size=10_000, percent=25, least=20):
    bucket = lambda f: zlib.crc32(f.encode()) % size
    s = Counter(bucket(f) for _, t in rows for f in runs(t, n))
    t = Counter(bucket(f) for x in target for f in runs(x, n))
    sums, sumt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sums + size) / ((s[b] + 1) * (sumt + size))))
    out = []
    for i, text in rows:
        found = [gain(bucket(f)) for f in runs(text, n)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(split(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    good = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    return out, good[: len(good) * percent // 100]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [*(f"W{k}" for k in range(90)), *(f"é{k}ß" for k in range(30)), "a.b", "x_y", "Straße", "İ", " ", "ﬀ"]
    text = lambda most: rng.choice(" \n\t-,").join(rng.choice(vocabulary) for _ in range(rng.randint(0, most)))
    rows = [(k, text(60)) for k in range(150)]
    rows += [(900, None), (901, ""), (902, "  .. \x00"), (903, "one"), (None, text(60) + " w1" * 30), (5, rows[5][1]), (5, rows[6][1]), (904, "long " * 3000)]
    return rows, [text(40) for _ in range(20)] + [None, ""]


@pytest.mark.parametrize(("seed", "n", "size"), [(1, 2, 10_000), (2, 1, 500), (3, 4, 97)])
def test_scores_and_ranks(spark, monkeypatch, seed, n, size):
    monkeypatch.setattr(ir, "PIECE", 100)
    rows, target = corpus(seed)
    goal = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    got = ir.importance_resampling(frame(spark, rows).repartition(3), goal, features=ir.Features(n, size)).collect()
    every, drawn = slow(rows, target, n, size)
    assert sorted(((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got), key=repr) == sorted(every, key=repr)
    ranks = sorted((r["rank"], r["score"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got if r["rank"] is not None)
    assert ranks == [(k, r[4], -1 if r[0] is None else r[0]) for k, r in enumerate(drawn, 1)]


def test_drawn_rows_keep_their_columns(spark):
    rows, target = corpus(4)
    docs = frame(spark, rows)
    found = ir.resampled(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=40)
    assert found.columns == docs.columns
    _, drawn = slow(rows, target, percent=40)
    ids = {r[0] for r in drawn}
    assert {r["doc_id"] for r in found.collect()} == ids and len(drawn) <= found.count() <= len(drawn) + 2


def test_empty_tables(spark):
    none = frame(spark, [])
    rows, target = corpus(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert ir.importance_resampling(none, goal).collect() == []
    got = ir.importance_resampling(frame(spark, rows), goal.where("false")).collect()
    every, _ = slow(rows, [])
    assert sorted(r["score"] for r in got) == sorted(r[4] for r in every)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_the_ring_goes_on_from_piece_to_piece(n):
    rng = random.Random(n)
    words = [rng.choice(["a", "bb", "é", "ccc"]).encode() for _ in range(60)]
    ring, got = ir.Ring(n), []
    i = 0
    while i < len(words):
        j = i + rng.randint(1, 7)
        got += ring.extend(words[i:j]).tolist()
        i = j
    assert sorted(got) == sorted(zlib.crc32(b" ".join(words[a : a + k])) for k in range(1, n + 1) for a in range(len(words) - k + 1))


def test_whole_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(ir, "PIECE", 50)
    text = ("word " * 40 + "x" * 500 + " end.").encode()
    found = [w for p in ir.pieces(text) for w in p]
    assert found == [b"word"] * 40 + [b"x" * 500, b"end"] and max(len(p) for p in ir.pieces(text)) < 20
    assert sum(len(x) for _, x in ir.Features().of(text)) == 42 + 41
    assert np.array_equal(np.concatenate([x for _, x in ir.Features().of(b"A b")]), [zlib.crc32(b"a") % 10_000, zlib.crc32(b"b") % 10_000, zlib.crc32(b"a b") % 10_000])
