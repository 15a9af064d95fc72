"""Substring dedup, the n-gram join, components and source mixing against brute force, with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import blocks, components, ngram_join, source_mixing, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, block string, root string"


def frame(spark, rows):
    """Rows with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"W{k}" if k % 7 else f"é{k}" for k in range(300)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90))) for _ in range(n // 3)]
    while len(texts) < n:
        base = rng.choice(texts).split(" ")
        for _ in range(rng.choice((0, 1, 2, 6))):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        texts.append(" ".join(base))
    rows = [*enumerate(texts), (n, None), (n + 1, ""), (n + 2, " \n"), (0, texts[0]), (None, texts[1]), (None, None), (n + 3, texts[2].upper())]
    return rows


def slow_substrings(rows, window):
    split = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[j : j + window]) for w in split for j in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, split):
        gone = {p for j in range(len(w) - window + 1) if count[tuple(w[j : j + window])] > 1 for p in range(j, j + window)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "window", "fan"), [(1, 5, 1024), (2, 35, 1024), (3, 5, 4)])
def test_substring_dedup(spark, monkeypatch, seed, window, fan):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(blocks, "BUCKET_HASHES", 100)
    monkeypatch.setattr(blocks, "FAN", fan)  # with 4, hashes go through coarse and fine ranges
    rows = corpus(seed)
    found = substring_dedup.substring_dedup(frame(spark, rows), window)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in found.collect()]
    assert sorted(got, key=repr) == slow_substrings(rows, window)
    for r in found.collect():
        assert sum(x["end"] - x["start"] for x in r["removed"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["removed"], r["removed"][1:]))


def slow_join(rows, k, percent):
    sets = []
    for _, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = []
    for (i, _), s, g in zip(rows, sets, group):
        ids = [rows[x][0] for x in range(len(rows)) if group[x] == g and rows[x][0] is not None]
        out.append((i, len(s), min(ids) if ids else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 90), (2, 5, 80), (3, 2, 60)])
def test_ngram_join(spark, monkeypatch, seed, k, percent):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(blocks, "BUCKET_HASHES", 100 if percent == 80 else 1_000_000)
    monkeypatch.setattr(blocks, "FAN", 3 if percent == 80 else 1024)
    monkeypatch.setattr(ngram_join, "FEW_PAIRS", 2)
    monkeypatch.setattr(ngram_join, "TILE", 4)
    rows = corpus(seed)
    found = ngram_join.ngram_join(frame(spark, rows), k, percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in found), key=repr) == slow_join(rows, k, percent)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_partners_always_share_a_part(percent):
    """The candidate search loses no link: random pairs of any similarity at or above the bound share a key."""
    import numpy as np

    rng = np.random.default_rng(percent)
    for _ in range(400):
        union = int(rng.integers(1, 400))
        common = -(-union * percent // 100)
        elements = np.unique(rng.integers(0, 2**63, 2 * union + 20).astype(np.uint64))[:union]
        rng.shuffle(elements)
        cut = int(rng.integers(common, union + 1))
        a, b = np.sort(elements[:cut]), np.sort(np.concatenate([elements[:common], elements[cut:]]))
        tokens, at = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
        keys, owner = ngram_join.part_keys(tokens, at, percent)
        assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist()), (union, common, cut)


def slow_kept(rows, k, percent):
    """One row of each component: smallest id, then smallest MD5 of the text; equal rows count as one."""
    words = lambda t: WORD.findall((t or "").lower())
    sets = [{tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if (w := words(t)) else set() for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    md5 = lambda t: hashlib.md5((t or "").encode()).digest()
    best = {}
    for (i, t), g, s in zip(rows, group, sets):
        if s:
            best[g] = min(best.get(g, (True, 0, b"z", None)), (i is None, i or 0, md5(t), t))
    return sorted([(None if x[0] else x[1], x[3]) for x in best.values()] + [r for r, s in zip(rows, sets) if not s], key=repr)


@pytest.mark.parametrize("percent", [80, 90])
def test_partners_share_a_rare_element(percent):
    rng = random.Random(percent)
    shared = [f"s{j}" for j in range(60)]
    texts = []
    for d in range(120):
        own = [f"d{d}w{j}" for j in range(rng.randint(0, 60))]
        base = shared[: rng.randint(10, 60)] + own
        texts += [" ".join(base), " ".join(base[rng.randint(0, 8) :]), " ".join([*base, *(f"x{j}" for j in range(rng.randint(0, 12)))])]
    tokens, at = ngram_join.shingle_sets(pa.chunked_array([pa.array(texts)]), 3)
    counts = np.bincount(ngram_join._slots(tokens), minlength=1 << ngram_join.SLOT_BITS)
    batch = pa.record_batch([pa.array([str(i).encode() for i in range(len(texts))]), pa.array(texts)], names=["digest", "text"])
    (out,) = ngram_join._rarest(iter([batch]), 3, percent, SimpleNamespace(value=counts))
    keys, sets = [set(x) for x in out["keys"].to_pylist()], [set(tokens[a:b].tolist()) for a, b in zip(at, at[1:])]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    assert len(links) > 100
    assert all(keys[a] & keys[b] for a, b in links)
    pairs = sum(bool(keys[a] & keys[b]) for a in range(len(sets)) for b in range(a))
    assert pairs < len(sets) ** 2 / 8  # all share the passage, few a rare element


@pytest.mark.parametrize("seed", [1, 2])
def test_crowded_parts(spark, monkeypatch, seed):
    """A passage that all documents share fills parts of otherwise different ones; some have near copies."""
    rng = random.Random(seed)
    passage = " ".join(f"p{j}" for j in range(25))
    rows = []
    for d in range(50):
        words = [passage, *(f"d{d // 2}w{j}" for j in range(14))]
        if d % 2:
            words[rng.randint(10, 14)] = "other"
        rows.append((d, " ".join(words)))
    monkeypatch.setattr(ngram_join, "FEW_PAIRS", 0)
    monkeypatch.setattr(ngram_join, "TILE", 4)
    crowds, plain = [], ngram_join.rare_elements
    monkeypatch.setattr(ngram_join, "rare_elements", lambda crowd, *rest: crowds.append(crowd.count()) or plain(crowd, *rest))
    got = [tuple(r) for r in ngram_join.ngram_join(frame(spark, rows), 3, 80).collect()]
    assert sorted(got, key=repr) == slow_join(rows, 3, 80)
    assert crowds and crowds[0] > 10


def test_near_duplicates_remove_rows(spark):
    base = [f"a{k} b c d e f g{k} h" for k in range(4)]
    rows = [(3, base[0]), (1, base[0]), (5, base[0]), (5, base[1]), (2, base[2]), (2, base[2]), (None, base[0]), (None, base[3]), (None, base[3]), (9, None), (9, ""), (9, ""), (1, base[2]), (0, base[3].upper())]
    columns = "doc_id long, text string, `__text` string, digest string, root string, k string, first string, `row` string"
    df = spark.createDataFrame([(*r, "x", "y", "z", str(n) if r != (2, base[2]) else None, "f", "r") for n, r in enumerate(rows)], columns)
    found = ngram_join.near_duplicates(df)
    assert found.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=repr) == slow_kept(rows, 5, 80)
    odd = [(i, t) for i, t in corpus(5) if t is None or t == t.strip()]
    found = ngram_join.near_duplicates(frame(spark, odd), 3, 70).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in found), key=repr) == slow_kept(odd, 3, 70)


def test_repeated_rows_that_differ_elsewhere(spark):
    """The row that stays does not depend on the plan."""
    rows = [(1, "a b c d e f g", n) for n in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n int")
    kept = {tuple(ngram_join.near_duplicates(df.repartition(p)).collect()) for p in (1, 3, 7)}
    assert len(kept) == 1 and len(next(iter(kept))) == 1


def test_one_passage_fills_every_document(spark, monkeypatch):
    """A hash reaches its range once for each block, however often the block holds it."""
    import numpy as np

    table = blocks.segments(3, np.array([7, 7, 5, 7, 2**63, 5], np.uint64), 4, 8)
    assert table["hashes"].to_pylist() == [np.array(x, "<u8").tobytes() for x in ([5, 7], [2**63])]
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(blocks, "BUCKET_HASHES", 500)
    monkeypatch.setattr(blocks, "TASK_BYTES", 5000)
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(k, f"{' '.join(str(rng.random()) for _ in range(rng.randint(1, 30)))} {passage} {passage} end{k}") for k in range(400)]
    found = substring_dedup.substring_dedup(frame(spark, rows), 35)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept_text"]) for r in found.collect()]
    assert sorted(got, key=repr) == slow_substrings(rows, 35)


@pytest.mark.parametrize("fan", [1024, 2])
def test_flags_are_confirmed(spark, monkeypatch, fan):
    """First hashes that collide all the time do no harm: second ones decide."""
    import numpy as np
    import pyarrow as pa

    monkeypatch.setattr(blocks, "FAN", fan)
    monkeypatch.setattr(blocks, "BUCKET_HASHES", 50)
    rng = random.Random(9)
    values = [rng.randrange(400) for _ in range(300)]
    df = spark.createDataFrame([(k % 7, str(v)) for k, v in enumerate(values)], "block int, text string").selectExpr("block", "text", "monotonically_increasing_id() AS doc_id")

    def hashes(table, many):
        from corpusloom.llm import words

        v = np.array(table["text"].to_pylist(), np.int64).astype(np.uint64)
        return [words.mix(v % np.uint64(6)), words.mix(v + np.uint64(1))][:many]

    def finish(table, flags):
        return pa.table({"text": table["text"], "flag": pa.array(flags)})

    found = blocks.with_repeats(df, hashes, finish, "text string, flag boolean", 1000, 300, 5, confirm=True).collect()
    assert sorted((int(r["text"]), r["flag"]) for r in found) == sorted((v, values.count(v) > 1) for v in values)


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (102, 101), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r["node"]: r["root"] for r in components.components(df).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100, 102: 100}
    assert components.components(df.where("a > 1000")).count() == 0


def test_mixing(spark):
    rows = [(k, f"t{k}", "hot" if k % 3 else f"s{k % 9}", "c") for k in range(3000)]
    rows += [(None, None, None, "c"), (None, "", "hot", "c"), (1, "t1", "hot", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy string")
    found = source_mixing.mix_sources(docs).cache()
    counts = {r["source"]: r["n"] for r in found.groupBy("source").agg(F.count("*").alias("n")).collect()}
    expected = len(rows) / 5  # sources: hot, three others, null
    assert all(abs(counts[s] - expected) < 5 * expected**0.5 for s in ("hot", "s0", "s3", "s6"))
    again = source_mixing.mix_sources(docs.repartition(7))
    assert sorted(found.collect(), key=repr) == sorted(again.collect(), key=repr)
    per_row = found.groupBy("doc_id", "text", "n_copies").agg(F.count("*").alias("n"), F.max("copy").alias("m")).where("doc_id <> 1")
    assert per_row.where("n <> n_copies OR m <> n_copies").count() == 0
    weights = spark.createDataFrame([("hot", 1.0), ("s0", 0.0), ("s3", None), ("absent", 5.0)], "source string, weight double")
    only = source_mixing.mix_sources(docs, weights, target_rows=100_000).groupBy("source").count().collect()
    assert [r["source"] for r in only] == ["hot"] and abs(only[0]["count"] - 100_000) < 5 * 100_000**0.5
    assert source_mixing.mix_sources(docs.limit(0)).count() == 0
    one = spark.createDataFrame([(1, "t", "s"), (2, "u", "r")], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("s", 1.0)], "source string, weight double")
    many = source_mixing.mix_sources(one, weights, target_rows=30_000)  # in spans of copies
    found = many.agg(F.count("*"), F.count_distinct("copy"), F.min("copy"), F.max("copy"), F.max("n_copies"), F.max("doc_id")).first()
    assert found[0] == found[1] == found[3] == found[4] and found[2] == found[5] == 1 and abs(found[0] - 30_000) < 1000


def test_poisson_is_inverted(spark):
    """Copies equal the quantile of the row's own uniform number."""
    import math

    docs = spark.createDataFrame([(k, "t", "a" if k % 4 else "b") for k in range(400)], "doc_id long, text string, source string")
    counts = {r["doc_id"]: r["n_copies"] for r in source_mixing.mix_sources(docs).select("doc_id", "n_copies").distinct().collect()}
    for k in range(400):
        mean = 0.5 * 400 / (300 if k % 4 else 100)
        u = int(hashlib.md5(f"17:{k}:1".encode()).hexdigest()[:13], 16) / 2**52
        n, p = 0, math.exp(-mean)
        total = p
        while u >= total:
            n += 1
            p *= mean / n
            total += p
        assert counts.get(k, 0) == n


@pytest.mark.parametrize("operator", [substring_dedup.substring_dedup, ngram_join.ngram_join, ngram_join.near_duplicates])
def test_empty_tables(spark, operator):
    assert operator(frame(spark, [(1, "x")]).limit(0)).count() == 0
