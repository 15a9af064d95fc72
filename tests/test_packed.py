"""Postings are packed where sections are read, and stored sections have no second text."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusloom.operators import postings, search
from corpusloom.operators.segment import segment
from corpusloom.sources.index_store import load_index, open_index


def test_packed_postings_and_lean_sections(spark, tmp_path, monkeypatch):
    rng, path = random.Random(3), str(tmp_path / "index")
    words = "alpha beta gamma Straße ÉTAT İstanbul ΣΊΣΥΦΟΣ x2 of".split()
    rows = [(k, f"d{k}", f"d{k}", f"d{k}.txt", " ".join(rng.choice(words) for _ in range(rng.randint(5, 80)))) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_ord long, document_id string, stem string, file_path string, text string")
    sections = segment(docs).cache()
    plan = postings.packed(sections, F.lit(0))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    plain = sorted(map(tuple, postings.postings(sections).collect()))
    monkeypatch.setattr(postings, "SEGMENT", 50)
    open_index(docs, path)
    index = load_index(spark, path)
    assert sorted(map(tuple, index.postings.collect())) == plain
    assert sorted(map(tuple, index.grams.distinct().collect())) == sorted(map(tuple, postings.grams(postings.postings(sections)).collect()))
    assert index.sections.orderBy("doc_ord", "ord").collect() == sections.orderBy("doc_ord", "ord").collect()
    stored = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/postings")
    assert stored.count() < len(plain)
    lean = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/sections")
    assert lean.where("title_lc IS NOT NULL").count() == 0  # lower(title) gives it
    assert index.search("x2 beta", limit=20).collect() == search.search(sections, "x2 beta", limit=20).collect()


def test_many_tokens_are_sent_to_the_postings(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(k, f"d{k}", f"d{k}", f"d{k}.txt", f"a text with thing{k} and others, long enough") for k in range(30)], "doc_ord long, document_id string, stem string, file_path string, text string")
    index, sent, broadcast = open_index(docs, str(tmp_path / "index")), [], F.broadcast
    monkeypatch.setattr(search, "FEW", 3)
    monkeypatch.setattr(F, "broadcast", lambda df: sent.append(set(df.columns)) or broadcast(df))
    found = index.search("thing", limit=20).collect()
    assert {"term", "token", "times"} in sent
    assert found == search.search(index.sections, "thing", limit=20).collect()
