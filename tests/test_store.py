"""The versioned store, updates by change, search from postings, and settings as a table."""

from __future__ import annotations

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import postings, search
from corpusloom.sources import files, versions
from corpusloom.sources.index_store import build_index, load_index, open_index
from corpusloom.sources.settings import DocumentSettings, SettingsFolder
from corpusloom.sources.workspace import Workspace

WORDS = "alpha beta gamma delta epsilon eta theta lambda_x Straße état naïve x2 state of the art".split()


def frame(spark, texts):
    rows = [(k, path[:-4], path[:-4], path, text) for k, (path, text) in enumerate(sorted(texts.items()))]
    return spark.createDataFrame(rows, "doc_ord long, document_id string, stem string, file_path string, text string")


def corpus(seed, n):
    rng = random.Random(seed)
    paragraph = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randint(8, 60)))
    return {f"f{k:04}.txt": "\n\n".join(paragraph() for _ in range(rng.randint(0, 8))) for k in range(n)}


def rows(df, *order):
    return sorted((tuple(str(x) for x in r) for r in df.select(sorted(df.columns)).collect()))


@pytest.fixture
def small_buckets(monkeypatch):
    monkeypatch.setattr(versions, "FILES_EACH", 25)


def test_an_update_gives_what_a_rebuild_gives(spark, tmp_path, small_buckets):
    texts, path = corpus(1, 400), str(tmp_path / "index")
    first = open_index(frame(spark, texts), path)
    assert first.facts["written"] == 16 and first.facts["changed"] == 400 and not first.facts["moved"]
    before = versions.Store(spark, path).current()
    texts["f0123.txt"] = "A text that is new, and long enough to be a section of its own."
    one = open_index(frame(spark, texts), path)
    now = versions.Store(spark, path).current()
    assert one.facts["written"] == 1 and one.facts["changed"] == 1 and not one.facts["moved"]
    for table in ("sections", "postings", "grams"):
        assert sum(now.parts[table][b] != v for b, v in before.parts[table].items()) == 1
    again = open_index(frame(spark, texts), path)
    assert versions.Store(spark, path).current().name == now.name and again.totals == one.totals
    del texts["f0007.txt"], texts["f0300.txt"]
    texts |= {"a first.txt": texts["f0001.txt"], "f0123b.txt": "", "z last.txt": texts["f0002.txt"]}
    texts["f0050.txt"] += "\n\nAnd a paragraph that was not there before, with some words."
    last = open_index(frame(spark, texts), path)
    whole = open_index(frame(spark, texts), str(tmp_path / "whole"))
    assert last.facts["moved"] and last.facts["written"] <= 6 and last.totals == whole.totals
    for table in ("sections", "postings", "grams"):
        assert rows(getattr(last, table).distinct()) == rows(getattr(whole, table).distinct())
    assert rows(last.files.drop("doc_key")) == rows(whole.files.drop("doc_key"))
    assert rows(build_index(frame(spark, texts)).sections) == rows(whole.sections)
    for query in ("section", "art of the state"):
        assert last.search(query, limit=20).collect() == search.search(whole.sections, query, limit=20).collect()
    other = open_index(frame(spark, texts), path, DocumentSettings(max_section_size=1000))
    assert other.facts["written"] == versions.buckets_for(401) == 17 and other.totals[0] == other.sections.count()


def test_a_failed_update_leaves_the_index_as_it_was(spark, tmp_path, monkeypatch):
    texts, path = corpus(2, 30), str(tmp_path / "index")
    held = open_index(frame(spark, texts), path)
    was = rows(held.sections)
    texts["f0003.txt"] = "Something else that is long enough to be a section."
    with monkeypatch.context() as m:
        m.setattr(versions.Draft, "_point", lambda self: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            open_index(frame(spark, texts), path)
    assert rows(load_index(spark, path).sections) == was
    open_index(frame(spark, texts), path)
    assert rows(held.sections) == was and rows(load_index(spark, path).sections) != was  # a reader keeps its version
    texts["f0003.txt"] = "Something else again that is long enough to be a section."
    open_index(frame(spark, texts), path)
    folders = [d for d in os.listdir(f"{path}/sections") if any(f.endswith(".parquet") for _, _, x in os.walk(f"{path}/sections/{d}") for f in x)]
    assert len(folders) <= 4 and load_index(spark, path).sections.count() == build_index(frame(spark, texts)).sections.count()


def test_an_empty_folder_and_its_first_document(spark, tmp_path):
    path = str(tmp_path / "index")
    none = open_index(frame(spark, {}), path)
    assert none.totals == (0, 0) and none.search("anything").collect() == [] and none.files.count() == 0
    one = open_index(frame(spark, {"a.txt": "A document, long enough to be a section."}), path)
    assert one.search("document").count() == 1
    assert open_index(frame(spark, {}), path).search("document").count() == 0


@pytest.mark.parametrize("few", [1000, 0])
def test_indexed_search_is_the_scan(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(search, "FEW", few)  # with 0, everything goes by joins
    monkeypatch.setattr(postings, "AUTOMATON_TERMS", few)
    index = open_index(frame(spark, corpus(3, 60)), str(tmp_path / "index"))
    asked = ["beta delta", "ta", "straße ÉTAT", "state of the art", "zzz", ""] if few else ["art of state", "x2 lambda_x"]
    found = {}
    for query, scope in [*((q, None) for q in asked), (asked[0], "f0007")]:
        found[query, scope] = index.search(query, scope, limit=20).collect()
        assert found[query, scope] == search.search(index.sections, query, scope, limit=20).collect(), (query, scope)
    queries = spark.createDataFrame([(k, q) for k, q in enumerate(asked)] + [(99, None)], "query_id long, query string")
    batch = sorted(search.search_batch(index.sections, queries, 20).collect(), key=lambda r: r["rank"])
    for k, query in enumerate(asked):
        one = [(r["document_id"], r["id"], r["relevance_score"]) for r in found[query, None]]
        assert [(r["document_id"], r["section_id"], r["relevance_score"]) for r in batch if r["query_id"] == k] == one


def test_indexed_search_with_keywords_and_overlaps(spark, tmp_path):
    index = open_index(frame(spark, corpus(4, 20)), str(tmp_path / "index"))
    odd = index.sections.withColumn("content_lc", F.concat(F.col("content_lc"), F.lit(" aaaa deltadelta a-b"))).withColumn("keywords", F.array(F.lit("Beta-word two"), F.lit("x")))
    found = postings.postings(odd).cache()
    index.sections, index.postings, index.grams = odd, found, postings.grams(found)
    for query in ("aa delta", "aaa", "two beta"):
        assert index.search(query, limit=20).collect() == search.search(odd, query, limit=20).collect()


def rows_read(spark, run):
    """Rows that all scans read while ``run`` runs."""
    store, sc = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    total = lambda: sum(s.inputRecords() for s in [stages.apply(k) for stages in [store.stageList(None, False, False, none, None)] for k in range(stages.size())])
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    before = total()
    run()
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return total() - before


def test_a_rare_term_reads_few_sections(spark, tmp_path):
    rng = random.Random(5)
    syllables = ["ta", "re", "mi", "lon", "ku", "vas", "pe", "dor"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    texts = {f"f{k:05}.txt": "\n\n".join(" ".join(word() for _ in range(40)) for _ in range(8)) for k in range(900)}
    texts["f00777.txt"] += "\n\n" + "a passage on zygomorphic flowers and little else " * 3
    index = open_index(frame(spark, texts), str(tmp_path / "index"), DocumentSettings(max_section_size=1000))
    n = index.totals[0]
    scanned = rows_read(spark, lambda: search.search(index.sections, "zygomorphic flowers").collect())
    read = rows_read(spark, lambda: index.sections.where("doc_ord = 777").collect())
    assert scanned >= n > 900 and read <= n / 10
    assert index.search("zygomorphic flowers").collect() == search.search(index.sections, "zygomorphic flowers").collect()


def test_scanned_files_keep_their_numbers(spark, tmp_path):
    """Partitions are joined by size, so a plan without texts deals files otherwise than one with them."""
    folder, rng = tmp_path / "in", random.Random(6)
    folder.mkdir()
    for k in range(120):
        (folder / f"d[{k}] +é%.txt").write_text("\n\n".join(" ".join(rng.choice(WORDS) for _ in range(40)) for _ in range(rng.randint(1, 60))))
    (folder / "e.txt").write_text("")  # Spark lists no empty file
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.shuffle.partitions": "17"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        docs = files.scan_texts(spark, str(folder))
        order = [r["file_path"] for r in docs.select("doc_ord", "file_path").orderBy("doc_ord").collect()]
        assert order == sorted(order) and [r[0] for r in docs.select("doc_ord").orderBy("doc_ord").collect()] == list(range(120))
        assert [r["file_path"] for r in docs.orderBy("doc_ord").collect()] == order
        index = build_index(docs)
        counts = {r["file_path"]: r["section_count"] for r in index.files.collect()}
        one = {r["file_path"]: r["n"] for r in index.sections.groupBy("doc_ord").agg(F.count(F.lit(1)).alias("n")).join(docs.select("doc_ord", "file_path"), "doc_ord").collect()}
        assert counts == one and min(counts.values()) > 0
        few = files.read_texts(spark, str(folder), order[3:5])
        assert sorted(r["file_path"] for r in few.collect()) == order[3:5] and files.read_texts(spark, str(folder), []).count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_settings_as_a_table(spark, tmp_path):
    folder = SettingsFolder(tmp_path)
    assert folder.table(spark).collect() == []
    folder.save_document("good one", DocumentSettings(max_section_size=2000))
    own = tmp_path / "individual"
    (own / "mark.json").write_text("﻿" + json.dumps({"extractByBold": True, "unknown": [1]}), encoding="utf-8")
    for name, text in (("cut", '{"maxSectionSize": 20'), ("kind", '{"maxSectionSize": "many"}'), ("list", "[1]"), ("empty", "")):
        (own / f"{name}.json").write_text(text)
    found = {r["stem"]: (r["settings"] is not None, r["error"]) for r in folder.table(spark).collect()}
    bad = (False, "no valid settings")
    assert found == {"good one": (True, None), "mark": (True, None), "cut": bad, "kind": bad, "list": bad}  # an empty file is no settings


def test_a_workspace_reads_what_has_changed(spark, tmp_path, small_buckets):
    space = Workspace(spark, str(tmp_path / "data"))
    space.scaffold()
    folder = tmp_path / "data" / "documents"
    for path, text in corpus(7, 60).items():
        (folder / path).write_text(text + "\n\nA line that makes each text long enough to be a section.")
    (tmp_path / "data" / "config" / "individual").mkdir(parents=True)
    (tmp_path / "data" / "config" / "individual" / "f0001.json").write_text("{broken")
    first = space.refresh()
    assert first.facts["documents"] == 60 == space.counters()["cleaned"]
    assert [r["stem"] for r in space.settings_errors().collect()] == ["f0001"]
    (folder / "f0030.txt").write_text("A text that has changed, and is long enough, with ├ a trace Γ.")
    os.utime(folder / "f0030.txt", (2_000_000_000, 2_000_000_000))
    (folder / "f0031.txt").unlink()
    second = space.refresh()
    assert second.facts["changed"] == 2 and second.facts["documents"] == 59 and space.documents().count() == 59
    assert space.counters() == {"documents": 59, "cleaned": 59, "with_traces": 1, "converted": 0, "failed": 0}
    assert second.search("changed").count() == 1 and sorted(r["doc_ord"] for r in second.files.collect()) == list(range(59))
    third = space.refresh(rebuild=True)
    assert rows(third.sections) == rows(second.sections) and third.facts["changed"] == 59
