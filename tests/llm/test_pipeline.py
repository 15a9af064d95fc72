"""The pipeline's stages on a small corpus."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import pieces, queries
from corpusloom.session import stash


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    vocab = {"aa": "the and thing with from that this".split(), "bb": "les çon été que dans pour avec".split()}
    rows = []
    for k in range(80):
        lang = ("aa", "bb")[k % 2]
        text = " ".join(rng.choice(vocab[lang]) + rng.choice("abcdefgh") for _ in range(60))
        if k % 8 == 0:
            text += f" password={'%020x' % rng.getrandbits(80)}"
        rows.append((k, text, lang, f"s{k % 3}", len(text)))
    rows += [(200, rows[3][1] + " more", "bb", "s0", 0), (201, rows[3][1], "bb", "s0", 0), (202, None, "aa", None, None), (203, "123", None, "s1", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, str(tmp_path)), name)
        kept[name] = docs
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == corpus_pipeline.COLUMNS
    ids = lambda name: sorted(r["doc_id"] for r in kept[name].collect())
    assert ids("language_id") == [*range(80), 200, 201]
    assert ids("ngram_join") == list(range(80))
    texts = {r["doc_id"]: r for r in kept["secret_scan"].collect()}
    assert all((r["text"] == rows[k][1]) == (k % 8 != 0) and r["n_chars"] == len(r["text"]) for k, r in texts.items())
    assert not any("password=" in r["text"] for r in texts.values())
    assert set(ids("source_mixing")) <= set(range(80))
    coder = pieces.encoder(pieces.default_model())
    import numpy as np

    for r in kept["sentencepiece"].collect():
        assert coder.decode(np.array(r["ids"], np.int32)) == texts[r["doc_id"]]["text"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == kept["sentencepiece"].count()


def test_predictions_set_the_language(spark):
    rng = random.Random(2)
    vocab = {"aa": "the and thing with from that this".split(), "bb": "les çon été que dans pour avec".split()}
    rows = [(k, " ".join(rng.choice(vocab[lang]) for _ in range(60)), lang, "s", 0) for k in range(80) for lang in [("aa", "bb")[k % 2]]]
    wrong = [(100, rows[0][1], "bb", "s", 0), (101, rows[1][1], None, "s", 0)]
    docs = spark.createDataFrame([*rows, *wrong], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert found == {r[0]: r[2] for r in rows} | {100: "aa", 101: "bb"}


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.SQL) <= set(queries.QUERIES)


CLASHING = ["lang_pred", "score", "so_far", "bits", "share", "spans", "n_copies", "copy", "shuffle_key", "ids", "n_tokens", "block", "copies", "span", "root", "digest", "keys"]


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, "")
        assert found.collect() == [], name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert found.columns == corpus_pipeline.COLUMNS


def test_stages_take_clashing_columns_and_odd_rows(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice("the and thing with from that this".split()) for _ in range(n))
    rows = [(k, text(30), "aa", f"s{k % 2}", 1) for k in range(30)] + [(None, None, None, None, None), (31, "", "aa", None, 0), (3, None, "aa", "s0", 0)]
    rows += [rows[4], rows[4], (None, "text under no id at all", None, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in CLASHING:
        docs = docs.withColumn(name, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        plain = stage(spark, docs.select(corpus_pipeline.COLUMNS), "")
        found = stage(spark, docs, "")
        assert found.columns == plain.columns and sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect())), name
