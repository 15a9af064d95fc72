"""Batch search keeps a few rows a query in each task and writes no pairs."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from corpusloom.operators import batch, search
from corpusloom.operators.segment import segment

WORDS = "alpha beta gamma delta eta theta lambda_x Straße état naïve x2 state of the art aaaa".split()


def test_blocks_and_joins_agree_and_no_pair_is_written(spark, monkeypatch):
    rng = random.Random(11)
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    docs = [(k, f"d{k}", "\n\n".join(say(rng.randint(8, 90)) for _ in range(4)) if k % 9 else "same words in art of state and more") for k in range(60)]
    sections = segment(spark.createDataFrame(docs, "doc_ord long, document_id string, text string").repartition(3)).withColumn("keywords", F.array(F.lit("Beta-word")))
    sections = sections.withColumn("content_lc", F.when(F.col("doc_ord") != 5, F.col("content_lc"))).cache()  # null texts, too
    asked = [(k, say(rng.choice((1, 2, 2, 3, 30)))) for k in range(25)] + [(3, "aa eta"), (None, "art state"), (50, "zzz"), (51, "the"), (52, None), (53, "section")]
    queries = spark.createDataFrame(asked, "query_id long, query string")
    written, stash = [], search.stash
    monkeypatch.setattr(search, "stash", lambda df, name, **o: written.append(name) or stash(df, name, **o))
    monkeypatch.setattr(batch, "CELLS", 200)
    monkeypatch.setattr(batch, "KNOWN", 7)
    order = ["query_id", "rank", "document_id", "section_id"]
    found = search.search_batch(sections, queries, 7).orderBy(*order).collect()
    assert written == ["queries"] and len(found) > 100
    monkeypatch.setattr(search, "FEW_TERMS", 0)
    assert search.search_batch(sections, queries, 7).orderBy(*order).collect() == found
