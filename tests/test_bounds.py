"""What a task holds is bounded, however much it reads."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corpusloom.operators import postings
from corpusloom.operators import segment as s
from corpusloom.sources.settings import DocumentSettings, to_json


def test_sections_leave_in_small_batches():
    paragraph = "A sentence of a paragraph that is long enough. " * 20
    texts = ["\n\n".join([paragraph] * 500), None, "", *["\n\n".join([paragraph, f"number {k} of the short documents here"]) for k in range(1500)]]
    batch = pa.record_batch({"doc_ord": list(range(len(texts))), "document_id": [f"d{k}" for k in range(len(texts))], "text": texts, "settings": pa.nulls(len(texts), pa.string())})
    out = list(s.cut(iter([batch, batch]), to_json(DocumentSettings())))
    assert len(out) >= 3 and max(sum(b["char_count"].to_pylist()) for b in out) < s.HELD + 2 * 1500
    rows = [(r["doc_ord"], r["section_id"], r["title"], r["content"], r["prev_section_id"]) for b in out for r in b.to_pylist()]
    ids = lambda found: [None, *(name for name, _, _ in found)]
    each = [(k, s.sections_of_text(text or "", DocumentSettings())) for k, text in enumerate(texts)]
    assert rows == [(k, name, x.title, x.content, before) for k, found in each for (name, _, x), before in zip(found, ids(found))] * 2
    assert list(s.cut(iter([]), to_json(DocumentSettings()))) == []


def test_texts_are_cut_as_spark_cuts_them(spark):
    rng = random.Random(8)
    chars = "ab_é9Σς́١‿-. \n\r\t\x85  ½²ß\U00010330\U0001f600\U000e0100͸￿"
    texts = ["".join(rng.choice(chars) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", None, "".join(map(chr, range(0x3000)))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    known = [[w for w in r[0] or [] if len(w) > 1] for r in rows.orderBy("k").select(F.split("text", postings.NOT_TOKEN)).collect()]
    packed = np.frombuffer(zlib.decompress(postings.token_chars(spark)), np.uint8)
    cut = postings.cut_by(np.unpackbits(packed) == 0, texts).to_pylist()
    assert [[w for w in words if len(w) > 1] for words in cut] == known


def test_grams_are_packed_without_an_exchange(spark):
    words = ["ab", "abc", "aaaa", "straße", "é\U00010330x_", "x" * 300 + "yz" * 40]
    rows = spark.createDataFrame([(b, w) for b in (3, 1) for w in sorted(words) for _ in range(2)], "bucket int, token string").coalesce(1)
    packed = postings.packed_grams(rows)
    assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()
    found = packed.select("bucket", F.explode(F.split("tokens", " ")).alias("token"), "gram").collect()
    assert len(found) == len(set(found))
    assert set(found) == {(b, w, g) for b in (1, 3) for w in words for g in postings.grams_of(w)}
    assert [(r["bucket"], r["gram"]) for r in packed.collect()] == sorted({(r["bucket"], r["gram"]) for r in found})
