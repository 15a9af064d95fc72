"""Vectorised words and hashes against regular expressions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import words

TEXTS = st.lists(st.text(alphabet="aB é\n\t\x0b日😀.", max_size=40) | st.none(), max_size=6)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def taken(texts):
    data, offsets = words.buffer(pa.array(texts, pa.string()))
    starts, ends, first = words.split(data, offsets)
    raw = data.tobytes()
    found = [raw[a:b].decode() for a, b in zip(starts, ends)]
    return data, starts, ends, first, [found[first[i] : first[i + 1]] for i in range(len(texts))]


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_split_and_hashes(texts):
    data, starts, ends, first, found = taken(texts)
    assert found == [WORD.findall(x or "") for x in texts]
    flat = [w for d in found for w in d]
    hashes = words.hashes(data, starts, ends)
    assert len(set(hashes.tolist())) == len(set(flat))
    for k in (1, 3):
        got, at = words.shingles(hashes, first, k)
        for i, d in enumerate(found):
            grams = [tuple(d[j : j + k]) for j in range(len(d) - k + 1)] if len(d) >= k else [tuple(d)] * bool(d)
            assert at[i + 1] - at[i] == len(grams) and len(set(got[at[i] : at[i + 1]].tolist())) == len(set(grams))
        rolled, start, at = words.rolling(hashes, first, k)
        grams = [tuple(d[j : j + k]) for d in found for j in range(len(d) - k + 1)]
        assert len(rolled) == len(grams) and len(set(rolled.tolist())) == len(set(grams))


def test_pieces_do_not_change_hashes(monkeypatch):
    text = ["some words that are hashed " * 50, "and more " * 30]
    data, starts, ends, *_ = taken(text)
    whole = words.hashes(data, starts, ends)
    monkeypatch.setattr(words, "PIECE", 40)
    assert (words.hashes(data, starts, ends) == whole).all()
    sliced = pa.array(["x", *text, "y"]).slice(1, 2)
    assert words.buffer(sliced)[0].tobytes() == data.tobytes()
    assert np.diff(words.buffer(sliced)[1]).tolist() == [len(t) for t in text]
