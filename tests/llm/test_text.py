import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import text as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \t\n ß", max_size=40), max_size=8))
def test_words_are_hashed_alike(texts):
    data, offsets = T.column_bytes(pa.array(texts, pa.string()))
    hashes, at = T.word_hashes(data, offsets)
    seen: dict = {}
    for i, t in enumerate(texts):
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
        mine = hashes[at[i] : at[i + 1]]
        assert len(mine) == len(words)
        for w, h in zip(words, mine.tolist()):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_blocks_do_not_change_hashes(monkeypatch):
    texts = ["word " * 50, "", None, "x" * 300, " lead and trail ", "a b"]
    data, offsets = T.column_bytes(pa.array(texts, pa.string()))
    whole = T.word_hashes(data, offsets)
    monkeypatch.setattr(T, "BLOCK", 16)
    small = T.word_hashes(data, offsets)
    assert (whole[0] == small[0]).all() and (whole[1] == small[1]).all()


def test_shingles():
    w = np.arange(7, dtype=np.uint64)
    assert len(T.shingle_hashes(w)) == 3
    assert len(T.shingle_hashes(w[:3])) == 1
    assert len(T.shingle_hashes(w[:0])) == 0
    assert len(T.shingle_hashes(np.zeros(9, np.uint64))) == 1
