import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexhaven.llm import common

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(word):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), word)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉ \n\t,x \x1c", max_size=30), max_size=8))
def test_words_are_hashed_as_they_are_split(texts):
    hashes, first = common.words_of(pa.array(texts, pa.string()))
    words = [[lower(w) for w in WORD.findall(t)] for t in texts]
    assert [len(w) for w in words] == np.diff(first).tolist()
    flat = [w for own in words for w in own]
    by_word = {}
    assert all(by_word.setdefault(w, h) == h for w, h in zip(flat, hashes.tolist(), strict=True))
    assert len(set(by_word.values())) == len(by_word)


def test_hash_does_not_depend_on_place_or_block():
    words = [f"w{i}" for i in range(200_000)]
    whole, _ = common.words_of(pa.array([" ".join(words)]))
    apart, _ = common.words_of(pa.array(words[-500:]))
    assert whole[-500:].tolist() == apart.tolist()


def test_shingles_stay_within_a_text():
    texts = ["a b c d e", "a b c d", "a b", None, "", "b a"]
    values, places = common.shingles(*common.words_of(pa.array(texts)), 4)
    assert np.diff(places).tolist() == [2, 1, 1, 0, 0, 1]
    assert values[0] == values[2] and len(set(values.tolist())) == 4


def test_batches_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["x" * n for n in (5, 0, 50, 1, 1)] + [None]})
    parts = list(common.batches_of(batch, limit=10))
    assert [t for p in parts for t in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert len(parts) > 2
