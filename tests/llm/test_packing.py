import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexhaven.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["It's DON'T <|endoftext|> x<|endoftext|>, a,b ÄB'S é, é, x́, z İ 12 3a ... ,. a.\x1cb Σας ΣΑΣ",
       "a b ña, ñ; (x) x). 'tis o'clock, rock'n'roll's ,x", "ﬁne Ⅷ ½ ²x ☃☃, ☃. 你好, 世界。"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def checked(df, tokenizer, capacity=packing.CAPACITY):
    """Pieces make up each text's ids and each bin, without gaps."""
    rows = packing.pack(df, PATH, capacity=capacity).collect()
    by_doc, by_bin = {}, {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids
        by_doc.setdefault(r.doc_id, []).append((r.start, ids, r.doc_tokens))
        by_bin.setdefault(r.sequence_id, []).append((r.offset, len(ids)))
    for doc, text in ((r.doc_id, r.text) for r in df.collect()):
        pieces = sorted(by_doc.pop(doc))
        whole = [i for _, ids, _ in pieces for i in ids]
        assert [s for s, _, _ in pieces] == np.cumsum([0] + [len(i) for _, i, _ in pieces])[:-1].tolist()
        assert whole == ids_of(tokenizer, text) and {t for _, _, t in pieces} == {len(whole)}
    assert not by_doc
    for parts in by_bin.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [n for _, n in parts])[:-1].tolist()
        assert sum(n for _, n in parts) <= capacity
    return by_bin


def test_round_trip_and_padding(given, tokenizer):
    bins = checked(given("documents"), tokenizer)
    used = sum(n for parts in bins.values() for _, n in parts)
    assert used > 0.97 * packing.CAPACITY * (len(bins) - given("documents").rdd.getNumPartitions())


def test_odd_texts_are_coded_as_whole(docs, tokenizer):
    checked(docs(list(enumerate(ODD))), tokenizer, capacity=16)


def test_classes_hold_a_fixed_number():
    for size in range(1, 5000, 7):
        pieces = list(packing.pieces_of(size, 2048, packing.WASTE))
        assert sum(n for _, n, _ in pieces) == size
        for _, n, kind in pieces:
            assert n == 2048 if kind == 0 else n * kind <= 2048
    packer = packing.Packer(3, 100, 0.0)
    rows = [r for size in (50, 50, 30, 30, 30, 7) for r in packer.add(("d", size), b"\0" * 4 * size)]
    rows += packer.finish()
    assert sum(len(r[2]) // 4 for r in rows) == 197


def test_checksum(docs):
    row = packing.pack(docs([(1, "hello world")]), PATH).select("ids", F.crc32("ids").alias("c"), packing.piece_length().alias("n")).first()
    assert row.c == zlib.crc32(bytes(row.ids)) and row.n == len(row.ids) // 4


def test_edges(edges, docs, tokenizer):
    checked(edges, tokenizer)
    empty = packing.pack(docs([(1, None), (2, "")]), PATH).collect()
    assert [(r.start, bytes(r.ids), r.doc_tokens) for r in empty] == [(0, b"\1\0\0\0", 1)] * 2
    assert packing.pack(docs([]), PATH).count() == 0


def test_ids_of_many_odd_strings(tokenizer):
    rng = random.Random(8)
    bits = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<|", "|>", "<", "|", ">", ";", ".", ",", "'", "'S", "'re",
            "a", "B", "It", "İ", "i̇", "é", "É", "é", "́", "ß", "ẞ", "Σ", "ς", "क़", "日", "Ⅷ", "²", "ªº", "ǅ", "3", "12", " ", "\t", "\x1c", "-", "…"]
    texts = ["".join(rng.choices(bits, k=rng.randint(1, 7))) for _ in range(20_000)]
    for at in range(0, len(texts), 2_000):
        part = texts[at:at + 2_000]
        ids, first = packing.encoder_of(PATH).encode(pa.array(part))
        got = [ids[a:b].tolist() for a, b in zip(first, first[1:])]
        want = [e.ids for e in tokenizer.encode_batch(part, add_special_tokens=False)]
        assert [(t, g) for t, g, w in zip(part, got, want) if g != w] == []


def test_remembered_chunks_take_few_bytes():
    """A worker keeps what it has learned beside the next stages."""
    rng = random.Random(4)
    chunks = [f"{rng.choice('abc')}{rng.randrange(10**9)}-{n}" for n in range(60_000)]
    encoder = packing.Encoder(PATH)
    encoder.encode(pa.array(["a-1 2"]))
    tracemalloc.start()
    try:
        for at in range(0, len(chunks), 5_000):
            encoder.encode(pa.array([" ".join(chunks[at:at + 5_000])]))
        kept = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    # Up to sixteen ids a chunk, of four bytes each.
    assert kept < 100 * len(chunks)


def test_forgetting_changes_no_ids(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 40)
    monkeypatch.setattr(packing, "REMEMBERED_PARTS", 5)
    rng = random.Random(6)
    encoder = packing.Encoder(PATH)
    for _ in range(30):
        texts = [" ".join(f"{rng.choice(['a', 'É', 'x-', '...'])}{rng.randrange(60)}" for _ in range(20)), *ODD]
        ids, first = encoder.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(first, first[1:])] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert len(encoder.parts) <= 5
    monkeypatch.setattr(packing, "REMEMBERED_IDS", 0)
    encoder.encode(pa.array(["b"]))
    assert len(encoder.known) == 1
