"""Helpers shared by the operators: words as 64-bit hashes, shingles, and tables between steps.

A word is a run of characters other than space and U+0009 to U+000D; hashes take A-Z as a-z.
Words are hashed over the Arrow buffer of a whole batch, not one by one.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
SPACE = "[\\x20\\x09-\\x0D]+"

# Bytes of text hashed at a time, so that work arrays stay in the cache.
BLOCK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; a bijection."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_one(x: int) -> int:
    return int(mix(np.array([x & 0xFFFFFFFFFFFFFFFF], np.uint64))[0])


@lru_cache(maxsize=1)
def _byte_values() -> np.ndarray:
    """A number for every byte, the same for both cases of a letter."""
    values = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
    values[65:91] = values[97:123]
    return values


_BASE = 0x9E3779B97F4A7C15 | 5


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an array of strings and the offset of each string; NULL counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word in bytes; the place of each text's first word among them."""
    inside = (data != 32) & (data - np.uint8(9) > 4)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def hash_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word; zero for none."""
    values = _byte_values()
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(stops, low + BLOCK, "right")))
        size = int(stops[to - 1] - low)
        up, down = _powers(1 << max(19, size.bit_length()))
        summed = np.zeros(size + 1, np.uint64)
        np.cumsum(values[data[low : low + size]] * up[:size], out=summed[1:])
        first = starts[at:to] - low
        raw = (summed[stops[at:to] - low] - summed[first]) * down[first]
        out[at:to] = mix(raw + (stops[at:to] - starts[at:to]).astype(np.uint64))
        at = to
    out[out == 0] = 1
    return out


def batches_of(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about so many bytes of text; a longer text stands alone."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, size = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > at and size + n > limit:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n
    if at < batch.num_rows:
        yield batch.slice(at)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and the place of each text's first word, with the end at last."""
    data, offsets = text_buffer(texts)
    starts, stops, first = word_bounds(data, offsets)
    return hash_words(data, starts, stops), first


def hash_word(word: str) -> int:
    """The hash of one word, the same as in a text."""
    hashes, _ = words_of(pa.array([word]))
    return int(hashes[0])


def combined(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` numbers, by its first place; shorter than the input by width - 1."""
    n = max(0, len(hashes) - width + 1)
    out = mix(hashes[:n])
    for k in range(1, width):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n])
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of every text, repeats included, and the place of each text's first.

    A text of fewer words than `width` has its whole sequence as one shingle, one without words none.
    """
    counts = np.diff(first)
    whole = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    places = np.concatenate([[0], np.cumsum(whole)])
    out = np.empty(places[-1], np.uint64)
    full = combined(hashes, width)
    # Places of shingles that stay within one text.
    owner = np.repeat(np.arange(len(counts)), whole)
    inner = np.arange(places[-1]) - places[owner]
    long_text = counts[owner] >= width
    out[long_text] = full[(first[owner] + inner)[long_text]]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        value = mix_one(int(counts[i]))
        for h in hashes[first[i] : first[i + 1]].tolist():
            value = mix_one(value * 0x9E3779B97F4A7C15 + h)
        out[places[i]] = value
    return out, places


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's bigint."""
    return np.ascontiguousarray(x).view(np.int64)


def fold(column: Column, parts: int) -> Column:
    """The fold of an id: crc32 of its decimal text modulo the number of parts."""
    return F.crc32(column.cast("string").cast("binary")) % parts


def work_folder(spark: SparkSession) -> str:
    """A new folder all executors share, under `spark.checkpoint.dir`.

    The setting is the cluster's. Only a session on one machine may lack it, as in tests;
    elsewhere a missing setting is an error, as tables would land on single machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        named = tempfile.gettempdir()
    return f"{named.rstrip('/')}/lexhaven-llm-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write a table and read it back, which cuts its lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
