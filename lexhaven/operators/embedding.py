"""Texts to vectors."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexhaven.schemas import EMBED_BATCH, MODEL_DIMENSIONS


# Words: runs without white space, control characters and ASCII punctuation.
WORD = r"[^\x00-\x20!-/:-@\[-\^`{-\x7f]+"

_RESULT = "struct<embedding: array<float>, error: string, ms: double, at: long>"
_VECTOR = pa.list_(pa.float32())


def model_dimension(model: str, default: int = 1024) -> int:
    """Vector length of a known model."""
    return MODEL_DIMENSIONS.get(model, default)


def hashed_words(dim: int = 256) -> Callable[[], Callable[[list[str]], list[np.ndarray]]]:
    """Embedder that needs no model: counts of lower-case words hashed to `dim` places.

    The place is the first 32 bits of the word's MD5 modulo `dim`; vectors have
    length 1, or are all zero for a text without words.

    It works inside the row. The same sums by `explode` and two `groupBy`s
    would shuffle every (text, place) count, several times the text's size.
    """

    def make():
        inside = np.array([at > 127 or re.fullmatch(WORD, chr(at)) is not None for at in range(256)])
        class Places(dict):
            def __missing__(self, token: str) -> int:
                at = self[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim
                return at

        places = Places()

        def rows(texts: list[str]) -> np.ndarray:
            # Words end at ASCII bytes alone, so they are cut from the bytes of all texts at once.
            parts = [text.lower().encode() for text in texts]
            begins = np.cumsum([0, *(len(part) + 1 for part in parts)])[:-1]
            data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
            kept = inside[data]
            edges = np.flatnonzero(np.diff(kept, prepend=False))
            starts, sizes = edges[::2], edges[1::2] - edges[::2]
            offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
            buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data[kept])]
            words = pa.Array.from_buffers(pa.large_string(), len(starts), buffers).dictionary_encode()
            if len(places) > 500_000:
                places.clear()
            different = words.dictionary.to_numpy(zero_copy_only=False)
            known = np.fromiter(map(places.__getitem__, different), np.int64, len(different))
            at = dim * (np.searchsorted(begins, starts, "right") - 1) + known[words.indices.to_numpy()]
            counts = np.bincount(at, minlength=dim * len(texts)).reshape(-1, dim).astype(np.float64)
            norms = np.sqrt(np.einsum("ij,ij->i", counts, counts))
            return (counts / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)

        def run(texts: list[str]) -> list[np.ndarray]:
            return [row for at in range(0, len(texts), EMBED_BATCH) for row in rows(texts[at : at + EMBED_BATCH])]

        return run

    return make


def _listed(vectors: list) -> pa.Array:
    """Vectors as a column; those of numpy without an object for each number."""
    if not vectors or not all(isinstance(v, np.ndarray) and v.ndim == 1 for v in vectors):
        return pa.array([None if v is None else list(v) for v in vectors], _VECTOR)
    offsets = np.cumsum([0, *map(len, vectors)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(vectors).astype(np.float32)))


def embed(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], list]],
    column: str = "content",
    dim: int | None = None,
    batch_size: int = EMBED_BATCH,
    on_error: str = "raise",
    timed: bool = False,
) -> DataFrame:
    """Add `embedding` for the text in `column`.

    `make` is called once per task and returns the embedder, a function from a
    list of texts to as many vectors; a model is loaded in `make`. Texts go to
    it in batches of `batch_size`, in Arrow batches of the partition and not
    file by file, so batches are full.

    With `on_error="keep"` a batch that fails gives NULL vectors and its
    message in `embed_error`, instead of ending the job.

    With `timed`, `embed_ms` is the row's share, by length, of the time that its
    task took since the batch before, with what Spark did to bring the batch,
    and `embed_at` when its vector was there, in microseconds since 1970.
    """
    if on_error not in ("raise", "keep"):
        raise ValueError(f"unknown on_error {on_error!r}")
    keep = on_error == "keep"

    def vectors_of(fn, texts: list[str]) -> list[tuple]:
        try:
            vectors = fn(texts)
            if len(vectors) != len(texts):
                raise ValueError(f"embedding length mismatch: {len(texts)} texts, {len(vectors)} vectors")
            if dim is not None and any(len(v) != dim for v in vectors):
                raise ValueError(f"embedding dimension is not {dim}")
            return [(v, None) for v in vectors]
        except Exception as error:
            if not keep:
                raise
            return [(None, str(error) or type(error).__name__)] * len(texts)

    @F.arrow_udf(_RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fn = make()
        before = time.perf_counter()
        for texts in batches:
            vectors, errors, ready = [], [], []
            # A batch of the embedder's is all that is there as Python strings.
            for at in range(0, len(texts), batch_size):
                rows = vectors_of(fn, texts.slice(at, batch_size).to_pylist())
                vectors.append(_listed([r[0] for r in rows]))
                errors += [r[1] for r in rows]
                ready += [time.time_ns() // 1000] * len(rows)
            weight = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float) + 1
            now = time.perf_counter()
            took, before = 1000 * (now - before), now
            yield pa.StructArray.from_arrays(
                [
                    pa.concat_arrays(vectors) if vectors else pa.array([], _VECTOR), pa.array(errors, pa.string()),
                    pa.array(took * weight / max(1, weight.sum())), pa.array(ready, pa.int64()),
                ],
                ["embedding", "error", "ms", "at"],
            )

    # Spark repeats a deterministic function for a filter on its result; a model must run once.
    run = run.asNondeterministic()
    # A text that is NULL or absent is an empty text to the embedder.
    done = df.withColumn("_e", run(F.coalesce(F.col(column), F.lit(""))))
    out = done.withColumn("embedding", F.col("_e.embedding"))
    if keep:
        out = out.withColumn("embed_error", F.col("_e.error"))
    if timed:
        out = out.withColumns({"embed_ms": F.col("_e.ms"), "embed_at": F.col("_e.at")})
    return out.drop("_e")


def checked_dimension(vector: Column, dim: int) -> Column:
    """The vector itself, or a failed task where its length is not `dim`."""
    bad = F.format_string(f"embedding dimension is %d, not {dim}", F.size(vector))
    return F.when(F.size(vector) == dim, vector).otherwise(F.raise_error(bad))


def attach_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Join chunks with a table `(id, embedding)`; an id on one side only is an error."""
    both = chunks.withColumn("_c", F.lit(True)).join(
        vectors.select("id", "embedding").withColumn("_v", F.lit(True)), "id", "full_outer"
    )
    lone = F.col("_c").isNull() | F.col("_v").isNull()
    bad = F.concat(F.lit("chunks and embeddings do not match at id "), F.col("id"))
    return both.withColumn(
        "embedding", F.when(lone, F.raise_error(bad)).otherwise(F.col("embedding"))
    ).drop("_c", "_v")
