"""Ingest of files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexhaven.operators.chunks import chunk_files, split_chunks
from lexhaven.operators.embedding import embed, hashed_words
from lexhaven.schemas import CHUNK_OVERLAP, CHUNK_SIZE, LANGUAGES
from lexhaven.sources import files as sources
from lexhaven.sources import store


def stream_files(spark: SparkSession, root: str, extensions=tuple(LANGUAGES)) -> DataFrame:
    """`FILES` rows of new files below `root`.

    A file changed in place is not delivered again; edits need the batch ingest.
    """
    braces = "{" + ",".join("*" + e for e in extensions) + "}"
    found = (
        spark.readStream.format("binaryFile")
        .schema(sources.BINARY_FILE)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", braces)
        .load(root)
    )
    return sources.read_text(sources.named(found, root))


def store_stream(
    chunks: DataFrame,
    store_path: str,
    checkpoint: str,
    make=None,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    **trigger,
) -> StreamingQuery:
    """Split, embed and upsert a stream of `CHUNKS` rows.

    Each micro-batch becomes one version of the store. Ids come from the
    content, so a batch that runs again, or a replay from a new checkpoint,
    only covers its own earlier rows. Without a trigger all that is there is
    taken in, and the query ends.
    """
    make = make or hashed_words()

    def upsert_batch(batch: DataFrame, number: int) -> None:
        pieces = embed(split_chunks(batch, size, overlap), make)
        store.append_rows(pieces, store_path)

    return (
        chunks.writeStream.foreachBatch(upsert_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def ingest_stream(
    spark: SparkSession,
    root: str,
    store_path: str,
    checkpoint: str,
    module: str | None = None,
    **options,
) -> StreamingQuery:
    """New files below `root` into the store; see `store_stream`."""
    files = stream_files(spark, root)
    chunks = chunk_files(
        files.where(F.col("language").isNotNull()), module or sources.module_of(root)
    )
    return store_stream(chunks, store_path, checkpoint, **options)
