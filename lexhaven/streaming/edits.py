"""A stream of file listings: new, edited and removed files into store, manifest and log.

Spark's file streams deliver a path once. Here each listing of a tree is itself
data: rows `(listed, path, state, ...)` appended to a table that is streamed.
Keyed state holds what was last seen of each path, by buckets of paths; a path
that a listing shows with another state has changed, and a timer tells of paths
that listings no longer show. Only names and states are shuffled; texts are fetched afterwards
for the paths that need them.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lexhaven.operators.blocks import block_issues
from lexhaven.operators.changes import update_manifest
from lexhaven.operators.chunks import chunk_files, split_chunks
from lexhaven.operators.embedding import embed, hashed_words
from lexhaven.plans.ingest import file_counts, outcomes, put_in_store
from lexhaven.schemas import CHUNK_OVERLAP, CHUNK_SIZE, LANGUAGES, MANIFEST
from lexhaven.sources import files as sources
from lexhaven.sources import manifest as manifests
from lexhaven.sources import runlog, store, tables

LISTING = "listed timestamp, path string, relative_path string, ext string, modification_time timestamp, state string"
EVENTS = "path string, relative_path string, ext string, modification_time timestamp, state string, status string"

# Keyed state with timers needs this store; set it before the stream starts.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_KEPT = ["relative_path", "ext", "modification_time", "state"]

# Groups of paths by their hash, each with a state of its own. A checkpoint keeps to the number it was begun with.
BUCKETS = 512

# A bucket's state; moments in milliseconds, other times in microseconds since 1970.
_STATE = pa.schema([
    ("path", pa.string()), ("moment", pa.int64()), ("relative_path", pa.string()), ("ext", pa.string()),
    ("modification_time", pa.int64()), ("state", pa.string()),
])
# The moment of a listing without one: before all others.
_NO_MOMENT = -(2**63) // 1_000_000


def append_listing(
    spark: SparkSession, root: str, path: str, listed: datetime.datetime | None = None, extensions=tuple(LANGUAGES), **discovery
) -> None:
    """List the tree at `root` and append it to the listings at `path`, as one moment.

    The state of a file is its time and length, so no file is opened.
    """
    found = sources.discover_files(spark, root, extensions, **discovery).drop("content")
    state = F.concat_ws(":", F.unix_micros("modification_time"), "length")
    when = F.lit(listed) if listed else F.current_timestamp()
    found.select(when.alias("listed"), "path", "relative_path", "ext", "modification_time", state.alias("state")).write.mode("append").parquet(path)


class _Seen(StatefulProcessor):
    """What was last seen of the paths of a bucket, and timers for when they should have been seen again.

    A call into Python, and each question to the state, costs far more than a path does. So a bucket's
    paths are one value, compared as columns, and one timer stands for all that were seen at one moment.
    """

    def __init__(self, missing_ms: int):
        self.missing_ms = missing_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "paths binary")

    def _held(self) -> pd.DataFrame:
        if not self.last.exists():
            return _STATE.empty_table().to_pandas()
        return pa.ipc.open_stream(self.last.get()[0]).read_pandas()

    def _hold(self, paths: pd.DataFrame) -> None:
        if paths.empty:
            self.last.clear()
            return
        table = pa.Table.from_pandas(paths, _STATE, preserve_index=False).replace_schema_metadata(None)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _STATE, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        self.last.update((sink.getvalue().to_pybytes(),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # The newest of the batch counts; equal moments are told apart by their state.
        now = pd.concat(list(rows), ignore_index=True).sort_values(["listed", "state"]).drop_duplicates("path", keep="last")
        held = self._held()
        now = now.merge(held[["path", "moment", "state"]], "left", "path", suffixes=("", "_before"), indicator="side")
        known = now["side"] == "both"
        late = known & (now["moment"] < now["moment_before"])
        same = (now["state"] == now["state_before"]) | (now["state"].isna() & now["state_before"].isna())
        now["status"] = np.select([~known, same], ["new", "unchanged"], "changed")
        now = now[~late]
        if now.empty:
            return
        paths = pd.concat([held[~held["path"].isin(now["path"])], now[_STATE.names]]) if len(held) else now[_STATE.names]
        before, after = set(held["moment"]), set(paths["moment"])
        for moment in before - after:
            self.handle.deleteTimer(int(moment) + self.missing_ms)
        for moment in after - before:
            self.handle.registerTimer(int(moment) + self.missing_ms)
        self._hold(paths)
        yield now[["path", *_KEPT, "status"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        gone = held["moment"] + self.missing_ms <= expiredTimerInfo.getExpiryTimeInMs()
        if gone.any():
            self._hold(held[~gone])
            yield held[gone].assign(status="deleted")[["path", *_KEPT, "status"]]

    def close(self) -> None:
        pass


def file_events(
    listings: DataFrame, missing_after: str = "90 minutes", delay: str = "0 seconds", buckets: int = BUCKETS,
) -> DataFrame:
    """A stream of `EVENTS`: each path of a micro-batch as new, changed or unchanged, and paths now deleted.

    A path is deleted once listings are `missing_after` newer than the last that
    showed it; take more than the time between two listings, and let a listing
    arrive as one micro-batch or be covered by `delay`. A path that comes back is
    new. Older listings that come late are passed over.

    A bucket's paths and states are in a task's memory at once; take more `buckets` for trees of
    more than some ten million files, before the stream's first start.
    """
    missing = int(pd.Timedelta(missing_after).total_seconds() * 1000)
    rows = listings.select(
        "listed", "path", "relative_path", "ext", F.unix_micros("modification_time").alias("modification_time"), "state",
        F.coalesce(F.unix_millis("listed"), F.lit(_NO_MOMENT)).alias("moment"),
        F.pmod(F.xxhash64("path"), F.lit(buckets)).alias("bucket"),
    ).withWatermark("listed", delay)
    made = EVENTS.replace("modification_time timestamp", "modification_time long")
    events = rows.groupBy("bucket").transformWithStateInPandas(_Seen(missing), made, "append", "eventTime")
    return events.withColumn("modification_time", F.timestamp_micros("modification_time"))


def fetch_named(spark: SparkSession, root: str, **discovery) -> Callable[[DataFrame], DataFrame]:
    """Texts of paths in the tree at `root`, read when a micro-batch asks for them."""
    return lambda paths: sources.read_text(sources.read_named(sources.discover_files(spark, root, **discovery), paths))


def ingest_edits(
    listings: DataFrame, fetch: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, module: str = "stream",
    chunk: Callable[[DataFrame], DataFrame] | None = None, make=None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP,
    session: str = "stream", missing_after: str = "90 minutes", delay: str = "0 seconds", buckets: int = BUCKETS, **trigger,
) -> StreamingQuery:
    """Keep store, manifest and run log below `target` in step with a stream of listings.

    `fetch` gives `FILES` rows for a table of paths. In each micro-batch the
    files that are new or changed are cut, embedded once and stored; rows of
    their earlier states and of deleted files go by tombstones. The log's session is
    `<session>-<number of the batch>`. A batch that runs again after a failure
    replaces its own rows everywhere; one without events writes nothing. Without a trigger, all there is is taken in.
    """
    spark = listings.sparkSession
    make = make or hashed_words()
    chunk = chunk or (lambda files: chunk_files(files.where("language is not null"), module))
    store_path, manifest_path = f"{target}/store", f"{target}/manifest"

    def take_in(batch: DataFrame, number: int) -> None:
        work, aside = tables.shared_folder(spark, beside=target), None
        try:
            # State is advanced once: everything below reads what it said.
            events = tables.written(batch, f"{work}/events")
            # A batch that only moves the watermark on has nothing to say.
            if events.isEmpty():
                return
            # What is small or mostly empty is written down, so that Spark knows its size: no text is
            # shuffled to be matched with it.
            todo = events.where("status in ('new', 'changed')").select("path", "modification_time")
            todo = tables.written(todo, f"{work}/todo")
            pieces = split_chunks(chunk(fetch(todo)), size, overlap)
            staged, aside = store.stage_rows(embed(pieces, make, on_error="keep", timed=True), store_path)
            failures = staged.where("embed_error is not null").groupBy(F.col("absolute_path").alias("path")).agg(
                F.min("embed_error").alias("error_message")
            )
            failures = tables.written(failures, f"{work}/failures")
            stale = events.where("status in ('changed', 'deleted')").select("path").join(failures, "path", "left_anti")
            staged = put_in_store(staged, aside, failures, store_path, True, stale)
            counts = tables.written(file_counts(staged), f"{work}/counts")

            seen = events.where("status <> 'deleted'").withColumn("language", sources.language_of(F.col("ext")))
            lone = tables.written(todo.join(counts, "path", "left_anti"), f"{work}/lone")
            issues = block_issues(fetch(lone))
            runlog.write_session(outcomes(seen, counts, issues, failures, f"{session}-{number:06d}"), f"{target}/runlog")

            # What the manifest keeps of a state is its hash, or what stands for it.
            done = events.join(todo.select("path"), "path", "left_semi").join(failures, "path", "left_anti")
            done = done.select("path", F.col("state").alias("file_hash"), "modification_time")
            manifest = manifests.read_manifest(spark, manifest_path).select(*MANIFEST.fieldNames())
            gone = events.where("status = 'deleted'").select("path")
            manifests.write_manifest(update_manifest(manifest, done, counts, deleted=gone), manifest_path)
        finally:
            tables.drop_folder(spark, work)
            if aside:
                tables.drop_folder(spark, aside)

    return (
        file_events(listings, missing_after, delay, buckets).writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
