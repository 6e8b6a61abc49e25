"""The whole ingest as one job: from files to store, manifest and run log."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhaven.functions.errors import error_status
from lexhaven.functions.text import sortable_session
from lexhaven.operators.blocks import block_issues
from lexhaven.operators.changes import detect_changes, update_manifest
from lexhaven.operators.chunks import chunk_files, split_chunks
from lexhaven.operators.embedding import embed, hashed_words
from lexhaven.operators.report import run_result
from lexhaven.schemas import (
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    DEFAULT_SOURCE_UNITS,
    DEFAULT_TEMPLATE_UNITS,
    LANGUAGES,
    RUNLOG,
    TEMPLATE_LANGUAGE,
    conform,
)
from lexhaven.sources import files as sources
from lexhaven.sources import manifest as manifests
from lexhaven.sources import runlog, store, tables


def outcomes(
    files: DataFrame, counts: DataFrame, issues: DataFrame, failures: DataFrame, session_id: str,
) -> DataFrame:
    """`RUNLOG` rows, one per file of the run.

    `files` has `path, relative_path, status, language`; `counts` the pieces
    stored per path; `issues` the unit issues per path; `failures` an
    `error_message` per path that could not be embedded.
    A file without chunks is a parse error when it has issues, else a success
    with 0 chunks; unchanged files are skipped. A file's duration is what its
    pieces took in their tasks, and its time that of its last piece, where
    `counts` has them from `file_counts`; skipped files took none, and files
    without pieces have the time of writing and the least duration.
    """
    joined = (
        files.join(counts, "path", "left")
        .join(issues.select("path", "issues"), "path", "left")
        .join(failures.select("path", F.col("error_message").alias("_failure")), "path", "left")
    )
    n = F.coalesce("chunk_count", F.lit(0))
    unknown = F.col("language").isNull()
    failed = F.col("_failure").isNotNull()
    broken = (n == 0) & (F.coalesce(F.size("issues"), F.lit(0)) > 0) & ~failed & ~unknown
    message = (
        F.when(F.col("status") == "unchanged", None)
        .when(unknown, F.concat(F.lit("No parser found for file: "), F.col("path")))
        .when(failed, F.col("_failure"))
        .when(broken, F.format_string(
            "Parse error prevented chunk extraction (%d issue(s) in file)", F.size("issues")))
    )
    status = (
        F.when(F.col("status") == "unchanged", "skipped")
        .when(unknown | failed, error_status(message))
        .when(broken, "parse_error")
        .otherwise("success")
    )
    first = F.when(broken, F.get("issues", F.lit(0)))
    rows = joined.select(
        F.coalesce(F.col("finished"), F.current_timestamp()).alias("ts"),
        F.lit(session_id).alias("session_id"),
        F.col("path").alias("file_path"),
        "relative_path",
        status.alias("status"),
        F.when(status == "success", n.cast("bigint")).alias("chunk_count"),
        message.alias("error_message"),
        F.when(broken, F.col("issues")).alias("error_details"),
        first.start_line.alias("line_number"),
        first.start_column.alias("column_number"),
        F.when(status == "skipped", F.lit(0)).otherwise(
            F.greatest(F.ceil(F.coalesce("took_ms", F.lit(0.0))), F.lit(1))).alias("duration_ms"),
    )
    return conform(rows, RUNLOG)


def file_counts(timed: DataFrame) -> DataFrame:
    """Pieces of each file with a vector, the time they took and when the last was done: of `embed` with `timed`."""
    return timed.groupBy(F.col("absolute_path").alias("path")).agg(
        F.count("embedding").alias("chunk_count"),
        F.sum("embed_ms").alias("took_ms"),
        F.timestamp_micros(F.max("embed_at")).alias("finished"),
    )


_EMBEDDED = ("embed_error", "embed_ms", "embed_at")


def put_in_store(
    staged: DataFrame, aside: str, failures: DataFrame, path: str, replace: bool = False, gone: DataFrame | None = None,
) -> DataFrame:
    """Make pieces of `store.stage_rows` the store's newest version, without those of failed files; gives the pieces as they are read from then on.

    Without failures the folder they were written to becomes the version, so they lie on disk once;
    else those of other files are written again. With `replace` they replace their files' earlier rows, and
    those of the files in `gone` go; see `store.replace_rows`.
    """
    spark = staged.sparkSession
    if failures.isEmpty():
        version, folder = tables.adopt(spark, aside, path)
        staged = spark.read.schema(staged.schema).parquet(folder)
    else:
        failed = failures.select(F.col("path").alias("absolute_path"))
        # Ids hold the path and the index in the file, so they are unique.
        version = store.append_rows(staged.drop(*_EMBEDDED).join(failed, "absolute_path", "left_anti"), path, unique=True)
    if replace:
        store.bury(spark, path, version, gone)
    return staged


def new_session(spark: SparkSession) -> str:
    """Session id of this moment."""
    now = datetime.datetime.now(datetime.timezone.utc)
    return spark.range(1).select(sortable_session(F.lit(now)).alias("s")).first().s


def ingest_files(
    files: DataFrame,
    target: str,
    make=None,
    dim: int | None = None,
    module: str | None = None,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    line_mode: str = "estimate",
    source_units=DEFAULT_SOURCE_UNITS,
    template_units=DEFAULT_TEMPLATE_UNITS,
    mode: str = "hash",
    replace: bool = False,
    record_empty: bool = False,
    session_id: str | None = None,
    listing: DataFrame | None = None,
    partitions: int | None = None,
    read: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Ingest a table of `FILES`; returns the run's result row.

    `target` gets the folders `store`, `manifest` and `runlog`. With
    `replace`, rows of earlier states of a file and of deleted files leave the
    store and the manifest; otherwise rows are upserted by id.

    `partitions` spreads the pieces evenly before they are embedded; worth its
    shuffle where embedding is slow and files differ much.

    `read` gives `FILES` rows for a table of `path, modification_time, length`
    taken from `listing`, and then opens these files alone.

    Pieces are embedded once and written down, within the store's folder; counts, failures and the store
    all read that table, so a lost executor never repeats the embedding of
    finished tasks. A batch that fails to embed fails its files and not the job.
    """
    spark = files.sparkSession
    started = datetime.datetime.now(datetime.timezone.utc)
    make = make or hashed_words()
    session_id = session_id or new_session(spark)
    store_path, manifest_path = f"{target}/store", f"{target}/manifest"
    manifest = manifests.read_manifest(spark, manifest_path)
    listing = files if listing is None else listing

    work = tables.shared_folder(spark, beside=target)

    def written(df: DataFrame, name: str) -> DataFrame:
        return tables.written(df, f"{work}/{name}")

    # The file states are written without text. The paths to do are a table of
    # their own: Spark knows its size, and sends it to the files while small.
    keep = ["relative_path", "ext", *(["file_hash"] if mode == "hash" else []), *(["length"] if read else [])]
    named = ["path", "modification_time", *(["length"] if read else [])]
    changes = written(
        detect_changes(listing, manifest, mode, tuple(keep + ["modification_time"])), "changes"
    )
    todo = written(
        changes.where("status in ('new', 'changed')").select(*named), "todo"
    )
    deleted = changes.where("status = 'deleted'").select("path")

    def texts(paths: DataFrame) -> DataFrame:
        if read:
            return read(paths)
        if "content" in files.columns:
            return sources.read_text(sources.read_named(files, paths))
        return files.join(paths.select("path"), "path", "left_semi")

    # In a first run every file is new and nothing needs to be joined.
    first_run = manifest.isEmpty() and "content" not in files.columns and not read
    fresh = files if first_run else texts(todo)
    known = fresh.where("language is not null")
    pieces = split_chunks(
        chunk_files(known, module, source_units, template_units), size, overlap, line_mode
    )
    if partitions:
        pieces = pieces.repartition(partitions, "id")
    staged, aside = store.stage_rows(embed(pieces, make, dim=dim, on_error="keep", timed=True), store_path)

    # Failures are few and mostly none. Written down, they show Spark their size.
    failures = written(
        staged.where("embed_error is not null")
        .groupBy(F.col("absolute_path").alias("path"))
        .agg(F.min("embed_error").alias("error_message")),
        "failures",
    )
    # A changed file that has no chunks now loses its old ones too.
    gone = deleted.unionByName(todo.join(failures, "path", "left_anti").select("path"))
    staged = put_in_store(staged, aside, failures, store_path, replace, gone)
    counts = file_counts(staged)

    seen = changes.where("status <> 'deleted'").withColumn(
        "language", sources.language_of(F.col("ext"))
    )
    # Few files have no chunk at all; only these are searched for issues.
    lone = written(
        seen.where(F.col("language") != TEMPLATE_LANGUAGE).select(*named)
        .join(todo, "path", "left_semi")
        .join(staged.select(F.col("absolute_path").alias("path")).distinct(), "path", "left_anti"),
        "lone",
    )
    rows = outcomes(seen, counts, block_issues(texts(lone)), failures, session_id)
    runlog.append_log(rows, f"{target}/runlog")

    done = seen if mode == "hash" else fresh
    done = done.join(todo, "path", "left_semi").join(failures, "path", "left_anti")
    manifests.write_manifest(
        update_manifest(manifest, done, counts, record_empty, deleted if replace else None),
        manifest_path,
    )
    log = runlog.read_log(spark, f"{target}/runlog")
    # Store, log and manifest are written; nothing reads the work tables now.
    tables.drop_folder(spark, work)
    tables.drop_folder(spark, aside)
    return run_result(log.where(F.col("session_id") == session_id), started)


# Options of `ingest` that say which files are found.
_DISCOVERY = ("exclude_dirs", "max_depth", "list_hidden")


def ingest(spark: SparkSession, root: str, target: str, source_root: str | None = None, **options):
    """Ingest the files below `root`, or one file; see `ingest_files` and `discover_files`.

    A folder is its own source root; for a single file relative paths and the
    module come from `source_root`. With `mode="mtime"` no file older than
    every new or changed one is opened; with `list_hidden` as well, none but these.
    """
    folder = tables.is_folder(spark, root)
    base = root if folder or source_root is None else source_root
    found = {name: options.pop(name) for name in _DISCOVERY if name in options}
    below = None if folder else source_root
    by_name = options.get("mode") == "mtime" and found.get("list_hidden", False)
    listing = sources.discover_files(
        spark, root, options.pop("extensions", tuple(LANGUAGES)), source_root=below, content=not by_name, **found,
    )
    options.setdefault("module", sources.module_of(base))
    if by_name:
        options["read"] = lambda paths: sources.read_text(sources.read_walked(paths, root, below))
    if options.get("mode") == "mtime":
        return ingest_files(listing, target, listing=listing.drop("content"), **options)
    return ingest_files(sources.read_text(listing), target, **options)
