"""Source files: discovery, names, text, statistics."""

from __future__ import annotations

import os
import stat as stat_bits
import warnings
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexhaven.functions.identity import content_hash
from lexhaven.functions.text import extname, relative_to, strip_scheme
from lexhaven.schemas import EXCLUDED_DIRS, FILES, LANGUAGES

BINARY_FILE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modificationTime", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("content", T.BinaryType()),
    ]
)

# Bytes and files that a listing by tasks reads into one batch.
READ_BYTES, READ_FILES = 4 << 20, 1000

# Bytes of files that a task opens by their names.
TASK_BYTES = 64 << 20

_FOUND = ("path", "relative_path", "ext", "modification_time", "length", "content")


def _root(path: str) -> str:
    bare = path[len("file://"):] if path.startswith("file://") else path
    bare = os.path.abspath(bare) if "://" not in bare else bare
    return bare.rstrip("/") or "/"


def _bare(root: str) -> str:
    """Root path without scheme and host."""
    return "/" + root.split("://", 1)[1].split("/", 1)[-1] if "://" in root else root


def module_of(root: str) -> str:
    """Default module: lower-cased last segment of the root."""
    return os.path.basename(_root(root)).lower()


def named(df: DataFrame, root: str, source_root: str | None = None) -> DataFrame:
    """Add names to rows of the `binaryFile` source: relative path and suffix."""
    root = _root(root)
    bare = strip_scheme(F.col("path"))
    base = _bare(_root(source_root)) if source_root else _bare(root)
    below = F.when(
        bare == base, F.substring_index(bare, "/", -1)
    ).otherwise(relative_to(bare, base))
    local = F.when(F.col("path").startswith("file:"), bare).otherwise(F.col("path"))
    return df.withColumns(
        {
            "path": local,
            "relative_path": below,
            "ext": extname(bare),
            "modification_time": F.col("modificationTime"),
            "_below": relative_to(bare, _bare(root)),
        }
    )


def discover_files(
    spark: SparkSession,
    root: str,
    extensions=tuple(LANGUAGES),
    exclude_dirs=EXCLUDED_DIRS,
    max_depth: int = -1,
    source_root: str | None = None,
    list_hidden: bool = False,
    content: bool = True,
) -> DataFrame:
    """Files below `root`, or `root` itself when it is a file.

    Columns `path`, `relative_path`, `ext`, `modification_time`, `length` and
    the still unread `content`. Extensions match exactly and case counts;
    excluded names are pruned at any depth below the root; depth 0 is the root
    folder itself. Relative paths count from `source_root`, by default `root`.

    Spark's own listing leaves out empty files and names that start with `_` or
    `.`, and follows links. `list_hidden=True` walks the tree in tasks instead,
    level by level, finds those and skips links; it needs a file system mounted
    on every executor. A walk opens every file it finds, unless `content=False`
    leaves `content` NULL; `read_walked` then opens those that are wanted.
    """
    top = _root(root)
    wanted = list(extensions)
    if not list_hidden:
        suffix = os.path.splitext(top)[1]
        if os.path.isfile(top) and suffix not in wanted:
            warnings.warn(f"{root} does not match the extensions {', '.join(wanted)}", stacklevel=2)
        # The glob spares opening other files; the exact test follows below.
        braces = "{" + ",".join("*" + e for e in wanted) + "}"
        found = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", True)
            .option("pathGlobFilter", braces)
            .load(root)
        )
        # Tests on the file's address drop files before they are opened; the
        # exact test on folder names follows below.
        address, start = F.col("_metadata.file_path"), quote(_bare(top).rstrip("/"), safe="/:@!$&'()*+,;=~")
        at = F.instr(address, F.lit(start + "/"))
        for name in exclude_dirs:
            inside = F.substr(address, at + len(start)).contains(f"/{quote(name)}/")
            found = found.where(~((at > 0) & inside))
    else:
        found = _walk(spark, top, wanted, list(exclude_dirs), max_depth, content)
    out = named(found, top, source_root)
    dirs = F.expr("slice(split(_below, '/'), 1, size(split(_below, '/')) - 1)")
    keep = F.col("ext").isin(wanted)
    if exclude_dirs:
        keep &= ~F.arrays_overlap(dirs, F.array(*[F.lit(n) for n in exclude_dirs]))
    if max_depth >= 0:
        keep &= F.size(dirs) <= max_depth
    return out.where(keep).select(*_FOUND)


def _reader(content: bool):
    """For `mapInArrow`: `binaryFile` rows of a column `path`; with `content` False only what the file system says of them."""

    def read(batches):
        import pyarrow as pa

        shape = pa.schema([
            ("path", pa.string()), ("modificationTime", pa.timestamp("us", "UTC")), ("length", pa.int64()), ("content", pa.binary()),
        ])
        rows, size = [], 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                info = os.stat(path)
                if not stat_bits.S_ISREG(info.st_mode):
                    continue
                data = None
                if content:
                    with open(path, "rb") as f:
                        data = f.read()
                    size += len(data)
                rows.append(("file:" + path, info.st_mtime_ns // 1000, info.st_size, data))
                # Many small files make one batch, and a large one a batch of its own.
                if size >= READ_BYTES or len(rows) >= READ_FILES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), shape.types)], schema=shape)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), shape.types)], schema=shape)

    return read


def read_walked(wanted: DataFrame, root: str, source_root: str | None = None) -> DataFrame:
    """Rows of `discover_files` with their content, for files that a walk of `root` has listed.

    `wanted` has their `path` and `length`. These files alone are opened, where their names are, so
    no content is shuffled. They are spread over tasks of about `TASK_BYTES`, and over all cores.
    """
    size = wanted.agg(F.sum("length").alias("n")).first().n or 0
    tasks = max(wanted.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    found = wanted.select("path").repartition(tasks).mapInArrow(_reader(True), BINARY_FILE)
    return named(found, root, source_root).select(*_FOUND)


def _walk(spark, top: str, extensions, excluded, max_depth: int, content: bool = True) -> DataFrame:
    """Listing by tasks: level by level on Spark, the folders of each level spread out."""

    def list_folders(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for folder in batch["path"]:
                for entry in os.scandir(folder):
                    if entry.is_symlink():
                        continue
                    if entry.is_dir(follow_symlinks=False):
                        if entry.name not in excluded:
                            rows.append((entry.path, True))
                    elif os.path.splitext(entry.name)[1] in extensions:
                        rows.append((entry.path, False))
            yield pd.DataFrame(rows, columns=["path", "is_folder"])

    # Each level is written down once, so a deep tree is not listed again from the top.
    from lexhaven.sources.tables import shared_folder

    work = shared_folder(spark)
    level = spark.createDataFrame([(top, True)], "path string, is_folder boolean")
    files, depth = [], 0
    while True:
        out = f"{work}/level={depth}"
        (
            level.where("is_folder").repartition(spark.sparkContext.defaultParallelism)
            .mapInPandas(list_folders, "path string, is_folder boolean").write.parquet(out)
        )
        level = spark.read.schema("path string, is_folder boolean").parquet(out)
        files.append(level.where("not is_folder").select("path"))
        depth += 1
        if 0 <= max_depth < depth or level.where("is_folder").isEmpty():
            break
    listed = files[0]
    for more in files[1:]:
        listed = listed.unionByName(more)
    spread = listed.repartition(spark.sparkContext.defaultParallelism)
    return spread.mapInArrow(_reader(content), BINARY_FILE)


def valid_text(content: Column) -> Column:
    """Bytes as UTF-8 text, bad ones as U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def language_of(ext: Column, languages: dict[str, str] = LANGUAGES) -> Column:
    """Language label of a suffix, NULL for an unknown one."""
    column = F.lit(None).cast("string")
    for suffix, language in languages.items():
        column = F.when(ext == suffix, language).otherwise(column)
    return column


def read_text(listing: DataFrame, languages: dict[str, str] = LANGUAGES) -> DataFrame:
    """`FILES` rows of a listing: text decoded and hashed."""
    text = listing.withColumn("text", valid_text(F.col("content")))
    return text.withColumns(
        {"language": language_of(F.col("ext"), languages), "file_hash": content_hash(F.col("text"))}
    ).select(*FILES.fieldNames())


def read_named(listing: DataFrame, wanted: DataFrame) -> DataFrame:
    """The files of a listing whose `path` is in `wanted`, with their content.

    One route for any number of files. Where `wanted` has a `modification_time`, its least
    value goes to the scan, which then does not open files that are older than all of these.
    """
    if "modification_time" in wanted.columns:
        least = wanted.agg(F.min("modification_time").alias("t")).first().t
        if least is None:
            return listing.where(F.lit(False))
        listing = listing.where(F.col("modification_time") >= F.lit(least))
    return listing.join(wanted.select("path"), "path", "left_semi")


def file_stats(files: DataFrame) -> DataFrame:
    """Number of files by suffix."""
    return files.groupBy("ext").agg(F.count(F.lit(1)).alias("files"))
