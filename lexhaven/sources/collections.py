"""Collections: the stores below one folder, as a Spark source.

`spark.read.format("lexhaven_collections").load(root)` has a row for each data
file of the current state of each store: its collection, version, rows, size and
time, and the collection's metadata. Collections are listed on the driver, and
each is a partition: a task lists its files and reads their footers, no data. The
option `collections`, a JSON list of names, leaves out all others. Filters are
not taken over by `pushFilters`: Spark 4.1 keeps what a reader has taken over for
later reads of the same DataFrame by other filters, which then lose rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexhaven.schemas import STORE
from lexhaven.sources import store, tables

FORMAT = "lexhaven_collections"
METADATA = "metadata"

FILES = "collection string, metadata string, version long, file string, rows long, bytes long, modified timestamp"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """File system of a path, and the path in it."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path.rstrip("/")
    fs, inner = pafs.FileSystem.from_uri(path.replace("file:/", "file:///") if path.startswith("file:/") and "://" not in path else path)
    return fs, inner.rstrip("/")


def _children(fs: pafs.FileSystem, path: str) -> dict[str, pafs.FileInfo]:
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return {f.base_name: f for f in found}


def _numbers(names: Iterable[str], prefix: str) -> list[int]:
    return sorted(int(n.removeprefix(prefix)) for n in names if n.startswith(prefix))


@dataclass
class Collection(InputPartition):
    """One collection, listed by one task."""

    name: str
    path: str


class CollectionsReader(DataSourceReader):
    def __init__(self, root: str, wanted: list[str] | None):
        self.root = root
        self.wanted = wanted

    def partitions(self) -> list[Collection]:
        fs, root = opened(self.root)
        out = []
        for name, info in sorted(_children(fs, root).items()):
            if info.type == pafs.FileType.Directory and not name.startswith(("_", ".")) and (self.wanted is None or name in self.wanted):
                out.append(Collection(name, self.root.rstrip("/") + "/" + name))
        # Spark asks for a partition also where there is no collection.
        return out or [Collection("", "")]

    def read(self, partition: Collection) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, path = opened(partition.path)
        inside = _children(fs, path)
        metadata = None
        if METADATA in inside:
            for name, info in _children(fs, f"{path}/{METADATA}").items():
                if name.startswith("part-") and info.size:
                    with fs.open_input_stream(info.path) as f:
                        metadata = f.read().decode("utf-8").strip()
        for gen in reversed(_numbers(inside, "gen=")):
            names = _children(fs, f"{path}/gen={gen}")
            done = _numbers(names, "_done-")
            for version in done:
                for name, info in sorted(_children(fs, f"{path}/gen={gen}/version={version}").items()):
                    if name.startswith("part-"):
                        rows = pq.read_metadata(info.path, filesystem=fs).num_rows
                        yield partition.name, metadata, version, f"{partition.path}/gen={gen}/version={version}/{name}", rows, info.size, info.mtime
            if done:
                return
        # A collection that was made and holds nothing yet.
        if metadata is not None:
            yield partition.name, metadata, None, None, 0, 0, None


class CollectionsSource(DataSource):
    """Data files of all collections below a folder."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> CollectionsReader:
        wanted = self.options.get("collections")
        return CollectionsReader(self.options["path"], None if wanted is None else json.loads(wanted))


def collection_files(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """Data files of all collections below `root`, or of those named."""
    spark.dataSource.register(CollectionsSource)
    source = spark.read.format(FORMAT)
    return (source if names is None else source.option("collections", json.dumps(names))).load(root)


def get_or_create(spark: SparkSession, root: str, name: str, metadata: dict | None = None) -> str:
    """The path of a collection; one that is not there is made, with its metadata.

    The metadata of one that is there stays as it is.
    """
    if not name or "/" in name or name.startswith(("_", ".")):
        raise ValueError(f"not a name of a collection: {name!r}")
    path = f"{root.rstrip('/')}/{name}"
    if not tables.exists(spark, f"{path}/{METADATA}"):
        text = json.dumps(metadata or {}, sort_keys=True, ensure_ascii=False)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{METADATA}")
    return path


def list_collections(spark: SparkSession, root: str) -> DataFrame:
    """One row for each collection: `collection`, `metadata` (JSON), `rows` that are current, `files`, `bytes`, `modified`.

    Rows are counted from the footers where a collection has one version and no
    tombstones; of all others the ids are read, in one job for all of them.
    """
    listed = collection_files(spark, root)
    held = listed.groupBy("collection").agg(
        F.max("metadata").alias("metadata"), F.count("file").alias("files"), F.sum("bytes").alias("bytes"),
        F.max("modified").alias("modified"), F.sum("rows").alias("stored"), F.count_distinct("version").alias("versions"),
    )
    # The names of collections, as any listing of a catalog brings them to the driver.
    several = [r["collection"] for r in held.where("versions > 1").select("collection").collect()]
    single = [r["collection"] for r in held.where("versions <= 1").select("collection").collect()]
    several += [n for n in single if tables.is_folder(spark, f"{root.rstrip('/')}/{n}/{store.TOMBSTONES}")]
    counts = spark.createDataFrame([], "collection string, current long")
    for name in several:
        current = store.read_store(spark, f"{root.rstrip('/')}/{name}").agg(F.count(F.lit(1)).alias("current"))
        counts = counts.unionByName(current.select(F.lit(name).alias("collection"), "current"))
    rows = F.coalesce("current", "stored").alias("rows")
    return held.join(counts, "collection", "left").select("collection", "metadata", rows, "files", "bytes", "modified")


def read_collections(spark: SparkSession, root: str, names: list[str] | None = None) -> DataFrame:
    """Current rows of several collections with their names; all of them by default."""
    if names is None:
        names = [r["collection"] for r in collection_files(spark, root).select("collection").distinct().collect()]
    out = spark.createDataFrame([], STORE).withColumn("collection", F.lit(None).cast("string"))
    for name in sorted(names):
        rows = store.read_store(spark, f"{root.rstrip('/')}/{name}").select(*STORE.fieldNames())
        out = out.unionByName(rows.withColumn("collection", F.lit(name)))
    return out
