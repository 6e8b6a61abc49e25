"""From extracted units to identified chunks, and from long chunks to pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from lexhaven.functions import identity
from lexhaven.functions.arrays import once, totals_before
from lexhaven.functions.text import cut, newlines, runs_of
from lexhaven.operators.blocks import extract_blocks
from lexhaven.operators.regions import extract_regions
from lexhaven.schemas import (
    CHUNK_OVERLAP,
    CHUNK_SIZE,
    CHUNK_TYPES,
    CHUNKS,
    DEFAULT_SOURCE_UNITS,
    DEFAULT_TEMPLATE_UNITS,
    SOURCE_UNITS,
    TEMPLATE_LANGUAGE,
    TEMPLATE_UNITS,
    checked,
    conform,
)


def assemble_chunks(units: DataFrame) -> DataFrame:
    """Add content hash and id to extracted units; gives `CHUNKS` rows."""
    out = conform(units, CHUNKS).withColumns(
        {
            "content_hash": identity.content_hash(F.col("content")),
            "chunk_type": checked(F.col("chunk_type"), CHUNK_TYPES, "chunk type"),
        }
    )
    names = (
        "module", "relative_path", "package", "class_name", "method_name", "chunk_type",
        "line_start", "line_end", "content_hash", "chunk_index",
    )
    return out.withColumns(
        {
            "id": identity.chunk_id(*[F.col(n) for n in names]),
            "piece_hash": F.col("content_hash"),
        }
    )


def chunk_files(
    files: DataFrame,
    module: str | None = None,
    source_units=DEFAULT_SOURCE_UNITS,
    template_units=DEFAULT_TEMPLATE_UNITS,
    source_catalogue=SOURCE_UNITS,
    template_catalogue=TEMPLATE_UNITS,
) -> DataFrame:
    """`CHUNKS` rows of a table of files: blocks of sources, regions of templates."""
    named = files.select(
        F.col("path").alias("absolute_path"),
        "relative_path",
        F.lit(module).cast("string").alias("module"),
        "language",
        "text",
    )
    template = F.col("language") == TEMPLATE_LANGUAGE
    blocks = extract_blocks(named.where(~template), source_units, source_catalogue)
    regions = extract_regions(named.where(template), template_units, template_catalogue)
    return assemble_chunks(blocks).unionByName(assemble_chunks(regions))


def chunk_with(files: DataFrame, fn) -> DataFrame:
    """`CHUNKS` rows from a chunker of your own.

    `fn` takes a pandas frame of files and returns a pandas frame of units with
    at least `absolute_path`, `relative_path`, `content`, `chunk_type`,
    `language`, `line_start`, `line_end`, `chunk_index`; hashes and ids are
    added here.
    """
    names = [f.name for f in CHUNKS.fields]

    def run(batches):
        for batch in batches:
            units = fn(batch).reindex(columns=names).astype(object)
            yield units.where(units.notna(), None)

    return assemble_chunks(files.mapInPandas(run, CHUNKS))


def register_chunker(spark: SparkSession, name: str, fn) -> None:
    """Make a chunker of your own a table function of SQL.

    `fn(text, language)` gives `(content, chunk_type, line_start, line_end)` of each unit, lines
    counted from 1. `SELECT * FROM name(TABLE(files))` reads each row as a file, without a
    shuffle. Files that come in several rows go by `PARTITION BY relative_path ORDER BY` the part:
    line numbers and `chunk_index` then run on from part to part, a part ending its last line.
    Columns other than `relative_path`, `language` and `text` pass to every unit as they are. A
    NULL text has no units; an empty table gives no rows.
    """
    needed, made = ("relative_path", "language", "text"), ("content", "chunk_type", "line_start", "line_end", "chunk_index")

    class Chunker:
        def __init__(self):
            self.path, self.lines, self.index = None, 0, 0

        @staticmethod
        def analyze(files: AnalyzeArgument) -> AnalyzeResult:
            if not files.isTable:
                raise ValueError(f"{name} takes a table: {name}(TABLE(files))")
            given = files.dataType.fields
            names = [f.name for f in given]
            if missing := [n for n in needed if n not in names]:
                raise ValueError(f"{name} needs the columns {', '.join(missing)}")
            if clash := [n for n in made if n in names]:
                raise ValueError(f"{name} makes the columns {', '.join(clash)} itself")
            kinds = (T.StringType(), T.StringType(), T.IntegerType(), T.IntegerType(), T.IntegerType())
            own = [T.StructField(n, kind) for n, kind in zip(made, kinds, strict=True)]
            return AnalyzeResult(T.StructType([f for f in given if f.name != "text"] + own))

        def eval(self, row):
            if row["relative_path"] != self.path:
                self.path, self.lines, self.index = row["relative_path"], 0, 0
            text = row["text"]
            if text is None:
                return
            passed = tuple(v for n, v in row.asDict().items() if n != "text")
            for content, kind, first, last in fn(text, row["language"]):
                yield (*passed, content, kind, self.lines + first, self.lines + last, self.index)
                self.index += 1
            self.lines += text.count("\n") + 1

    spark.udtf.register(name, udtf(Chunker))


def piece_count(length: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """How many pieces a text of that length is split into."""
    many = F.ceil((length - overlap) / F.lit(size - overlap)).cast("int")
    return F.when(length <= size, 1).otherwise(many)


def _check_sizes(size: int, overlap: int) -> None:
    if not 0 <= overlap < size:
        raise ValueError(f"need 0 <= overlap < size, got size {size} and overlap {overlap}")


def split_chunks(
    chunks: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    line_mode: str = "estimate",
) -> DataFrame:
    """Replace each chunk longer than `size` by pieces that overlap by `overlap`.

    Piece n starts at `n * (size - overlap)` and the last one ends the text.
    It gets the id `<id>_sub<n>`, `sub_index` n and its own `piece_hash`; the
    parent's `content_hash` stays. Shorter chunks pass unchanged.

    `line_mode="estimate"` moves `line_start` on by one per 100 characters and
    leaves `line_end`; `"exact"` counts line feeds for both.

    A long text is cut once into runs of `size - overlap` characters and pieces
    are joined from neighbouring runs, so the time grows with the text's length
    rather than with its square. A narrow pass without shuffle.
    """
    _check_sizes(size, overlap)
    if line_mode not in ("estimate", "exact"):
        raise ValueError(f"unknown line mode {line_mode!r}")
    step = size - overlap
    content = F.col("content")
    length = F.length(content)

    runs = runs_of(content, step, 32 * size)
    df = chunks.select("*", once(runs).alias("_runs"))
    before = F.lit(None).cast("array<int>")
    if line_mode == "exact":
        lines = F.transform(runs_of(content, step, size), newlines)
        df = df.select("*", once(lines).alias("_lines"))
        df = df.select("*", once(totals_before("_lines")).alias("_before")).drop("_lines")
        before = F.col("_before")

    def piece(n: Column) -> Column:
        return F.struct(
            cut(content, F.col("_runs"), step, n * step, F.lit(size)).alias("content"),
            F.lit(True).alias("split"),
            F.get(before, n).alias("lines"),
        )

    whole = F.struct(
        content.alias("content"), F.lit(False).alias("split"), F.lit(0).alias("lines")
    )
    pieces = F.when(length <= size, F.array(whole)).otherwise(
        F.transform(F.sequence(F.lit(0), piece_count(length, size, overlap) - 1), piece)
    )
    # The pieces carry all that is needed of the text and its runs, so that
    # neither is copied into every exploded row.
    rest = [c for c in chunks.columns if c != "content"]
    out = df.select(*rest, F.posexplode(pieces).alias("_n", "_p"))

    split, n, text = F.col("_p.split"), F.col("_n"), F.col("_p.content")
    if line_mode == "estimate":
        moved = F.col("line_start") + F.floor(n * step / 100).cast("int")
        line_end = F.col("line_end")
    else:
        moved = F.col("line_start") + F.col("_p.lines")
        line_end = F.when(split, moved + newlines(text)).otherwise(F.col("line_end"))
    text_hash = identity.content_hash(text)
    whole_hash = F.col("piece_hash") if "piece_hash" in chunks.columns else text_hash
    fresh = {
        "id": F.when(split, identity.piece_id(F.col("id"), n)).otherwise(F.col("id")),
        "content": text,
        "line_start": F.when(split, moved).otherwise(F.col("line_start")),
        "line_end": line_end,
        "sub_index": F.when(split, n),
        "piece_hash": F.when(split, text_hash).otherwise(whole_hash),
    }
    names = chunks.columns + [c for c in ("sub_index", "piece_hash") if c not in chunks.columns]
    return out.select(*[fresh.get(c, F.col(c)).alias(c) for c in names])


def split_counters(
    chunks: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """One row: chunks, oversized ones, pieces made, pieces over one per chunk."""
    _check_sizes(size, overlap)
    length = F.length("content")
    n = piece_count(length, size, overlap)
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(length > size).alias("oversized"),
        F.coalesce(F.sum(n), F.lit(0)).alias("pieces"),
        F.coalesce(F.sum(n - 1), F.lit(0)).alias("extra_pieces"),
    )


def chunks_per_file(chunks: DataFrame) -> DataFrame:
    """Number of chunks of each file."""
    return chunks.groupBy(F.col("absolute_path").alias("path")).agg(
        F.count(F.lit(1)).alias("chunk_count")
    )
