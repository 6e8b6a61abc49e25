"""The engine's inputs, derived by Spark from the given tables.

The tables hold prose, web pages and events. Whole documents become source
files, whole pages template files, events a run log, and so on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexhaven.functions.identity import content_hash
from lexhaven.functions.text import empty_to_null, extname, newlines, relative_to
from lexhaven.operators.chunks import assemble_chunks, split_chunks
from lexhaven.operators.embedding import embed, hashed_words
from lexhaven.sources.files import language_of
from lexhaven.sources.tables import spread

ROOT = "/corpus"
DIM = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table that costly row-wise work starts from."""
    return spread(table(spark, folder, name))


def _text(value: Column) -> Column:
    return value.cast("string")


def _files(df: DataFrame, *rest: str) -> DataFrame:
    """Complete `path, text, modification_time` to `FILES` rows, with the columns `rest` behind."""
    path = F.col("path")
    ext = extname(path)
    return df.select(
        "path",
        relative_to(path, ROOT).alias("relative_path"),
        ext.alias("ext"),
        language_of(ext).alias("language"),
        "modification_time",
        F.length(F.encode("text", "UTF-8")).cast("bigint").alias("length"),
        "text",
        content_hash(F.col("text")).alias("file_hash"),
        *rest,
    )


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as source files: each line goes into a comment, a function, a
    property or a nested class, in turn. Where the length ends in 0 the outer
    class is left open, where it ends in 1 there is a brace too many.
    """
    safe = F.translate("text", "\"'\\*", "    ")

    def member(line: Column, n: Column) -> Column:
        i = _text(n)
        return (
            F.when(n % 4 == 0, F.concat(F.lit("  // "), line, F.lit(" {\n")))
            .when(n % 4 == 1, F.concat(
                F.lit("  function part"), i, F.lit('() : String {\n    return "'), line,
                F.lit('"\n  }\n')))
            .when(n % 4 == 2, F.concat(
                F.lit("  property get Part"), i, F.lit("() : String { /* "), line,
                F.lit(" } */ return null }\n")))
            .otherwise(F.concat(
                F.lit("  class Inner"), i, F.lit(" {\n    function run"), i, F.lit("() { print('"),
                line, F.lit("') }\n  }\n")))
        )

    body = F.array_join(F.transform(F.split(safe, "\n", -1), member), "")
    last = F.col("n_chars") % 10
    tail = F.when(last == 0, "").when(last == 1, "}\n}\n").otherwise("}\n")
    text = F.concat(
        F.lit("package corpus."), "lang", F.lit("\n\nuses corpus.base.*\n\nclass Doc"),
        _text(F.col("doc_id")), F.lit(" {\n"), body, tail,
    )
    path = F.concat(F.lit(ROOT + "/"), "source", F.lit("/Doc"), _text(F.col("doc_id")), F.lit(".gs"))
    return _files(
        spread_table(spark, folder, "documents").select(
            path.alias("path"), text.alias("text"),
            F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("modification_time"),
        )
    )


def template_files(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as template files: their scripts, titles, styles and comments as regions."""
    text = F.col("html")
    # Fixed values of this test input: page markup and the template markup it becomes.
    for old, new in (
        ("<!DOCTYPE html>", "<%@ page %>\n"),
        ("<script>", "<% "), ("</script>", "\n%>"),
        ("<title>", "<%= "), ("</title>", " %>"),
        ("<style>", "<%! "), ("</style>", " %>"),
        ("<!-- ", "<%-- "), (" -->", " --%>"),
    ):
        text = F.replace(text, F.lit(old), F.lit(new))
    path = F.concat(F.lit(ROOT + "/pages/"), _text(F.col("page_id")), F.lit(".gst"))
    return _files(
        spread_table(spark, folder, "pages").select(
            path.alias("path"), text.alias("text"),
            F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")).alias("modification_time"),
        )
    )


def all_files(spark: SparkSession, folder: str) -> DataFrame:
    """Source and template files."""
    return source_files(spark, folder).unionByName(template_files(spark, folder))


def document_chunks(documents: DataFrame) -> DataFrame:
    """Documents as one chunk each, not yet split."""
    name = F.concat("source", F.lit("/"), _text(F.col("doc_id")))
    return assemble_chunks(
        documents.select(
            F.col("text").alias("content"),
            F.concat(F.lit(ROOT + "/"), name).alias("absolute_path"),
            name.alias("relative_path"),
            F.lit("corpus").alias("module"),
            F.col("source").alias("package"),
            F.lit("file").alias("chunk_type"),
            F.col("lang").alias("language"),
            F.lit(1).alias("line_start"),
            (newlines(F.col("text")) + 1).alias("line_end"),
            F.lit(0).alias("chunk_index"),
        )
    )


def changing_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files in their states over an hour; `first` and `last` tell which states its begin and its end show.

    Documents and labels are joined once for all states.
    """
    marked = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")

    def state(hour: int, edited: bool, last: Column):
        return F.struct(
            F.lit(hour).alias("hour"), F.lit(edited).alias("edited"), F.lit(hour == 0).alias("first"), last.alias("last")
        )

    toxic, unknown = F.col("toxic") == 1, F.col("quality").isNull()
    stays = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    states = F.array(
        F.when(~unknown, state(0, False, stays)), F.when(toxic, state(1, True, F.lit(True))), F.when(unknown, state(1, False, F.lit(True)))
    )
    rows = marked.select("doc_id", "text", F.inline(F.array_compact(states)))
    rows = rows.select(
        F.concat(F.lit(ROOT + "/"), _text(F.col("doc_id")), F.lit(".gs")).alias("path"),
        F.when(F.col("edited"), F.concat(F.lit("edited "), "text")).otherwise(F.col("text")).alias("text"),
        F.timestamp_seconds(F.lit(1_700_000_000) + 3600 * F.col("hour")).alias("modification_time"),
        "first", "last",
    )
    return _files(rows, "first", "last")


def listing_of(files: DataFrame, which: str, hour: int) -> DataFrame:
    """The listing of `changing_files` at an hour."""
    return files.where(which).select(
        F.timestamp_seconds(F.lit(1_700_000_000 + 3600 * hour)).alias("listed"),
        "path", "relative_path", "ext", "modification_time", F.col("file_hash").alias("state"),
    )


def vector_store(spark: SparkSession, folder: str) -> DataFrame:
    """The table of vectors as a store; labels stand for chunk types."""
    return spread_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), _text(F.col("label")).alias("chunk_type"), "embedding"
    )


def gathered_store(spark: SparkSession, folder: str) -> DataFrame:
    """The same with each vector drawn to a place of its label: a quarter of it, and three along one axis."""
    axis = F.pmod(F.col("label") * 7, F.size("embedding"))
    moved = F.transform("embedding", lambda x, i: (x.cast("double") / 4 + F.when(i == axis, 3.0).otherwise(0.0)).cast("float"))
    return spread_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"), _text(F.col("label")).alias("chunk_type"), moved.alias("embedding")
    )


def piece_store(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of the documents with hashed-word vectors."""
    pieces = split_chunks(document_chunks(spread_table(spark, folder, "documents")))
    return embed(pieces, hashed_words(DIM))


def text_queries(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark passages as queries."""
    return table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# Fixed values of this test input: error messages, one by number `k` of an event.
MESSAGES = (
    "This model's maximum context length is 8192",
    "Unexpected token } in JSON",
    "Rate limit reached for requests",
    "Request failed with status 429",
    "Syntax error near line 3",
    "Could not PARSE the file",
    "Chunk is empty",
    "Failed to embed batch",
    "Upsert failed",
    "Chroma connection lost",
    "Disk full",
    "Embedding of chunk rejected: rate limit",
)


def event_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Events with an error message each."""
    k = F.get_json_object("props", "$.k").cast("int")
    message = F.get(F.array(*[F.lit(m) for m in MESSAGES]), k % len(MESSAGES))
    return table(spark, folder, "events").select("*", message.alias("error_message"))


def run_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a run log: a day is a session, the event type an outcome, the value chunks."""
    status = (
        F.when(F.col("event_type") == "view", "success")
        .when(F.col("event_type") == "click", "skipped")
        .when(F.col("event_type") == "signup", "parse_error")
        .when(F.col("event_type") == "purchase", "embedding_error")
        .otherwise("unknown_error")
    )
    success = F.col("event_type") == "view"
    path = F.concat(F.lit("user"), _text(F.col("user_id")), F.lit("/"), _text(F.col("event_id")))
    bad = ~F.col("event_type").isin("view", "click")
    return event_messages(spark, folder).select(
        F.col("ts").cast("timestamp").alias("ts"),
        F.date_format("ts", "yyyy-MM-dd").alias("session_id"),
        F.concat(F.lit(ROOT + "/"), path).alias("file_path"),
        path.alias("relative_path"),
        status.alias("status"),
        F.when(success, F.floor("value").cast("bigint")).alias("chunk_count"),
        F.when(bad, empty_to_null(F.col("error_message"))).alias("error_message"),
    )
