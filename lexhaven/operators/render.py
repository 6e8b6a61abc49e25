"""Search results as text: one row per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexhaven.functions.text import percent, snippet
from lexhaven.schemas import TEMPLATE_LANGUAGE

# The wording of both forms.
NO_HITS = "No results found."
FOUND = "\n📊 Found %d results:\n\n"
HIT = "\n%d. Score: %s\n   📁 %s\n"
PACKAGE = "   📦 Package: %s\n"
CLASS = "   🏷️  Class: %s\n"
METHOD = "   🔧 Method: %s\n"
PLACE = "   📝 Type: %s\n   📍 Lines: %d-%d\n"
SNIPPET = "   💬 \"%s\"\n"

NO_CONTEXT = "No relevant code found in the knowledge base."
CONTEXT = "# Retrieved Code Context\n\nFound %d relevant code chunks:\n\n---\n\n"
CONTEXT_HIT = "## Result %d\n\n**Location:**\n- File: `%s`\n- Lines: %d-%d\n"
CONTEXT_PACKAGE = "- Package: `%s`\n"
CONTEXT_CLASS = "- Class: `%s`\n"
CONTEXT_METHOD = "- Method: `%s`\n"
CONTEXT_PLACE = "- Type: %s\n- Language: %s\n\n**Code:**\n"
CONTEXT_CODE = "```%s\n%s\n```\n\n---\n\n"
CONTEXT_NOTE = (
    "\n**Note:** Use this retrieved context to inform your code generation. "
    "Ensure your code aligns with the patterns, naming conventions, and structures shown above.\n"
)
FENCES = {"gosu": "gosu", "gosu_template": "gosu-template"}


_USED = (
    "rank", "id", "score", "relative_path", "package", "class_name", "method_name", "chunk_type",
    "language", "line_start", "line_end", "content",
)


def _line(pattern: str, value: Column) -> Column:
    """A line for a value that is there, else nothing."""
    return F.when(
        F.nullif(value, F.lit("")).isNotNull(), F.format_string(pattern, value)
    ).otherwise(F.lit(""))


def _by_query(hits: DataFrame, queries: DataFrame, entry, opening, closing: str, none: str):
    """Join a query's entries in rank order; queries without hits get `none`.

    A query has at most k hits, so its list is short.
    """
    listed = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(*_USED))).alias("_hits")
    )
    entries = F.array_join(F.transform("_hits", entry), "")
    text = F.concat(opening(F.size("_hits")), entries, F.lit(closing))
    done = listed.select("query_id", text.alias("rendered"))
    return (
        queries.select("query_id").distinct().join(done, "query_id", "left")
        .withColumn("rendered", F.coalesce("rendered", F.lit(none)))
    )


def render_human(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """`query_id, rendered`: a numbered listing with scores and snippets."""

    def entry(h: Column, n: Column) -> Column:
        return F.concat(
            F.format_string(HIT, n + 1, percent(h.score), h.relative_path),
            _line(PACKAGE, h.package),
            _line(CLASS, h.class_name),
            _line(METHOD, h.method_name),
            F.format_string(PLACE, h.chunk_type, h.line_start, h.line_end),
            F.format_string(SNIPPET, snippet(h.content)),
        )

    return _by_query(hits, queries, entry, lambda n: F.format_string(FOUND, n), "", NO_HITS)


def render_agent(hits: DataFrame, queries: DataFrame, fences: dict = FENCES) -> DataFrame:
    """`query_id, rendered`: Markdown context with the whole text of every hit."""

    def fence(language: Column) -> Column:
        return F.when(
            language == TEMPLATE_LANGUAGE, fences[TEMPLATE_LANGUAGE]
        ).otherwise(fences["gosu"])

    def entry(h: Column, n: Column) -> Column:
        return F.concat(
            F.format_string(CONTEXT_HIT, n + 1, h.relative_path, h.line_start, h.line_end),
            _line(CONTEXT_PACKAGE, h.package),
            _line(CONTEXT_CLASS, h.class_name),
            _line(CONTEXT_METHOD, h.method_name),
            F.format_string(CONTEXT_PLACE, h.chunk_type, h.language),
            F.format_string(CONTEXT_CODE, fence(h.language), h.content),
        )

    return _by_query(
        hits, queries, entry, lambda n: F.format_string(CONTEXT, n), CONTEXT_NOTE, NO_CONTEXT
    )
