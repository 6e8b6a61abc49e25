"""Table schemas, closed value sets and unit catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _L, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


FILES = _struct(
    ("path", _S), ("relative_path", _S), ("ext", _S), ("language", _S),
    ("modification_time", _TS), ("length", _L), ("text", _S), ("file_hash", _S),
)

CHUNKS = _struct(
    ("id", _S), ("content", _S), ("absolute_path", _S), ("relative_path", _S),
    ("module", _S), ("package", _S), ("class_name", _S), ("enclosing_class", _S),
    ("method_name", _S), ("chunk_type", _S), ("language", _S),
    ("line_start", _I), ("line_end", _I), ("content_hash", _S),
    ("chunk_index", _I), ("sub_index", _I), ("piece_hash", _S),
)

STORE = T.StructType(
    CHUNKS.fields
    + [
        T.StructField("embedding", T.ArrayType(T.FloatType()), True),
        T.StructField("version", _L, True),
    ]
)

MANIFEST = _struct(
    ("path", _S), ("file_hash", _S), ("modification_time", _TS), ("chunk_count", _L),
)

ISSUE = _struct(
    ("type", _S), ("start_line", _I), ("start_column", _I),
    ("end_line", _I), ("end_column", _I), ("text", _S),
)

RUNLOG = _struct(
    ("ts", _TS), ("session_id", _S), ("file_path", _S), ("relative_path", _S),
    ("status", _S), ("chunk_count", _L), ("error_message", _S),
    ("error_details", T.ArrayType(ISSUE)), ("line_number", _I), ("column_number", _I),
    ("duration_ms", _L),
)

# `form` says how far a unit reaches: a `block` to its closing brace, a
# `statement` to the end of its line, a `region` to the end of its own pattern.
UNITS = _struct(
    ("unit_type", _S), ("chunk_type", _S), ("level", _S), ("form", _S), ("pattern", _S),
)

# File suffixes and the language label each one gets.
LANGUAGES = {
    ".gs": "gosu",
    ".gsx": "gosu",
    ".gst": "gosu_template",
}
TEMPLATE_LANGUAGE = "gosu_template"

# Folders never searched.
EXCLUDED_DIRS = ("node_modules", ".git", "dist", "build", ".idea", ".vscode")

# Chunk types a store may hold.
CHUNK_TYPES = (
    "package", "class", "interface", "enum", "function", "method", "property",
    "template_directive", "template_block", "file",
)

# Outcomes a run-log row may have.
STATUSES = (
    "success", "skipped", "parse_error", "chunk_error", "embedding_error",
    "storage_error", "rate_limit", "token_limit", "unknown_error",
)

# Default sizes.
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
EMBED_BATCH = 500
TOP_K = 10

# Vector length of well-known embedding models.
MODEL_DIMENSIONS = {
    "text-embedding-3-small": 1536,
    "text-embedding-3-large": 3072,
    "text-embedding-004": 768,
    "mxbai-embed-large": 1024,
    "nomic-embed-text": 768,
    "all-minilm": 384,
    "snowflake-arctic-embed": 1024,
}

# Source units: (unit_type, chunk_type, level, form, pattern). The pattern's
# first group is the unit's name. Unit types without a chunk type of their own
# become `file`.
SOURCE_UNITS = (
    ("class_declaration", "class", "class", "block", r"class\s+(\w+)"),
    ("interface_declaration", "interface", "class", "block", r"interface\s+(\w+)"),
    ("enum_declaration", "enum", "class", "block", r"enum\s+(\w+)"),
    ("enhancement_declaration", "class", "class", "block", r"enhancement\s+(\w+)"),
    ("function_declaration", "function", "method", "block", r"function\s+(\w+)"),
    ("property_declaration", "property", "method", "block", r"property\s+(?:get|set)\s+(\w+)"),
    ("uses_statement", None, None, "statement", r"uses\s+([\w.]+\*?)"),
    ("package_declaration", None, None, "statement", r"package\s+([\w.]+)"),
    ("constructor_declaration", None, None, "block", r"(construct)\s*\("),
)
DEFAULT_SOURCE_UNITS = (
    "class_declaration", "interface_declaration", "enum_declaration",
    "enhancement_declaration", "function_declaration", "property_declaration",
)

# Template units, tried in this order at every position.
TEMPLATE_UNITS = (
    ("comment", None, None, "region", r"(?s:<%--.*?--%>)"),
    ("directive", "template_directive", None, "region", r"(?s:<%@.*?%>)"),
    ("declaration", "template_block", None, "region", r"(?s:<%!.*?%>)"),
    ("expression", "template_block", None, "region", r"(?s:<%=.*?%>|\$\{[^}]*\})"),
    ("scriptlet", "template_block", None, "region", r"(?s:<%.*?%>)"),
)
DEFAULT_TEMPLATE_UNITS = ("directive", "scriptlet", "expression", "declaration")


def unit_list(text: str) -> list[str]:
    """Comma list of unit types, trimmed, blanks dropped."""
    return [name.strip() for name in text.split(",") if name.strip()]


def units_table(spark: SparkSession, rows=SOURCE_UNITS + TEMPLATE_UNITS) -> DataFrame:
    """The unit catalogue as a table, for joining on `unit_type`."""
    return spark.createDataFrame(list(rows), UNITS)


def unit_rows(units) -> list[tuple]:
    """Accept a catalogue as rows or as a small `UNITS` table."""
    if isinstance(units, DataFrame):
        # A catalogue is configuration: all its patterns become one expression.
        units = units.select(*UNITS.fieldNames()).collect()
    return [tuple(r) for r in units]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order, absent ones as NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def checked(value: Column, allowed, what: str) -> Column:
    """The value itself, or a failed task where it is outside a closed set."""
    bad = F.concat(F.lit(f"unknown {what}: "), F.coalesce(value, F.lit("NULL")))
    return F.when(value.isin(*allowed), value).otherwise(F.raise_error(bad))
