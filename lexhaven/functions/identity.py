"""Content hashes and chunk ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_hash(text: Column) -> Column:
    """SHA-256 of a text, as hex."""
    return F.sha2(text, 256)


def chunk_id(
    module: Column,
    relative_path: Column,
    package: Column,
    class_name: Column,
    method_name: Column,
    chunk_type: Column,
    line_start: Column,
    line_end: Column,
    content_hash: Column,
    chunk_index: Column | None = None,
) -> Column:
    """MD5 over the colon-joined parts that are neither missing, empty nor line 0.

    The index is kept even when it is 0: two equal texts in one file differ by it.
    """
    names = [module, relative_path, package, class_name, method_name, chunk_type]
    parts = [F.nullif(c, F.lit("")) for c in names]
    parts += [F.nullif(c, F.lit(0)).cast("string") for c in (line_start, line_end)]
    parts.append(F.substring(content_hash, 1, 16))
    if chunk_index is not None:
        parts.append(chunk_index.cast("string"))
    return F.md5(F.concat_ws(":", *parts))


def piece_id(parent: Column, index: Column) -> Column:
    """Id of the n-th piece of a split chunk."""
    return F.concat(parent, F.lit("_sub"), index.cast("string"))
