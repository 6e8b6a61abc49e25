"""Sorting error messages into run-log statuses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words in an error message and the status they stand for,
# tried from top to bottom.
ERROR_WORDS = (
    ("token_limit", ("maximum context length", "token")),
    ("rate_limit", ("rate limit", "429")),
    ("parse_error", ("parse", "syntax")),
    ("chunk_error", ("chunk",)),
    ("embedding_error", ("embed",)),
    ("storage_error", ("chroma", "upsert")),
)


def error_status(message: Column) -> Column:
    """Status of the first row of `ERROR_WORDS` with a word in the message."""
    text = F.lower(message)
    status = F.lit("unknown_error")
    for name, words in reversed(ERROR_WORDS):
        found = reduce(lambda a, b: a | b, [text.contains(w) for w in words])
        status = F.when(found, name).otherwise(status)
    return status
