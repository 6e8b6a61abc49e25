"""String functions: names, paths, snippets, line counts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """Last segment of a path."""
    return F.substring_index(path, "/", -1)


def extname(path: Column) -> Column:
    """Suffix from the last dot of the file name, `''` without one or for a dotfile."""
    return F.regexp_extract(base_name(path), r".(\.[^.]*)$", 1)


def strip_scheme(path: Column) -> Column:
    """Path without URI scheme and host."""
    return F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?", "")


def relative_to(path: Column, root: str) -> Column:
    """Path below `root`; a path outside it keeps its file name only."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(
        base_name(path)
    )


def text_lines(text: Column) -> Column:
    """Lines of a text, split at line feeds."""
    return F.split(text, "\n", -1)


def newlines(text: Column) -> Column:
    """Number of line feeds in a text."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def not_blank(text: Column) -> Column:
    """True where a text holds anything but white space."""
    return text.rlike(r"\S")


def empty_to_null(value: Column) -> Column:
    """Metadata that is missing is NULL, never an empty string."""
    return F.nullif(value, F.lit(""))


def snippet(text: Column, size: int = 200) -> Column:
    """First `size` characters on one line, with `...` when there is more."""
    head = F.replace(F.substring(text, 1, size), F.lit("\n"), F.lit(" "))
    return F.concat(head, F.when(F.length(text) > size, F.lit("...")).otherwise(F.lit("")))


def runs_of(text: Column, size: int, beyond: int) -> Column:
    """A text longer than `beyond` as an array of runs of `size` characters, else NULL."""
    runs = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.when(F.length(text) > beyond, runs)


def cut(text: Column, runs: Column, size: int, start: Column, length: Column) -> Column:
    """`length` characters of a text from the 0-based `start`, by way of its runs if it has any.

    Finding a character by number walks the text from its beginning, so many
    cuts of one long text would take the square of its length.
    """
    first = F.floor(start / size).cast("int")
    last = F.floor((start + length - 1) / size).cast("int")
    near = F.substr(text, start + 1, length)
    around = F.array_join(F.slice(runs, first + 1, F.greatest(last - first + 1, F.lit(0))), "")
    return F.when(runs.isNull(), near).otherwise(F.substr(around, start - first * size + 1, length))


def first_characters(pattern: str) -> str | None:
    """Characters one of which begins every match of a regular expression, NULL where they are not plain to see.

    Read are alternatives that begin with a character for itself, also as a whole within `(?s:...)`.
    """
    if pattern.startswith("(?s:") and pattern.endswith(")"):
        inner, depth, at = pattern[4:-1], 0, 0
        while at < len(inner) and depth >= 0:
            depth += {"(": 1, ")": -1}.get(inner[at], 0)
            at += 2 if inner[at] == "\\" else 1
        pattern = inner if depth == 0 else pattern
    if re.search(r"\(\?[a-zA-Z-]|\[[^\]]*[|()\[]|\\Q", pattern):
        return None
    found, depth, at, begins = "", 0, 0, True
    while at < len(pattern) or begins:
        head = re.match(r"(?:\((?=\w+\)(?![*?{])))?([A-Za-z<>{}\"'/_%@#]|\\[^A-Za-z0-9])(?![*?{]|\|\|)", pattern[at:])
        if begins and not head:
            return None
        found += head[1][-1] if begins else ""
        begins = pattern[at] == "|" and depth == 0
        depth += {"(": 1, ")": -1}.get(pattern[at], 0)
        at += 2 if pattern[at] == "\\" else 1
    return found


def led(pattern: str, parts: list[str], more: str = "") -> str:
    """`pattern`, with a look at the first character before its alternatives are tried at each place.

    `parts` are what it is made of besides alternatives that begin with one of `more`.
    """
    heads = [first_characters(p) for p in parts]
    if not heads or None in heads:
        return pattern
    shown = "".join("\\" + c if not c.isalnum() else c for c in sorted(set("".join(heads) + more)))
    return f"(?=[{shown}])(?:{pattern})"


def percent(score: Column) -> Column:
    """Score as a percentage with one decimal."""
    return F.format_string("%.1f%%", score * 100)


def to_number(value: Column) -> Column:
    """Whole number, 0 where the value is none."""
    return F.coalesce(value.try_cast("int"), F.lit(0))


def package_of(text: Column) -> Column:
    """Dotted name of the file's package declaration, NULL without one.

    The declared name is what package filters are documented to match.
    """
    return empty_to_null(F.regexp_extract(text, r"(?m)^[ \t]*package[ \t]+([\w.]+)", 1))


def sortable_session(ts: Column) -> Column:
    """Session id: ISO time with `:` and `.` turned into `-`."""
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.regexp_replace(iso, "[:.]", "-")
