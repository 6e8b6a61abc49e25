"""Nested declaration units of source files (classes, functions, properties, ...).

One narrow pass: each file's text becomes an array of the tokens that matter
(strings, comments, braces, declarations), braces are matched within the array,
and the units found are exploded with their text. Nothing is shuffled and no Python
runs, so the cost is one read of the files however large the table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexhaven.functions.arrays import once, totals_before
from lexhaven.functions.text import cut, led, newlines, not_blank, package_of, runs_of
from lexhaven.schemas import (
    DEFAULT_SOURCE_UNITS,
    SOURCE_UNITS,
    unit_rows,
)

# Strings and comments are single tokens, so that braces inside them do not count.
# The possessive repeats are matched in a loop; greedy ones would need a stack
# frame for each escape in a string.
_QUIET = (
    r'''"(?:[^"\\\n]++|\\.)*+"|'(?:[^'\\\n]++|\\.)*+'|//[^\n]*|(?s:/\*.*?\*/)'''
)

_RUN = 1024
_LOW = 0xFFFFFFFF


def _tokens(text: Column, rows: list[tuple]) -> Column:
    """Tokens in order, each with the text skipped before it, as sizes only.

    The last entry is an empty `end` token after the rest of the text.
    """
    declared = "|".join(_ungrouped(r[4]) for r in rows)
    pattern = led(rf"{_QUIET}|[{{}}]|\b(?:{declared})", [r[4] for r in rows], "\"'/{}")

    def describe(token: Column, skipped: Column) -> Column:
        unit = F.lit(None).cast("struct<unit: int, name: string>")
        for n, row in reversed(list(enumerate(rows))):
            found = F.struct(F.lit(n).alias("unit"), F.regexp_extract(token, "^" + row[4], 1).alias("name"))
            unit = F.when(token.rlike("^" + row[4]), found).otherwise(unit)
        first = F.substring(token, 1, 1)
        return F.struct(
            first.alias("first"),
            F.length(skipped).alias("gap"),
            _without_newlines(skipped).alias("gap_rest"),
            F.length(token).alias("size"),
            _without_newlines(token).alias("rest"),
            # What is neither a brace nor quiet nor the end is a unit.
            F.when(~first.isin("{", "}", '"', "'", "/", ""), unit).alias("unit"),
        )

    matches = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
    return F.zip_with(matches, F.split(text, pattern, -1), describe)


def _without_newlines(text: Column) -> Column:
    return F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _ungrouped(pattern: str) -> str:
    """A unit pattern with its name group turned into a plain group."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "\\":
            out.append(pattern[i : i + 2])
            i += 2
            continue
        plain = pattern[i] == "(" and pattern[i + 1 : i + 2] != "?"
        out.append("(?:" if plain else pattern[i])
        i += 1
    return "".join(out)


def _step(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.select("*", once(value).alias(name))


def _placed(df: DataFrame) -> DataFrame:
    """Adds `_p`: declarations, braces and the end, with positions and lines."""

    def one(t: Column, n: Column) -> Column:
        before = F.get("_before", n)
        start = before.bitwiseAND(_LOW).cast("int") + t.gap
        line = F.shiftright(before, 32).cast("int") + t.gap - t.gap_rest + 1
        kind = F.when(t.unit.isNotNull(), "unit").when(t["first"] == "{", "open").when(t["first"] == "}", "close").otherwise("end")
        return F.struct(
            kind.alias("kind"), start.alias("start"), (start + t["size"]).alias("end"),
            line.alias("line"), (line + t["size"] - t.rest).alias("end_line"), t.unit.unit.alias("unit"),
            t.unit["name"].alias("name"),
        )

    # Characters and lines before a token are summed as one number, lines in its upper half.
    taken = "transform(_t, t -> CAST(t.gap + t.size AS BIGINT) + shiftleft(CAST(t.gap - t.gap_rest + t.size - t.rest AS BIGINT), 32))"
    df = _step(df, "_before", totals_before(taken, "0L"))
    kept = F.filter(
        F.transform("_t", lambda t, n: F.when(~t["first"].isin('"', "'", "/"), one(t, n))), lambda p: p.isNotNull()
    )
    return _step(df, "_p", kept)


def _matched(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """Adds `_scan` of `blocks` (an open end is NULL), `plain` units and `stray` braces.

    Braces are sorted by the depth outside them. Within a depth they come in
    turn, so the brace after an opening one closes it, and a closing one that
    comes after none, or after another closing one, is stray.
    """
    statements = [n for n, r in enumerate(rows) if r[3] == "statement"]
    ps, braces = F.col("_p"), F.col("_b")

    def takes_body(p: Column) -> Column:
        known = p.kind == "unit"
        return known & ~p.unit.isin(statements) if statements else known

    def mark(p: Column, n: Column) -> Column:
        unit = F.get(ps, n - 1)
        owned = (p.kind == "open") & takes_body(unit)
        return F.struct(
            (F.get("_depth", n) - F.when(p.kind == "close", 1).otherwise(0)).alias("outside"),
            n.alias("n"), p.kind.alias("kind"), p.start.alias("start"), p.end.alias("end"),
            p.line.alias("line"), p.end_line.alias("end_line"),
            F.when(owned, unit).alias("unit"),
        )

    def block(b: Column, n: Column) -> Column:
        close = F.get(braces, n + 1)
        closed = (close.outside == b.outside) & (close.kind == "close")
        found = F.struct(
            b.unit.start.alias("start"), F.when(closed, close.end).alias("end"),
            b.unit.line.alias("line"), F.when(closed, close.end_line).alias("end_line"),
            b.unit.unit.alias("unit"), b.unit["name"].alias("name"), F.lit(True).alias("whole"),
        )
        return F.when(b.unit.isNotNull(), found)

    def bodyless(p: Column, n: Column) -> Column:
        after = F.get(ps, n + 1)
        alone = (p.kind == "unit") & (~takes_body(p) | (after.kind != "open"))
        found = F.struct(
            p.start.alias("start"), F.when(takes_body(p), after.start).otherwise(p.end).alias("end"),
            p.line.alias("line"), p.line.alias("end_line"), p.unit.alias("unit"),
            p["name"].alias("name"), F.lit(False).alias("whole"),
        )
        return F.when(alone, found)

    def stray(b: Column, n: Column) -> Column:
        before = F.get(braces, n - 1)
        paired = (before.outside == b.outside) & (before.kind == "open")
        lone = (b.kind == "close") & ~F.coalesce(paired, F.lit(False))
        return F.when(
            lone, F.struct(b.start.alias("start"), b.end.alias("end"), b.line.alias("line"))
        )

    deeper = F.transform(
        ps, lambda p: F.when(p.kind == "open", 1).when(p.kind == "close", -1).otherwise(0)
    )
    df = _step(_step(df, "_deeper", deeper), "_depth", totals_before("_deeper")).drop("_deeper")
    marks = F.filter(F.transform(ps, mark), lambda m: m.kind.isin("open", "close"))
    df = _step(df, "_b", F.sort_array(marks))
    return _step(
        df, "_scan",
        F.struct(
            F.array_compact(F.transform(braces, block)).alias("blocks"),
            F.array_compact(F.transform(ps, bodyless)).alias("plain"),
            F.array_compact(F.transform(braces, stray)).alias("stray"),
        ),
    )


def _scanned(files: DataFrame, rows: list[tuple]) -> DataFrame:
    df = _step(files, "_t", _tokens(F.col("text"), rows))
    df = _matched(_placed(df), rows)
    return df.select(*files.columns, "_scan")


def _scopes(df: DataFrame) -> DataFrame:
    """Adds `_scope`: for each of `_units`, in their order, the name of the innermost of `_classes` around it.

    Classes nest, so at a unit the innermost open class is the last one before it that was
    opened at the unit's own depth. Sorted by depth and place, that class is the nearest
    before the unit; one count along the sorted list finds it.
    """
    opened, unit, closed = 2, 1, 0

    def event(at: Column, rank: int, change: int, n: Column, name: Column) -> Column:
        return F.struct(
            at.alias("at"), F.lit(rank).alias("rank"), n.alias("n"), name.alias("name"), F.lit(change).alias("change")
        )

    none, nameless = F.lit(-1), F.lit(None).cast("string")
    # At one place an ending class comes first, then a unit, then a class that begins.
    events = F.concat(
        F.transform("_classes", lambda c: event(c.start, opened, 1, none, c["name"])),
        F.transform(
            F.filter("_classes", lambda c: c.end.isNotNull()), lambda c: event(c.end, closed, -1, none, nameless)
        ),
        F.transform("_units", lambda u, n: event(u.start, unit, 0, n, nameless)),
    )
    df = _step(df, "_events", F.sort_array(events))
    df = _step(df, "_open", totals_before("_events.change"))

    def level(e: Column, n: Column) -> Column:
        depth = F.get("_open", n) + F.when(e["rank"] == opened, 1).otherwise(0)
        return F.struct(depth.alias("depth"), n.alias("at"), e["rank"].alias("rank"), e.n.alias("n"), e["name"].alias("name"))

    levels = F.filter(F.transform("_events", level), lambda e: e["rank"] != closed)
    df = _step(df, "_levels", F.sort_array(levels))
    df = _step(df, "_seen", totals_before(f"transform(_levels, e -> IF(e.rank = {opened}, 1, 0))"))
    df = _step(df, "_opened", F.filter("_levels", lambda e: e["rank"] == opened))

    def around(e: Column, n: Column) -> Column:
        name = F.when(e.depth > 0, F.get("_opened", F.get("_seen", n) - 1)["name"])
        return F.when(e["rank"] == unit, F.struct(e.n.alias("n"), name.alias("name")))

    found = F.sort_array(F.array_compact(F.transform("_levels", around)))
    return _step(df, "_scope", F.transform(found, lambda e: e["name"])).drop(
        "_events", "_open", "_levels", "_seen", "_opened"
    )


def extract_blocks(
    files: DataFrame, units=DEFAULT_SOURCE_UNITS, catalogue=SOURCE_UNITS
) -> DataFrame:
    """Units of each file in document order, outer before inner.

    Adds to the file's columns: `chunk_index` (0-based over kept units),
    `content`, `package`, `unit_type`, `name`, `enclosing_class`, `chunk_type`,
    `class_name`, `method_name`, `line_start`, `line_end`.

    A unit runs from its keyword to the brace closing its body; one without a
    body (an abstract method, a statement) to the end of its line or `;`.
    Unclosed units yield nothing and are reported by `block_issues`. Every
    declaration of the catalogue is recognised, so that bodies are matched the
    same way whatever `units` are asked for.
    """
    rows = unit_rows(catalogue)
    wanted = [n for n, r in enumerate(rows) if r[0] in set(units)]
    text = F.col("text")
    scanned = _scanned(files, rows)

    classes = [n for n, r in enumerate(rows) if r[2] == "class"]
    outer = F.filter(F.col("_scan.blocks"), lambda c: c.unit.isin(classes) if classes else F.lit(False))
    # Neither the text nor what is read from it may wait until the units are
    # exploded: each of their rows would carry the whole text.
    scanned = scanned.withColumn("package", package_of(text))
    closed = F.filter(
        F.concat("_scan.blocks", "_scan.plain"), lambda u: u.end.isNotNull() & u.unit.isin(wanted)
    )
    scanned = _step(scanned, "_classes", outer)
    scanned = _scopes(_step(scanned, "_units", F.sort_array(closed)))
    scanned = _step(scanned, "_runs", runs_of(text, _RUN, 4 * _RUN))

    def described(u: Column, n: Column) -> Column:
        body = cut(text, F.col("_runs"), _RUN, u.start, u.end - u.start)
        return F.struct(
            u.start.alias("start"),
            F.when(u.whole, body).otherwise(_first_line(body)).alias("content"),
            u.unit.alias("unit"), u["name"].alias("name"), u.line.alias("line"),
            u.end_line.alias("end_line"), F.get("_scope", n).alias("scope"),
        )

    kept = F.filter(F.transform("_units", described), lambda c: not_blank(c.content))

    def by_unit(field: int) -> Column:
        column = F.lit(None).cast("string")
        for n in wanted:
            if rows[n][field] is not None:
                column = F.when(F.col("_u.unit") == n, rows[n][field]).otherwise(column)
        return column

    out = scanned.select(
        *[c for c in files.columns if c != "text"],
        "package",
        F.posexplode(kept).alias("chunk_index", "_u"),
    )
    level, name = by_unit(2), F.col("_u.name")
    return out.select(
        *[c for c in out.columns if c != "_u"],
        F.col("_u.content").alias("content"),
        by_unit(0).alias("unit_type"),
        name.alias("name"),
        F.col("_u.scope").alias("enclosing_class"),
        F.coalesce(by_unit(1), F.lit("file")).alias("chunk_type"),
        F.when(level == "class", name).alias("class_name"),
        F.when(level == "method", name).alias("method_name"),
        F.col("_u.line").alias("line_start"),
        F.col("_u.end_line").alias("line_end"),
    )


def _first_line(text: Column) -> Column:
    """Text up to its first `;` or line end."""
    return F.rtrim(F.regexp_extract(text, r"^[^;\n]*;?", 0))


def block_issues(files: DataFrame, catalogue=SOURCE_UNITS) -> DataFrame:
    """Adds `issues`: stray closing braces (`ERROR`) and unclosed units (`MISSING`).

    In position order, 1-based, text cut to 200 characters.
    """
    rows = unit_rows(catalogue)
    text = F.col("text")
    scanned = _scanned(files, rows)
    last_line = F.lit(1) + newlines(text)

    def column_at(position: Column) -> Column:
        return F.length(F.substring_index(F.substr(text, F.lit(1), position), "\n", -1)) + 1

    def report(kind: str):
        def one(i: Column) -> Column:
            missing = kind == "MISSING"
            end = F.length(text) if missing else i.end
            return F.struct(
                i.start.alias("_at"),
                F.lit(kind).alias("type"),
                i.line.alias("start_line"),
                column_at(i.start).alias("start_column"),
                (last_line if missing else i.line).alias("end_line"),
                column_at(end).alias("end_column"),
                F.substr(text, i.start + 1, F.least(end - i.start, F.lit(200))).alias("text"),
            )

        return one

    unclosed = F.filter(F.col("_scan.blocks"), lambda u: u.end.isNull())
    found = F.concat(
        F.transform(F.col("_scan.stray"), report("ERROR")), F.transform(unclosed, report("MISSING"))
    )
    in_order = F.transform(
        F.sort_array(found),
        lambda i: F.struct(
            *[i[c].alias(c) for c in ("type", "start_line", "start_column", "end_line", "end_column", "text")]
        ),
    )
    return scanned.withColumn("issues", in_order).drop("_scan")
