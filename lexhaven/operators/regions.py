"""Flat delimited units of template files (directives, scriptlets, expressions)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexhaven.functions.arrays import once, totals_before
from lexhaven.functions.text import led, newlines, not_blank
from lexhaven.schemas import DEFAULT_TEMPLATE_UNITS, TEMPLATE_UNITS, unit_rows


def extract_regions(
    files: DataFrame, units=DEFAULT_TEMPLATE_UNITS, catalogue=TEMPLATE_UNITS
) -> DataFrame:
    """Regions of each file in document order.

    Adds `chunk_index` (0-based over kept regions), `content`, `unit_type`,
    `chunk_type`, `line_start`, `line_end`. The catalogue's patterns are tried
    in its order at every position of the whole text; a region of a type not
    in `units` is passed over as a whole. A narrow pass without shuffle.
    """
    rows = unit_rows(catalogue)
    wanted = [n for n, r in enumerate(rows) if r[0] in set(units)]
    pattern = led("|".join(f"(?:{r[4]})" for r in rows), [r[4] for r in rows])
    text = F.col("text")

    def kind(region: Column) -> Column:
        column = F.lit(None).cast("int")
        for n, row in reversed(list(enumerate(rows))):
            column = F.when(region.rlike("^(?:" + row[4] + ")"), F.lit(n)).otherwise(column)
        return column

    # Region n comes after gap n; the last gap has no region.
    split_text = files.select(
        "*",
        once(
            F.zip_with(
                F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
                F.split(text, pattern, -1),
                lambda region, gap: F.struct(
                    region.alias("content"),
                    newlines(gap).alias("gap_nl"),
                    F.coalesce(newlines(region), F.lit(0)).alias("nl"),
                ),
            )
        ).alias("_parts"),
    ).drop("text")
    placed = F.zip_with(
        F.col("_parts"),
        totals_before("transform(_parts, p -> p.gap_nl + p.nl)"),
        lambda p, before: F.struct(
            p.content.alias("content"),
            kind(p.content).alias("unit"),
            (before + p.gap_nl + 1).alias("line_start"),
            (before + p.gap_nl + p.nl + 1).alias("line_end"),
        ),
    )
    kept = F.filter(placed, lambda p: p.unit.isin(wanted) & not_blank(p.content))
    out = split_text.select(
        *[c for c in split_text.columns if c != "_parts"],
        F.posexplode(kept).alias("chunk_index", "_u"),
    )

    def by_unit(field: int) -> Column:
        column = F.lit(None).cast("string")
        for n in wanted:
            if rows[n][field] is not None:
                column = F.when(F.col("_u.unit") == n, rows[n][field]).otherwise(column)
        return column

    return out.select(
        *[c for c in out.columns if c != "_u"],
        F.col("_u.content").alias("content"),
        by_unit(0).alias("unit_type"),
        F.coalesce(by_unit(1), F.lit("file")).alias("chunk_type"),
        F.col("_u.line_start").alias("line_start"),
        F.col("_u.line_end").alias("line_end"),
    )
