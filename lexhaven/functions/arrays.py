"""Array functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_GROUP = 32


def once(value: Column) -> Column:
    """Generator giving the value itself, computed once per row.

    Select it under an alias: the optimizer merges plain projections, which
    would evaluate a costly array again for every use, or for every step of a
    lambda that reads it.
    """
    return F.explode(F.array(value))


def totals_before(values: str, zero: str = "0") -> Column:
    """For each entry of an int array, given in SQL, the sum of the entries before it.

    `zero` says of which type entries and sums are.

    Entries are summed within small groups; the sums of the groups are an array
    of the same kind, summed in the same way, level by level. A fold that appends
    to its result would copy all of it at every step. The nested lambdas are SQL
    text: put together call by call they cost seconds for each plan.
    """
    return F.expr(_totals(values, 3, zero))


def _totals(values: str, levels: int, zero: str) -> str:
    v, groups, g, bases = f"v{levels}", f"groups{levels}", f"g{levels}", f"bases{levels}"
    last = f"CAST(floor((greatest(size({v}), 1) - 1) / {_GROUP}) AS INT)"
    cut = f"transform(sequence(0, {last}), {g} -> slice({v}, {g} * {_GROUP} + 1, {_GROUP}))"
    sums = f"transform({groups}, {g} -> aggregate({g}, {zero}, (a, y) -> a + y))"
    below = _totals(sums, levels - 1, zero) if levels else _bound(sums, v, _inside(v, zero, zero))
    placed = f"flatten(zip_with({groups}, {bases}, ({g}, base) -> {_inside(g, 'base', zero)}))"
    return _bound(_bound(values, v, cut), groups, _bound(below, bases, placed))


def _bound(value: str, name: str, body: str) -> str:
    """`body` with `name` for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _inside(group: str, base: str, zero: str) -> str:
    return f"transform({group}, (x, n) -> {base} + aggregate(slice({group}, 1, n), {zero}, (a, y) -> a + y))"
