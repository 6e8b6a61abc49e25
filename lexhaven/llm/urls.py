"""URL rules by a sort-merge range join.

The host of a url or rule becomes a key of its labels from the last to the first, each closed by
`/`, which no host holds: `www.example.com` is `com/example/www/`. A rule then covers the interval
of keys that begin with its own key, and within each host the interval of paths that begin with
its path. Urls are cut into ranges of (key, path) at sampled points; a rule goes to each range its
intervals reach. Each range is sorted once, rules before the urls of the same host, and swept: a
stack holds the rules of the hosts that enclose the current one. No rule list is broadcast.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AFTER_SCHEME = "(?s)^.*?://"

# Keys sampled for each range, and code points of a key that a cut between ranges keeps.
SAMPLED = 64
CUT_LENGTH = 256


def host_of(url: Column) -> Column:
    """Host: from the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, AFTER_SCHEME + "([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Path: what follows the host up to `?`, `#` or the end; empty without a scheme."""
    return F.coalesce(F.regexp_extract(url, AFTER_SCHEME + "[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each closed by `/`; empty for no host."""
    labels = F.reverse(F.split(host, "[.]", -1))
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(labels, "/"), F.lit("/")))


class PathRules:
    """Rules of one host, by path; finds the longest that a path begins with."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        """`rules` of (path, rule, verdict), one for each path, in any order."""
        rules = sorted(rules)
        self.paths = [path for path, _, _ in rules]
        self.rules = rules
        # The rule whose path encloses each: the nearest open interval before it.
        self.parents, open_ = [], []
        for i, path in enumerate(self.paths):
            while open_ and not path.startswith(self.paths[open_[-1]]):
                open_.pop()
            self.parents.append(open_[-1] if open_ else -1)
            open_.append(i)

    def longest(self, path: str) -> tuple[str, str, str] | None:
        i = bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.parents[i]
        return self.rules[i] if i >= 0 else None


class Sweep:
    """The stack of rules active at a place of the sorted order of one range."""

    def __init__(self):
        self.range = None
        self.stack: list[tuple[str, PathRules]] = []
        self.coming: tuple[str, list] | None = None
        self.last: tuple | None = None

    def _close(self, key: str) -> None:
        """Put the rules read for one host on the stack; take off hosts that do not enclose `key`."""
        if self.coming:
            host, rules = self.coming
            self._leave(host)
            self.stack.append((host, PathRules(rules)))
            self.coming = None
        self._leave(key)

    def _leave(self, key: str) -> None:
        while self.stack and not key.startswith(self.stack[-1][0]):
            self.stack.pop()

    def enter(self, part: int) -> None:
        if part != self.range:
            self.__init__()
            self.range = part

    def rule(self, key: str, path: str, rule: str, verdict: str) -> None:
        if self.coming and self.coming[0] != key:
            self._close(key)
        if not self.coming:
            self.coming = (key, [])
        self.coming[1].append((path, rule, verdict))

    def url(self, key: str, path: str) -> tuple[str | None, str | None]:
        """Rule and verdict for a url: the longest in code points, of equals that of the longer host."""
        if self.coming:
            self.last = None
        if self.last and self.last[0] == (key, path):
            return self.last[1]
        self._close(key)
        best, size = (None, None), -1
        for _, rules in self.stack:
            found = rules.longest(path)
            if found and len(found[1]) >= size:
                best, size = found[1:], len(found[1])
        self.last = ((key, path), best)
        return best


def _order(key: str, path: str) -> tuple[bytes, bytes]:
    return key[:CUT_LENGTH].encode(), path[:CUT_LENGTH].encode()


def range_of(cuts: list[tuple], key: str, path: str, salt: int) -> int:
    """The range that a url lies in: the number of cuts at or before it."""
    return bisect_right(cuts, (*_order(key, path), salt))


def ranges_of(cuts: list[tuple], key: str, path: str) -> list[int]:
    """Ranges that the intervals of a rule reach: its own host by path, and hosts below it."""
    (a, b), top = _order(key, path), b"\xff"
    own = range(bisect_left(cuts, (a, b)), bisect_left(cuts, (a, b + top)) + 1)
    below = range(bisect_left(cuts, (a, top)), bisect_left(cuts, (a + top,)) + 1)
    return sorted({*own, *below})


def judged(df: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All rows of `df` with `host`, `path`, the `rule` that decides (host and path) and its `verdict`.

    `rules` has `host`, `path` and `verdict`. A rule fits its host and all subdomains where the
    url's path begins with the rule's; the longest decides, of equally long ones that of the longer
    host; a rule given as both `block` and another verdict blocks. Urls that no rule fits get
    `default` and no rule. NULL urls and urls without `://` have empty host and path, and only a
    rule of empty host and path fits them; NULL host or path of a rule counts as empty. Repeated
    rows come back as often as given, also where one url holds most rows; empty tables of urls
    give none, empty rules the default everywhere. Columns of `df` named like one of the four are
    replaced, all others kept whatever their names. Urls of any length are compared whole. Select
    the columns you need first: they travel through one shuffle. A task holds the rules
    of one chain of hosts at a time.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = ("host", "path", "rule", "verdict")
    named = df.columns
    if len(set(named)) < len(named):
        raise ValueError("give columns of different names")
    rows = df.select(F.struct(*[df[f"`{c}`"] for c in named]).alias("row"), host_of(df[f"`{url}`"]).alias("host"), path_of(df[f"`{url}`"]).alias("path"))
    # Equal urls are dealt over several ranges by a number drawn from the row's place.
    urls = rows.select(
        host_key(F.col("host")).alias("key"), "path", F.xxhash64(F.monotonically_increasing_id()).alias("salt"), "host", "row"
    )
    sample = (
        urls.select(F.left("key", F.lit(CUT_LENGTH)).alias("key"), F.left("path", F.lit(CUT_LENGTH)).alias("path"), "salt")
        .orderBy("salt").limit(SAMPLED * parts).collect()
    )
    points = sorted((*_order(r["key"], r["path"]), r["salt"]) for r in sample)
    cuts = sorted({points[i * len(points) // parts] for i in range(1, parts)}) if points else []

    text = lambda name: F.coalesce(F.col(name), F.lit(""))
    each = (
        rules.select(F.translate(text("host"), UPPER, LOWER).alias("host"), text("path").alias("path"), "verdict")
        .groupBy("host", "path")
        .agg(F.max(F.col("verdict") == "block").alias("block"), F.max("verdict").alias("other"))
        .select(
            host_key(F.col("host")).alias("key"), "path", F.concat("host", "path").alias("rule"),
            F.when(F.col("block"), F.lit("block")).otherwise(F.col("other")).alias("verdict"),
        )
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, paths, salts = (batch.column(n).to_pylist() for n in ("key", "path", "salt"))
            found = [range_of(cuts, k, p, s) for k, p, s in zip(keys, paths, salts)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), *batch.columns], ["range", *batch.schema.names])

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [ranges_of(cuts, k, p) for k, p in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), *batch.columns], ["ranges", *batch.schema.names])

    row_type = urls.schema["row"].dataType
    placed = urls.mapInArrow(place, f"range int, key string, path string, salt long, host string, row {row_type.simpleString()}")
    reached = each.mapInArrow(reach, "ranges array<int>, key string, path string, rule string, verdict string")
    both = placed.select("range", "key", F.lit(1).alias("kind"), "path", "host", "row", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).unionByName(
        reached.select(
            F.explode("ranges").alias("range"), "key", F.lit(0).alias("kind"), "path", F.lit(None).cast("string").alias("host"),
            F.lit(None).cast(row_type).alias("row"), "rule", "verdict",
        )
    )

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Sweep()
        for batch in batches:
            column = {n: batch.column(n).to_pylist() for n in ("range", "key", "kind", "path", "rule", "verdict")}
            found = []
            for part, key, kind, path, rule, verdict in zip(*column.values()):
                state.enter(part)
                if kind == 0:
                    state.rule(key, path, rule, verdict)
                else:
                    found.append(state.url(key, path))
            if found:
                urls_only = batch.filter(pa.array([k == 1 for k in column["kind"]]))
                yield pa.RecordBatch.from_arrays(
                    [urls_only.column("row"), urls_only.column("host"), urls_only.column("path"),
                     pa.array([r for r, _ in found], pa.string()), pa.array([default if v is None else v for _, v in found], pa.string())],
                    ["row", *own],
                )

    swept = (
        both.repartitionById(max(1, len(cuts) + 1), F.col("range"))
        .sortWithinPartitions("range", "key", "kind", "path")
        .mapInArrow(sweep, f"row {row_type.simpleString()}, host string, path string, rule string, verdict string")
    )
    return swept.select(*[F.col("row").getField(c).alias(c) for c in named if c not in own], *own)
