"""Filtered nearest-neighbour search, for one vector or for tables of queries.

Results are exact: every vector that passes the filters is compared. Rows come
as `HITS`: query id, rank from 1, the chunk's columns, distance and score.
Equal distances rank by id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexhaven.functions.vectors import DISTANCE_PLACES, score_of, squared_l2
from lexhaven.operators.embedding import embed
from lexhaven.schemas import TOP_K

# Query columns that restrict their own query; relative_path matches a part.
FILTERS = ("package", "class_name", "chunk_type", "language", "relative_path")

# Queries held by every task at once, and hits sent to every task to fetch
# their chunks. Larger tables take the routes by join.
BROADCAST_QUERIES = 4096
BROADCAST_HITS = 500_000

# Bytes of vectors in one block of the route by join.
BLOCK_BYTES = 4 << 20

# Query vectors that one task of that route holds, stored vectors that it brings
# together, and how many of both are compared at once.
GROUP_ROWS = 1 << 18
PART_ROWS = 1 << 16
TILE_QUERIES, TILE_ROWS = 1024, 4096

# Pairs whose distances are summed at once.
PAIRS = 1 << 15


def metadata_filter(filters: dict | None, match_enclosing: bool = False) -> Column:
    """AND of the filters given; a filter that is empty or None is not set.

    All match by equality but `relative_path`, which matches a part of the
    path. With `match_enclosing` a class name also matches the units inside
    that class, as the documented queries expect.
    """
    filters = {k: v for k, v in (filters or {}).items() if v}
    unknown = set(filters) - set(FILTERS)
    if unknown:
        raise ValueError(f"unknown filters: {', '.join(sorted(unknown))}")
    tests = [F.lit(True)]
    for name, value in filters.items():
        if name == "relative_path":
            tests.append(F.col(name).contains(F.lit(value)))
        elif name == "class_name" and match_enclosing:
            tests.append((F.col(name) == value) | (F.col("enclosing_class") == value))
        else:
            tests.append(F.col(name) == value)
    return reduce(lambda a, b: a & b, tests[1:] or tests)


def _finish(hits: DataFrame) -> DataFrame:
    """Score, limit by score after the top k, and leave out hits without text."""
    hits = hits.withColumn("score", score_of(F.col("distance"))).where("score >= _min_score")
    if "content" in hits.columns:
        hits = hits.where("content is not null and content <> ''")
    return hits.drop("_min_score")


def nearest(
    store: DataFrame,
    vector,
    k: int = TOP_K,
    filters: dict | None = None,
    min_score: float = 0.0,
    query_id="0",
    match_enclosing: bool = False,
) -> DataFrame:
    """Hits of a single query vector, without Python and without shuffle.

    Filters reach the Parquet scan, and each task keeps k rows.
    """
    target = F.lit([float(v) for v in vector])
    found = store.where(metadata_filter(filters, match_enclosing)).where("embedding is not null")
    top = (
        found.withColumn("distance", squared_l2(F.col("embedding"), target))
        .orderBy("distance", "id")
        .limit(k)
    )
    # The window sees the k rows left.
    rank = F.row_number().over(Window.orderBy("distance", "id"))
    chunk = [c for c in store.columns if c not in ("embedding", "version")]
    hits = top.select(
        F.lit(query_id).alias("query_id"), rank.cast("int").alias("rank"), *chunk, "distance",
        F.lit(float(min_score)).alias("_min_score"),
    )
    return _finish(hits)


class _Queries:
    """A block of query vectors with their ids, filters and limits."""

    def __init__(self, ids, vectors: np.ndarray, filters: list[tuple], ks, scores):
        self.ids, self.vectors, self.filters = ids, vectors, filters
        self.ks, self.scores = ks, scores
        groups: dict[tuple, list[int]] = {}
        for n, test in enumerate(filters):
            groups.setdefault(test, []).append(n)
        self.groups = {test: np.array(rows) for test, rows in groups.items()}


def _matrix(vectors, what: str, dim: int | None = None) -> np.ndarray:
    rows = [np.asarray(v, dtype=np.float64) for v in vectors]
    dim = len(rows[0]) if dim is None else dim
    for row in rows:
        if len(row) != dim:
            raise ValueError(f"{what} of {len(row)} numbers where {dim} are expected")
    return np.stack(rows)


def _passes(test: tuple, names: list[str], columns: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Rows that pass one query's filters."""
    mask = np.ones(n, dtype=bool)
    for name, value in zip(names, test):
        if value is None:
            continue
        column = columns[name]
        if name == "relative_path":
            mask &= np.array([v is not None and value in v for v in column], dtype=bool)
        else:
            mask &= column == value
    return mask


def _first_copies(rows: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows left when of equal vectors only those with the k least ids stay, as no other can be a hit."""
    whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.dtype.itemsize * rows.shape[1]))).ravel()
    different, group = np.unique(whole, return_inverse=True)
    if len(different) == len(rows):
        return np.arange(len(rows))
    order = np.lexsort((ids, group))
    starts = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) != 0]))
    place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
    return np.sort(order[place < k])


class _Best:
    """The k best rows so far of every query of a block, and the distance beyond which no row counts."""

    def __init__(self, block: _Queries):
        self.block = block
        self.ks = np.asarray(block.ks, dtype=np.int64)
        self.limits = np.where(self.ks < 1, -1.0, np.inf)
        self.norms = np.einsum("ij,ij->i", block.vectors, block.vectors, dtype=np.float64)
        self.held, self.fresh, self.n_fresh = None, [], 0

    def add(self, names, ids: np.ndarray, vectors: np.ndarray, columns) -> None:
        """Compare a part of the store with all queries."""
        for test, queries in self.block.groups.items():
            queries = queries[self.ks[queries] > 0]
            mask = _passes(test, names, columns, len(ids))
            if not mask.any() or not len(queries):
                continue
            rows, row_ids = vectors[mask], ids[mask]
            kept = _first_copies(rows, row_ids, int(self.ks[queries].max()))
            rows, row_ids = rows[kept], row_ids[kept]
            norms = np.einsum("ij,ij->i", rows, rows, dtype=np.float64)
            for at in range(0, len(rows), TILE_ROWS):
                tile = slice(at, at + TILE_ROWS)
                for begin in range(0, len(queries), TILE_QUERIES):
                    self._tile(queries[begin : begin + TILE_QUERIES], rows[tile], norms[tile], row_ids[tile])
                # Limits are worth a sort once they can fall for many.
                if self.n_fresh and (self.held is None or 2 * self.n_fresh > len(self.held[0]) or np.isinf(self.limits[queries]).any()):
                    self._merge()

    def _tile(self, queries: np.ndarray, rows: np.ndarray, norms: np.ndarray, ids: np.ndarray, kind=np.float32) -> None:
        """Hits of some rows that may be among a query's best.

        A product in single precision gives a lower bound of every distance by an allowance above
        its rounding error, taken from both norms. What it leaves is summed directly, as `squared_l2` does.
        """
        q_norms, limits = self.norms[queries], self.limits[queries]
        if kind is np.float32 and not max(q_norms.max(), norms.max()) < 1e30:
            kind = np.float64
        part = (rows.shape[1] + 8) * np.finfo(kind).eps
        left = np.concatenate([-2.0 * self.block.vectors[queries], np.ones((len(queries), 1))], axis=1).astype(kind)
        right = np.concatenate([rows, ((1 - part) * norms)[:, None]], axis=1).astype(kind)
        low = left @ right.T
        ks = self.ks[queries]
        if np.isinf(limits).any():
            # The k-th upper bound of the rows at hand is a limit too.
            k = min(int(ks.max()), len(rows))
            first = np.partition(low + (2 * part * norms).astype(kind), k - 1, axis=1)[:, :k]
            first.sort(axis=1)
            kth = first[np.arange(len(queries)), np.minimum(ks, k) - 1].astype(np.float64) + (1 + part) * q_norms
            limits = np.where((ks <= k) & (kth == kth), np.minimum(limits, kth), limits)
        room = 4.0 * 10.0**-DISTANCE_PLACES + 4 * np.finfo(kind).eps * (np.abs(limits) + q_norms)
        near = np.flatnonzero(low <= (limits - (1 - part) * q_norms + room).astype(kind)[:, None])
        if kind is np.float32 and len(near) > 16 * int(ks.sum()) + len(low):
            # Distances too small beside the norms for single precision.
            return self._tile(queries, rows, norms, ids, np.float64)
        i, j = np.divmod(near, len(rows))
        for at in range(0, len(near), PAIRS):
            a, b = i[at : at + PAIRS], j[at : at + PAIRS]
            gaps = rows[b].astype(np.float64) - self.block.vectors[queries[a]]
            exact = np.round((gaps * gaps).sum(axis=1), DISTANCE_PLACES)
            good = exact <= limits[a] + 4.0 * 10.0**-DISTANCE_PLACES + 1e-11 * (q_norms[a] + norms[b])
            self.fresh.append((queries[a[good]], exact[good], ids[b[good]]))
            self.n_fresh += int(good.sum())

    def _merge(self) -> None:
        parts = ([self.held] if self.held else []) + self.fresh
        q, distances, ids = (np.concatenate([p[n] for p in parts]) for n in range(3))
        order = np.lexsort((ids, distances, q))
        q, distances, ids = q[order], distances[order], ids[order]
        starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])[: len(q)])
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        last = place == self.ks[q] - 1
        self.limits[q[last]] = distances[last]
        kept = place < self.ks[q]
        self.held, self.fresh, self.n_fresh = (q[kept], distances[kept], ids[kept]), [], 0

    def output(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The best rows of all queries, in batches."""
        if self.n_fresh:
            self._merge()
        if not self.held:
            return
        for at in range(0, len(self.held[0]), PAIRS):
            q, distances, ids = (v[at : at + PAIRS] for v in self.held)
            block = self.block
            found = pd.DataFrame({
                "query_id": np.asarray(block.ids)[q], "id": ids, "distance": distances,
                "_k": np.asarray(block.ks)[q], "_min_score": np.asarray(block.scores)[q],
            })
            yield pa.RecordBatch.from_pandas(found, schema, preserve_index=False)


def _ids(values) -> np.ndarray:
    # Code points order strings as Spark orders their UTF-8 bytes.
    return np.asarray(list(values))


def search(
    store: DataFrame,
    queries: DataFrame,
    k: int = TOP_K,
    filters: dict | None = None,
    min_score: float = 0.0,
    match_enclosing: bool = False,
    broadcast_queries: int = BROADCAST_QUERIES,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Hits of every query of a table `(query_id, embedding, ...)`.

    `filters` hold for all queries and reach the Parquet scan. The query table
    may also have the columns of `FILTERS`, `k` and `min_score` for settings of
    single queries. `min_score` is applied to the top k, so fewer than k hits
    may remain.

    Up to `broadcast_queries` queries go to every task, which keeps the k best
    of its own vectors per query: the store is scanned once and only those rows
    are shuffled. More queries, counted first, meet the store in blocks: both
    sides are packed into arrays of about `block_bytes`, queries are dealt into
    groups, and each group's task keeps its k best rows while the blocks of the
    store, copied to each group, go by.
    That route reads the query table more than once, so queries that are costly
    to embed are better written down first.
    """
    chosen = store.where(metadata_filter(filters, match_enclosing))
    corpus = chosen.where("embedding is not null")
    names = [c for c in FILTERS if c in queries.columns]
    asked = queries.select(
        "query_id",
        "embedding",
        *[F.nullif(F.col(c), F.lit("")).alias(c) for c in names],
        (F.coalesce("k", F.lit(k)) if "k" in queries.columns else F.lit(k)).cast("int").alias("_k"),
        (F.coalesce("min_score", F.lit(min_score)) if "min_score" in queries.columns else F.lit(min_score))
        .cast("double").alias("_min_score"),
    ).where("embedding is not null")
    schema = T.StructType(
        [
            asked.schema["query_id"],
            corpus.schema["id"],
            T.StructField("distance", T.DoubleType()),
            T.StructField("_k", T.IntegerType()),
            T.StructField("_min_score", T.DoubleType()),
        ]
    )
    vectors = corpus.select("id", "embedding", *names)
    few = asked.limit(broadcast_queries + 1).toPandas()
    if len(few) == 0:
        found = store.sparkSession.createDataFrame([], schema)
    elif len(few) <= broadcast_queries:
        found = _by_broadcast(vectors, few, names, schema)
    else:
        found = _by_blocks(vectors, asked, names, schema, block_bytes)

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    ranked = found.withColumn("rank", rank.cast("int"))
    limit = k if "k" not in queries.columns else None
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    ranked = ranked.where("rank <= _k").drop("_k")

    chunk = [c for c in store.columns if c not in ("embedding", "version")]
    if chunk != ["id"]:
        small = len(few) <= broadcast_queries and len(few) * k <= BROADCAST_HITS
        # Few hits are sent to the store's tasks, so the store stays in place. The
        # vectors are not read again for this.
        hits = F.broadcast(ranked) if small and limit is not None else ranked
        ranked = chosen.select(*chunk).join(hits, "id")
    return _finish(ranked.select("query_id", "rank", *chunk, "distance", "_min_score"))


def _vectors(column: pa.Array, what: str, dim: int | None = None) -> np.ndarray:
    """Vectors of an Arrow column as a matrix."""
    sizes = np.diff(column.offsets.to_numpy())
    dim = int(sizes[0]) if dim is None else dim
    for size in sizes[sizes != dim]:
        raise ValueError(f"{what} of {size} numbers where {dim} are expected")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(sizes), dim)


def _by_broadcast(vectors: DataFrame, few: pd.DataFrame, names, schema: T.StructType) -> DataFrame:
    block = _block_of(few, names)
    shared = vectors.sparkSession.sparkContext.broadcast(block)
    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = _Best(block)
        for batch in batches:
            if batch.num_rows:
                rows = _vectors(batch.column("embedding"), "stored vector", block.vectors.shape[1])
                columns = {c: batch.column(c).to_pandas().to_numpy() for c in names}
                best.add(names, _ids(batch.column("id").to_pandas()), rows, columns)
        yield from best.output(shape)

    return vectors.mapInArrow(run, schema)


def _block_of(frame: pd.DataFrame, names, vectors: np.ndarray | None = None) -> _Queries:
    tests = [
        tuple(None if v is None or v != v else v for v in row)
        for row in (frame[names].itertuples(index=False, name=None) if names else [()] * len(frame))
    ]
    return _Queries(
        frame["query_id"].to_numpy(), _matrix(frame["embedding"], "query vector") if vectors is None else vectors, tests,
        frame["_k"].to_numpy(), frame["_min_score"].to_numpy(),
    )


def _blocks(df: DataFrame, rows: int, groups: int, packed: str) -> DataFrame:
    """Pack the rows of each task into blocks of `rows` as they come, dealt to `groups` in turn.

    No key has a part in it, so one that is on many rows makes no block larger.
    """
    kind = T.StructType([T.StructField("_group", T.IntegerType()), T.StructField(packed, T.ArrayType(df.schema))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                items = batch.slice(at, rows).to_struct_array()
                block = pa.ListArray.from_arrays(pa.array([0, len(items)], pa.int32()), items)
                yield pa.RecordBatch.from_arrays([pa.array([n % groups], pa.int32()), block], ["_group", packed])
                n += 1

    return df.mapInArrow(run, kind)


def _by_blocks(vectors: DataFrame, asked: DataFrame, names, schema: T.StructType, block_bytes: int) -> DataFrame:
    """Each group of queries, as large as a task may hold, sees all blocks of the store go by.

    Only a group's k best rows leave its task. The store is copied once for each group, which
    is far less than for each block: its copies are fewer than a 200,000th of all pairs.
    """
    count, dim = asked.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    rows_per_block = max(1, block_bytes // (4 * max(1, dim)))
    # As many groups as there are cores, or a multiple of that.
    cores = asked.sparkSession.sparkContext.defaultParallelism
    groups = cores * -(-count // (GROUP_ROWS * cores)) if count >= TILE_QUERIES * cores else max(1, -(-count // TILE_QUERIES))
    right = _blocks(asked, max(1, min(rows_per_block, count // (8 * groups))), groups, "_asked")
    left = _blocks(vectors, rows_per_block, 1, "_rows").select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("_group"), "_rows"
    )
    both = right.unionByName(left, allowMissingColumns=True)
    # The queries of a group come first.
    met = both.repartitionById(groups, "_group").sortWithinPartitions("_group", F.col("_rows").isNotNull())
    shape = to_arrow_schema(schema)

    def columns_of(parts: list[pa.Array]) -> pa.Table:
        return pa.Table.from_batches([pa.RecordBatch.from_struct_array(p) for p in parts]).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked_parts, parts, best = None, [], [], None

        def compare() -> None:
            nonlocal best, parts, asked_parts
            if best is None and asked_parts:
                table = columns_of(asked_parts)
                queries = _vectors(table.column("embedding").combine_chunks(), "query vector")
                best, asked_parts = _Best(_block_of(table.drop_columns(["embedding"]).to_pandas(), names, queries)), []
            if best is not None and parts:
                table = columns_of(parts)
                rows = _vectors(table.column("embedding").combine_chunks(), "stored vector", best.block.vectors.shape[1])
                columns = {c: table.column(c).to_pandas().to_numpy() for c in names}
                best.add(names, _ids(table.column("id").to_pandas()), rows, columns)
            parts = []

        for batch in batches:
            packed_queries, packed_rows = batch.column("_asked"), batch.column("_rows")
            for n, own in enumerate(batch.column("_group").to_pylist()):
                if own != group:
                    compare()
                    if best is not None:
                        yield from best.output(shape)
                    group, asked_parts, best = own, [], None
                if packed_rows.is_valid()[n].as_py():
                    parts.append(packed_rows.slice(n, 1).flatten())
                    if sum(map(len, parts)) >= PART_ROWS:
                        compare()
                else:
                    asked_parts.append(packed_queries.slice(n, 1).flatten())
        compare()
        if best is not None:
            yield from best.output(shape)

    return met.mapInArrow(run, schema)


def search_text(
    store: DataFrame, queries: DataFrame, make, column: str = "text", **options
) -> DataFrame:
    """`search` for a table `(query_id, <column>, ...)`, embedded first."""
    return search(store, embed(queries, make, column).drop(column), **options)
