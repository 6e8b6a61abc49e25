"""Exact nearest neighbours that compare a part of the store.

Every vector belongs to its nearest pivot and knows its distance from it. By
the triangle inequality no vector of a cluster is nearer to a query than the
query's distance from the pivot less the cluster's radius, nor than the gap
between both distances from the pivot. A query visits the clusters nearest to
it until these hold k vectors; the k-th distance found then closes all clusters
whose lower bound lies above it, and within the others all vectors outside a
ring around the pivot. What is left is compared, so the rows are those of
`search.search`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lexhaven.functions.vectors import DISTANCE_PLACES
from lexhaven.operators.search import FILTERS, _finish, _ids, _matrix, _passes, _vectors, metadata_filter
from lexhaven.schemas import TOP_K

# Pivots, and vectors that these are chosen from: bounds of what the driver holds.
PIVOTS = 256
SAMPLE = 4096

# Vectors of a cluster, and queries, that meet in one step.
BLOCK_ROWS = 16_384

# Queries whose clusters are chosen, or that are compared, at once, and rows of one batch of probes.
PROBE_ROWS = 1024

# Distances are compared with this much room for rounding.
_ROOM = 1e-6


def choose_pivots(store: DataFrame, n: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Up to `n` vectors far from each other, of `sample` drawn by a hash of the id.

    By default one for each sixteen drawn, `PIVOTS` at most.

    Each is the vector farthest from those before it, which finds one pivot for
    each natural cluster first. Fewer come back where the sample has fewer
    different vectors. The choice bears on speed alone, never on results.
    """
    drawn = (
        store.where("embedding is not null").select("embedding", F.xxhash64("id").alias("h")).orderBy("h", "embedding").limit(sample).toPandas()
    )
    if drawn.empty:
        return np.zeros((0, 0))
    rows = _matrix(drawn["embedding"], "stored vector")
    n = min(PIVOTS, -(-len(rows) // 16)) if n is None else n
    chosen, nearest = [0], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < n and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every row from every pivot; differences are squared, as products would lose small ones."""
    out = np.empty((len(rows), len(pivots)))
    for j, pivot in enumerate(pivots):
        out[:, j] = np.sqrt(((rows - pivot) ** 2).sum(axis=1))
    return out


def with_clusters(store: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows with a vector, their `cluster` (number of the nearest pivot) and their `gap` (distance from it).

    Write the result down, best sorted by both, and search it often.
    """
    shared = store.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("cluster int, gap double")
    def place(embedding: pd.Series) -> pd.DataFrame:
        if embedding.empty:
            return pd.DataFrame({"cluster": np.zeros(0, np.int32), "gap": np.zeros(0)})
        away = _distances(_matrix(embedding, "stored vector", shared.value.shape[1]), shared.value)
        own = away.argmin(axis=1)
        return pd.DataFrame({"cluster": own.astype(np.int32), "gap": away[np.arange(len(own)), own]})

    found = store.where("embedding is not null").withColumn("_place", place("embedding"))
    return found.select(*store.columns, "_place.cluster", "_place.gap")


def _probes(asked: DataFrame, pivots: np.ndarray, clusters: pd.DataFrame, first: bool) -> DataFrame:
    """Clusters that each query visits: those that hold its k first, or all others still open.

    Adds `cluster`, the query's distance `_away` from its pivot, and `_limit`, beyond which nothing counts.
    """
    shared = asked.sparkSession.sparkContext.broadcast((pivots, clusters))
    names = asked.columns if first else [c for c in asked.columns if c != "_limit"]
    fields = [*asked.select(*names).schema, T.StructField("cluster", T.IntegerType()), T.StructField("_away", T.DoubleType()), T.StructField("_limit", T.DoubleType())]
    kind = T.StructType(fields)
    shape = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, clusters = shared.value
        number, n = clusters["cluster"].to_numpy(), clusters["n"].to_numpy()
        least, most = clusters["least"].to_numpy(), clusters["most"].to_numpy()
        for batch in batches_of(batches, PROBE_ROWS):
            vectors = _vectors(batch.column("embedding"), "query vector", pivots.shape[1]).astype(np.float64)
            away = _distances(vectors, pivots)[:, number]
            bound = np.maximum(0.0, np.maximum(away - most, least - away))
            # Clusters by lower bound; of equal ones the nearer pivot first.
            order = np.lexsort((away, bound), axis=1)
            held = np.cumsum(n[order], axis=1) - n[order]
            home = held < batch.column("_k").to_numpy()[:, None]
            limit = np.full(batch.num_rows, np.inf) if first else batch.column("_limit").to_numpy()
            reach = np.take_along_axis(bound, order, axis=1) <= limit[:, None] * (1 + _ROOM) + _ROOM
            row, at = np.nonzero(home if first else reach & ~home)
            visited = order[row, at]
            # A query may visit all clusters; its vector is repeated for a few rows at once.
            kept = batch.select(names)
            for begin in range(0, len(row), PROBE_ROWS):
                rows, open_ = row[begin : begin + PROBE_ROWS], visited[begin : begin + PROBE_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [*kept.take(pa.array(rows)).columns, pa.array(number[open_], pa.int32()), pa.array(away[rows, open_]), pa.array(limit[rows])],
                    schema=shape,
                )

    return asked.mapInArrow(run, kind)


def batches_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most `rows`."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _compare(rows: pd.DataFrame, stored: np.ndarray, asked: pd.DataFrame, targets: np.ndarray, names: list[str]) -> pd.DataFrame:
    """The k best of a block of one cluster for each query, and how many were compared; vectors come as matrices.

    A row without id tells of a comparison that found nothing.
    """
    order = rows["gap"].argsort(kind="stable")
    rows, stored = rows.iloc[order], stored[order]
    ids, gaps = _ids(rows["id"]), rows["gap"].to_numpy()
    columns = {c: rows[c].to_numpy() for c in names}
    tests = list(asked[names].itertuples(index=False, name=None)) if names else [()] * len(asked)
    room = asked["limit"].to_numpy() * (1 + _ROOM) + _ROOM
    starts = np.searchsorted(gaps, asked["away"].to_numpy() - room, "left")
    ends = np.searchsorted(gaps, asked["away"].to_numpy() + room, "right")
    found, distances, counts, compared = [], [], [], []
    for i, (at, to, k) in enumerate(zip(starts.tolist(), ends.tolist(), asked["k"].tolist())):
        near = np.arange(at, to)
        if names:
            near = near[_passes(tests[i], names, {c: v[at:to] for c, v in columns.items()}, to - at)]
        away = stored[near].astype(np.float64) - targets[i]
        exact = np.round((away * away).sum(axis=1), DISTANCE_PLACES)
        best = np.lexsort((ids[near], exact))[:k]
        found.append(ids[near][best])
        distances.append(exact[best])
        counts.append(len(best))
        compared.append(len(near))
    # A query's first row tells how many were compared; a query without rows gets one for that alone.
    counts = np.array(counts)
    hits = np.repeat(np.arange(len(asked)), counts)
    none = np.flatnonzero(counts == 0)
    first = np.concatenate([[True], hits[1:] != hits[:-1]])[: len(hits)]
    at = np.concatenate([hits, none])
    told = np.concatenate([np.where(first, np.array(compared)[hits], 0), np.array(compared)[none]])
    out = asked[["query_id", "k", "min_score"]].iloc[at].rename(columns={"k": "_k", "min_score": "_min_score"})
    out.insert(1, "id", [*np.concatenate(found).tolist(), *[None] * len(none)])
    out.insert(2, "distance", [*np.concatenate(distances).tolist(), *[None] * len(none)])
    return out.assign(_compared=told)


def _met(corpus: DataFrame, probes: DataFrame, clusters: pd.DataFrame, n_queries: int, names: list[str], schema: T.StructType, block_rows: int) -> DataFrame:
    """Probes and their clusters in blocks of both, brought together by an equi-join on block numbers."""
    spark = corpus.sparkSession
    sizes = spark.createDataFrame(
        [(int(c), max(1, -(-int(n) // block_rows))) for c, n in zip(clusters["cluster"], clusters["n"])], "cluster int, _parts int"
    )
    # One row for each pivot.
    sizes = F.broadcast(sizes)
    part = F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int").alias("_part")
    left = corpus.join(sizes, "cluster").groupBy("cluster", part).agg(
        F.collect_list(F.struct("id", "embedding", "gap", *names)).alias("_rows")
    )
    groups = max(1, -(-n_queries // block_rows))
    asked = F.struct(
        "query_id", "embedding", *names, F.col("_k").alias("k"), F.col("_min_score").alias("min_score"),
        F.col("_away").alias("away"), F.col("_limit").alias("limit"),
    )
    right = probes.groupBy("cluster", F.pmod(F.xxhash64("query_id"), F.lit(groups)).alias("_group")).agg(F.collect_list(asked).alias("_asked"))
    right = right.join(sizes, "cluster").select("cluster", "_asked", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))

    shape = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                items = pa.RecordBatch.from_struct_array(batch.column("_rows").slice(n, 1).flatten())
                rows, stored = items.drop_columns(["embedding"]).to_pandas(), _vectors(items.column("embedding"), "stored vector")
                packed = batch.column("_asked").slice(n, 1).flatten()
                # A part of the queries at a time bounds what is found at once.
                for at in range(0, len(packed), PROBE_ROWS):
                    part = pa.RecordBatch.from_struct_array(packed.slice(at, PROBE_ROWS))
                    targets = _vectors(part.column("embedding"), "query vector", stored.shape[1]).astype(np.float64)
                    found = _compare(rows, stored, part.drop_columns(["embedding"]).to_pandas(), targets, names)
                    yield pa.RecordBatch.from_pandas(found, shape, preserve_index=False)

    return left.join(right, ["cluster", "_part"]).select("_rows", "_asked").mapInArrow(run, schema)


def search_pruned(
    clustered: DataFrame, pivots: np.ndarray, queries: DataFrame, work: str, k: int = TOP_K, filters: dict | None = None,
    min_score: float = 0.0, match_enclosing: bool = False, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """`search.search` over a store with `cluster` and `gap`, and `compared`: vectors compared for each query.

    `clustered` comes from `with_clusters` and the same `pivots`. Queries and settings are those of
    `search.search`; filters of single queries leave fewer vectors in the clusters visited first,
    and then more are visited. Hits of the first visits are written below `work`, a folder that
    executors share. A cluster of any size is split into blocks of `block_rows`.
    """
    spark = clustered.sparkSession
    corpus = clustered.where(metadata_filter(filters, match_enclosing))
    names = [c for c in FILTERS if c in queries.columns]
    setting = lambda name, value: F.coalesce(name, F.lit(value)) if name in queries.columns else F.lit(value)
    asked = queries.select(
        "query_id", "embedding", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in names],
        setting("k", k).cast("int").alias("_k"), setting("min_score", min_score).cast("double").alias("_min_score"),
    ).where("embedding is not null and _k > 0")
    schema = T.StructType([
        asked.schema["query_id"], T.StructField("id", corpus.schema["id"].dataType), T.StructField("distance", T.DoubleType()),
        T.StructField("_k", T.IntegerType()), T.StructField("_min_score", T.DoubleType()), T.StructField("_compared", T.LongType()),
    ])
    clusters = corpus.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.min("gap").alias("least"), F.max("gap").alias("most")
    ).toPandas()
    if clusters.empty:
        found = spark.createDataFrame([], schema)
    else:
        n_queries = asked.count()
        first = _met(corpus, _probes(asked, pivots, clusters, True), clusters, n_queries, names, schema, block_rows)
        first.write.parquet(f"{work}/first")
        first = spark.read.schema(first.schema).parquet(f"{work}/first")
        # The k-th distance of a query closes clusters; without k hits all stay open.
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        kth = first.where("id is not null").withColumn("_place", place).where("_place = _k")
        limits = kth.select("query_id", F.sqrt("distance").alias("_limit"))
        open_ = asked.join(limits, "query_id", "left").withColumn("_limit", F.coalesce("_limit", F.lit(float("inf"))))
        rest = _met(corpus, _probes(open_, pivots, clusters, False), clusters, n_queries, names, schema, block_rows)
        found = first.unionByName(rest)

    compared = found.groupBy("query_id").agg(F.sum("_compared").alias("compared"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    ranked = found.where("id is not null").drop("_compared").withColumn("rank", rank.cast("int")).where("rank <= _k").drop("_k")
    chunk = [c for c in clustered.columns if c not in ("embedding", "version", "cluster", "gap")]
    if chunk != ["id"]:
        ranked = corpus.select(*chunk).join(ranked, "id")
    return _finish(ranked.select("query_id", "rank", *chunk, "distance", "_min_score")).join(compared, "query_id")
