"""Importance resampling towards a target distribution.

Bags of hashed word runs of all documents and of all target texts give each bucket a gain; a
document's weight is the mean gain of its runs, read from an array in each task. Weight plus a
keyed Gumbel number is its score, and the highest scores are drawn without replacement. The last
score drawn is found by distributed quickselect: each pass takes random pivots, counts the rows
between them exactly and goes on in the part that holds the k-th key. Only the winners are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexhaven.llm.common import batches_of, text_buffer, work_folder, written

# Parts that a pass of the quickselect counts at once.
PARTS = 16

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[48:58] = _WORD_BYTE[97:123] = _WORD_BYTE[128:] = True


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of each word, the different words, and the place of each text's first word.

    A-Z count as a-z; a word is a run of 0-9, a-z and characters beyond U+007F.
    """
    data, offsets = text_buffer(texts)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    inside = _WORD_BYTE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    places = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    whole = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[inside]))]
    )
    coded = whole.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary, np.searchsorted(starts, offsets)


def buckets_of(texts: pa.Array, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each run of 1 to `longest` words, and the number of the text that holds it."""
    ids, names, first = words_of(texts)
    names = names.to_pylist()
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found, owners = [], []
    # CRC of each different run so far, and which one starts at each place.
    sums, runs = np.array([zlib.crc32(w) for w in names], np.int64), ids.astype(np.int64)
    for n in range(1, longest + 1):
        size = max(0, len(ids) - n + 1)
        if n > 1:
            pair = runs[:size] * len(names) + ids[n - 1 :]
            different, runs = np.unique(pair, return_inverse=True)
            sums = np.array(
                [zlib.crc32(names[k % len(names)], zlib.crc32(b" ", int(sums[k // len(names)]))) for k in different.tolist()], np.int64
            )
        within = owner[:size] == owner[n - 1 :]
        found.append((sums[runs[:size]] % buckets)[within] if size else np.zeros(0, np.int64))
        owners.append(owner[:size][within])
    return np.concatenate(found), np.concatenate(owners)


def bucket_counts(df: DataFrame, text: str, longest: int, buckets: int) -> np.ndarray:
    """Runs of all texts by bucket; at most one row for each bucket and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in batches_of(batch):
                total += np.bincount(buckets_of(part.column("text"), longest, buckets)[0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "n"])

    rows = df.select(df[f"`{text}`"].alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of target over source share of each bucket, each count raised by one."""
    n, s, t = len(source), float(source.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(source.tolist(), target.tolist())],
        np.int64,
    )


def gumbel(key: Column, seed: int) -> Column:
    """Thousandths of the Gumbel number that the seed and the key fix; an unknown key counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    h = F.conv(F.left(digest, F.lit(8)), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weighted(df: DataFrame, gain: np.ndarray, key: str, text: str, longest: int) -> DataFrame:
    """`key`, `n_words`, `n_features` and `weight` of every row."""
    source = df.select(df[f"`{key}`"].alias("key"), df[f"`{text}`"].alias("text"))
    kind = source.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch):
                rows = part.num_rows
                found, owner = buckets_of(part.column("text"), longest, len(gain))
                n = np.bincount(owner, minlength=rows)
                # Sums of whole numbers, exact in doubles below 2^53.
                total = np.bincount(owner, weights=gain[found], minlength=rows).astype(np.int64)
                # From w words come w runs of one word; longer runs are told apart by their number.
                words = n if longest == 1 else np.diff(words_of(part.column("text"))[2])
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array(words), pa.array(n), pa.array(total // np.maximum(n, 1))],
                    ["key", "n_words", "n_features", "weight"],
                )

    return source.mapInArrow(run, f"key {kind}, n_words long, n_features long, weight long")


def _before(order: list[str], key: tuple, or_equal: bool) -> Column:
    """True for rows whose key in ascending order lies before a given one, or equals it."""
    result = F.lit(or_equal)
    for name, value in reversed(list(zip(order, key))):
        result = (F.col(name) < F.lit(value)) | ((F.col(name) == F.lit(value)) & result)
    return result


def kth(df: DataFrame, order: list[str], k: int, seed: int = 0, parts: int = PARTS) -> tuple | None:
    """The k-th smallest key of `df`, from 1, by quickselect; None where there are fewer rows.

    `order` names whole-number columns without NULL that together tell all rows apart. Each pass
    reads `df` once, splits the rows still in question at the pivots, and counts each part; rows
    that equal a pivot are a part of their own. The next pivots are drawn at random in every part
    during the same pass. A pass brings two rows for each pivot to the driver.
    """
    low, high, passed = None, None, 0
    pivots: list[tuple] = []
    turn = 0
    while True:
        live = F.lit(True)
        if low is not None:
            live = live & ~_before(order, low, or_equal=True)
        if high is not None:
            live = live & _before(order, high, or_equal=False)
        part = F.lit(2 * len(pivots))
        for i, pivot in reversed(list(enumerate(pivots))):
            part = F.when(_before(order, pivot, False), F.lit(2 * i)).when(_before(order, pivot, True), F.lit(2 * i + 1)).otherwise(part)
        key = F.struct(*order)
        draws = [
            F.min_by(key, F.struct(F.xxhash64(F.lit(seed), F.lit(turn), F.lit(j), *order), key)).alias(f"draw{j}") for j in range(parts - 1)
        ]
        rows = {r["part"]: r for r in df.where(live).groupBy(part.alias("part")).agg(F.count("*").alias("n"), *draws).collect()}
        turn += 1
        if not pivots and k - passed > sum(r["n"] for r in rows.values()):
            return None
        for i in range(2 * len(pivots) + 1):
            n = rows[i]["n"] if i in rows else 0
            if k - passed <= n:
                break
            passed += n
        if i % 2:
            return pivots[i // 2]
        if i > 0:
            low = pivots[i // 2 - 1]
        if i < 2 * len(pivots):
            high = pivots[i // 2]
        pivots = sorted({tuple(rows[i][f"draw{j}"]) for j in range(parts - 1)})


def ranked(df: DataFrame, order: list[str], path: str) -> DataFrame:
    """`df` with its `rank` by `order`, from 1.

    Rows are sorted in ranges and written; each range then counts from where the one before it
    ends. One number for each range comes to the driver.
    """
    spark = df.sparkSession
    at = F.monotonically_increasing_id()
    sorted_rows = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    held = written(sorted_rows.withColumn("at", at), path)
    part = F.shiftright("at", 33)
    sizes = held.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r["part"], total))
        total += r["n"]
    starts = F.broadcast(spark.createDataFrame(before, "part long, before long"))
    inner = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return held.withColumn("part", part).join(starts, "part").withColumn("rank", F.col("before") + inner + 1).drop("part", "before", "at")


def resampled(
    df: DataFrame, target: DataFrame, percent: int = 10, longest: int = 1, buckets: int = 10_000, seed: int = 2024,
    least_words: int = 20, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row of `df`: key, `n_features`, `weight`, `score` and `rank` (NULL if not drawn).

    Features are all runs of 1 to `longest` words, hashed to buckets. `percent` of the rows with
    at least `least_words` words are drawn, highest scores first, ties to smaller keys, an unknown
    key last; rows that agree in key and score are told apart by their place in the input. NULL,
    empty and wordless texts have no features and weight 0. Repeated rows count each. An empty
    target gives every bucket its smoothed share; an empty `df` gives no rows. Texts are read
    whole, a very long one in a batch of its own. Other columns, whatever their names, take no
    part. `key` must be a whole number, or be cast to one.
    """
    spark = df.sparkSession
    gain = gains(bucket_counts(df, text, longest, buckets), bucket_counts(target, text, longest, buckets))
    work = work_folder(spark)
    scores = weighted(df, gain, key, text, longest).withColumn("score", F.col("weight") + gumbel(F.col("key"), seed))
    # An order without NULL in which every row stands alone: minus score, key, place.
    scored = written(
        scores.select(
            "key", "n_features", "weight", "score", (F.col("n_words") >= least_words).alias("able"), (-F.col("score")).alias("less"),
            F.col("key").isNull().cast("int").alias("unknown"), F.coalesce(F.col("key").cast("long"), F.lit(0)).alias("id"),
            F.monotonically_increasing_id().alias("row"),
        ),
        f"{work}/scored",
    )
    order = ["less", "unknown", "id", "row"]
    able = scored.where("able")
    drawn = able.count() * percent // 100
    last = kth(able, order, drawn, seed) if drawn else None
    wins = F.col("able") & _before(order, last, or_equal=True) if last else F.lit(False)
    columns = [F.col("key").alias(key), "n_features", "weight", "score"]
    rest = scored.where(~wins).select(*columns, F.lit(None).cast("long").alias("rank"))
    if not last:
        return rest
    return ranked(scored.where(wins), order, f"{work}/ranked").select(*columns, "rank").unionByName(rest)
