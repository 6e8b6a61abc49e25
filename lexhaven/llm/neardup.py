"""Near duplicates by an inverted join on MinHash signature coordinates.

Every different shingle set gets a signature of `COORDINATES` minima and is posted under each
pair of coordinate and value. Two sets as alike as asked agree in at least `MATCHES` coordinates
(but for a chance below one in a hundred thousand at the limit itself, less above it). Values
that one set alone has cannot match and are skipped; sets left with too few are done. Of what
is left each set keeps its rarest values, as many as suffice for two sets that match often
enough to meet under one of them (prefix), so frequent values are skipped wherever rarer ones do.

Under a value, sets are compared with a few leaders and not all with all. What then is still in
different groups under one value is compared in blocks of bounded size. Pairs whose coordinates
collide often enough are confirmed on the full sets, within the block; a block gives only links
that join two of its groups, so neither pairs nor large groups leave a task whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexhaven.llm.common import batches_of, mix, shingles, signed, words_of, work_folder, written

COORDINATES = 64
MATCHES = 36
# Leaders are asked for again while they link one in so many sets.
LEADER_ROUNDS, LEADER_YIELD = 4, 10
# Shingles of one value's sets that meet in a task at a time, twice; a larger set stands alone.
BLOCK_SHINGLES = 1 << 18
# A set or group on more than one in so many rows is sent to all tasks; there are fewer than that.
HOT_SHARE = 256

_MULTIPLY = (mix(np.arange(COORDINATES, dtype=np.uint64) + np.uint64(10_007)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_FLIP = (mix(np.arange(COORDINATES, dtype=np.uint64) + np.uint64(97_007)) >> np.uint64(32)).astype(np.uint32)


def signatures(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Rows of minima, one for each text that has shingles (`places` without empty texts)."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(places) - 1, COORDINATES), np.uint32)
    if len(out):
        for k in range(COORDINATES):
            moved = (short ^ _FLIP[k]) * _MULTIPLY[k]
            moved ^= moved >> np.uint32(15)
            moved *= np.uint32(0x2C1B3C6D)
            out[:, k] = np.minimum.reduceat(moved, places[:-1])
    return out


def _sketched(width: int, whole: bool):
    """Batches of `(key, text)` to sketches, with the sorted shingle hashes if `whole`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batches_of(batch):
                values, places = shingles(*words_of(part.column("text")), width)
                sets = [np.unique(values[a:b]) for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
                one = [int(np.bitwise_xor.reduce(own)) if len(own) else 0 for own in sets]
                two = [int(np.add.reduce(mix(own))) if len(own) else 0 for own in sets]
                some = np.diff(places) > 0
                rows = signatures(values, np.concatenate([places[:-1][some], places[-1:]]))
                offsets = np.concatenate([[0], np.cumsum(np.where(some, COORDINATES, 0))]).astype(np.int32)
                columns = {
                    "key": part.column("key"), "n": pa.array([len(own) for own in sets], pa.int64()),
                    "one": pa.array(signed(np.array(one, np.uint64))), "two": pa.array(signed(np.array(two, np.uint64))),
                    "signature": pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1).view(np.int32))),
                }
                if whole:
                    bounds = np.concatenate([[0], np.cumsum([len(own) for own in sets])]).astype(np.int32)
                    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                    columns["shingles"] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(signed(flat)))
                yield pa.RecordBatch.from_pydict(columns)
        # The worker stays, and idles beside the next stages.
        pa.default_memory_pool().release_unused()

    return run


_SKETCH = "key long, n long, one long, two long, signature array<int>"


def sketch(df: DataFrame, width: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Per text: key, set size, two hashes of the set, and the signature (empty for an empty set)."""
    return df.select(df[key].cast("long").alias("key"), df[text].alias("text")).mapInArrow(_sketched(width, False), _SKETCH)


def shingle_sets(df: DataFrame, width: int) -> DataFrame:
    """Sketches and sorted shingle hashes of texts given as `(key, text)`."""
    return df.select("key", "text").mapInArrow(_sketched(width, True), _SKETCH + ", shingles array<long>")


def postings(sketches: DataFrame, matches: int) -> DataFrame:
    """`(key, tokens)`: the rarest shared values of each set, enough for any two that match."""
    tokens = sketches.select(
        "key", F.posexplode("signature").alias("place", "value")
    ).select("key", (F.shiftleft(F.col("place").cast("long"), 32) + F.col("value").cast("long")).alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    # At most COORDINATES values of a set.
    own = tokens.join(shared, "token").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("own"))
    prefix = F.slice("own", 1, F.size("own") - matches + 1)
    return own.where(F.size("own") >= matches).select("key", F.transform(prefix, lambda p: p["token"]).alias("tokens"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """Pairs `(a, b)` with enough colliding coordinates whose full sets are as alike as asked."""
    a = sets.select(F.col("key").alias("a"), F.col("shingles").alias("of_a"), F.col("signature").alias("by_a"))
    b = sets.select(F.col("key").alias("b"), F.col("shingles").alias("of_b"), F.col("signature").alias("by_b"))
    collide = F.size(F.filter(F.zip_with("by_a", "by_b", lambda x, y: x == y), lambda same: same))
    both = F.size(F.array_intersect("of_a", "of_b"))
    return (
        pairs.join(a, "a").join(b, "b")
        .where(100 * F.least(F.size("of_a"), F.size("of_b")) >= percent * F.greatest(F.size("of_a"), F.size("of_b")))
        .where(collide >= matches)
        .select("a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b")).alias("sum"))
        .where(100 * F.col("both") >= percent * (F.col("sum") - F.col("both")))
        .select("a", "b")
    )


def hot_join(rows: DataFrame, other: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """Left join in which the keys of `hot`, fewer than `HOT_SHARE` and all in `other`, are sent to all tasks.

    `other` has a key once. No task meets all rows of a hot key.
    """
    known = rows.join(F.broadcast(other.join(F.broadcast(hot), on, "left_semi")), on)
    return known.unionByName(rows.join(F.broadcast(hot), on, "left_anti").join(other, on, "left"))


def components(nodes: DataFrame, links: DataFrame, work: str) -> DataFrame:
    """`(key, component)`: the smallest key reachable over links, by minima of neighbours and jumps.

    Each round is a written table, and so survives lost executors.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = written(both, f"{work}/links")
    label = nodes.select("key", F.col("key").alias("component"))
    for step in range(64):
        near = (
            both.join(label.select(F.col("key").alias("b"), F.col("component").alias("other")), "b")
            .groupBy(F.col("a").alias("key")).agg(F.min("other").alias("other"))
        )
        lower = label.join(near, "key", "left").select(
            "key", "component", F.least("component", F.coalesce("other", "component")).alias("lower")
        )
        lower = written(lower, f"{work}/lower{step}")
        jump = lower.select(F.col("key").alias("lower"), F.col("lower").alias("lowest"))
        # Few keys move; the others keep their own.
        moved = lower.where("lower <> key").join(jump, "lower").select("key", "component", "lowest")
        still = lower.where("lower = key").select("key", "component", F.col("lower").alias("lowest"))
        after = written(moved.union(still), f"{work}/label{step}")
        label = after.select("key", F.col("lowest").alias("component"))
        if after.where("component <> lowest").isEmpty():
            return label
    raise RuntimeError("links form a chain too long for 64 rounds")


def _linking(percent: int, matches: int):
    """Links between groups of one block's sets and the probes sent to it, each joining two groups."""

    def run(rows: pa.Table) -> pa.Table:
        probe, keys, groups = (rows.column(n).to_numpy() for n in ("probe", "key", "component"))
        links, groups = [], groups.copy()
        if probe.any() and not probe.all():
            lists = rows.column("shingles").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            places = np.concatenate([[0], np.cumsum(sizes)])
            # Shingles as small numbers, so that a probe's are looked up in a table of flags.
            values, small = np.unique(lists.flatten().to_numpy(), return_inverse=True)
            signature = rows.column("signature").combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
            shelf = np.flatnonzero(~probe)
            shelf = shelf[np.argsort(sizes[shelf], kind="stable")]
            shelf_sizes = sizes[shelf]
            flags = np.zeros(len(values), bool)
            for i in np.flatnonzero(probe).tolist():
                low = np.searchsorted(shelf_sizes, -(-percent * sizes[i] // 100))
                high = np.searchsorted(shelf_sizes, 100 * sizes[i] // percent, "right")
                near = shelf[low:high]
                near = near[groups[near] != groups[i]]
                near = near[(signature[near] == signature[i]).sum(axis=1) >= matches]
                own = small[places[i] : places[i + 1]]
                flags[own] = True
                for j in near.tolist():
                    if groups[j] == groups[i]:
                        continue
                    both = int(np.count_nonzero(flags[small[places[j] : places[j + 1]]]))
                    if 100 * both >= percent * (int(sizes[i]) + int(sizes[j]) - both):
                        links.append((min(keys[i], keys[j]), max(keys[i], keys[j])))
                        groups[groups == groups[j]] = groups[i]
                flags[own] = False
        found = np.array(links, np.int64).reshape(-1, 2)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return run


def _rest(posted: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """Links between groups that still meet under one value, found block by block.

    `posted` has `(token, key, component)`, `sets` `(key, n, signature, shingles)`. The largest
    group under a value is not compared with itself: probes are the others, sent to every block
    of the value.
    """
    sized = posted.join(sets.select("key", "n"), "key")
    by_group = sized.groupBy("token", "component").agg(F.count("*").alias("sets"), F.sum("n").alias("n"))
    main = by_group.groupBy("token").agg(
        F.sum("sets").alias("sets"), F.count("*").alias("groups"), F.sum("n").alias("all"), F.max("n").alias("most"),
        F.max_by("component", F.struct("n", "component")).alias("main"),
    ).where("groups > 1 and sets > 2")  # a leader was compared with the other of two
    blocks = F.ceil(F.col("all") / BLOCK_SHINGLES).cast("int")
    probes = F.ceil((F.col("all") - F.col("most")) / BLOCK_SHINGLES).cast("int")
    dealt = posted.join(main, "token").select(
        "token", "key", "component", blocks.alias("blocks"), probes.alias("probes"), (F.col("component") != F.col("main")).alias("outside")
    )
    at = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    probe_at = F.pmod(F.xxhash64("key", F.lit(1)), F.col("probes")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = ("token", "key", "component")
    shelf = dealt.select(*own, F.lit(False).alias("probe"), at.alias("block"), F.explode(every("probes")).alias("part"))
    sent = dealt.where("outside").select(*own, F.lit(True).alias("probe"), F.explode(every("blocks")).alias("block"), probe_at.alias("part"))
    rows = shelf.union(sent).join(sets.select("key", "signature", "shingles"), "key")
    return rows.groupBy("token", "block", "part").applyInArrow(_linking(percent, matches), "a long, b long").distinct()


def near_duplicates(
    df: DataFrame, width: int = 5, percent: int = 80, text: str = "text", key: str = "doc_id",
    matches: int = MATCHES,
) -> DataFrame:
    """Per row: key, n_shingles, component_id (the smallest key reachable over links).

    Words are taken without regard to the case of A-Z. A text with fewer words than `width` has
    its sequence as one shingle; NULL, empty and blank texts have none and are linked with
    nothing. Repeated texts are alike. Keys are whole numbers; rows that repeat a key are one
    document, whose links are those of all its texts; its rows without shingles stand alone.
    Rows with a NULL key stand alone with a NULL component. Other columns take no part. An empty
    table gives no rows.
    """
    spark = df.sparkSession
    work = work_folder(spark)
    all_rows = written(sketch(df, width, text, key), f"{work}/sketches")
    filled = all_rows.where("n > 0 and key is not null")
    same = ["one", "two", "n"]
    # A number for each different set, fixed by writing it down; all its rows have one signature.
    leads = filled.groupBy(*same).agg(F.min("key").alias("lead"), F.count("*").alias("copies"), F.first("signature").alias("signature"))
    different = written(leads.withColumn("key", F.monotonically_increasing_id()), f"{work}/different")
    hot = different.where(F.col("copies") * HOT_SHARE > all_rows.count()).select(*same)
    posts = written(postings(different, matches), f"{work}/postings")
    posted = posts.select("key", F.explode("tokens").alias("token"))
    chosen = different.join(posts.select("key"), "key", "left_semi").select(*same, "lead", F.col("key").alias("id"))
    texts = df.select(df[key].cast("long").alias("key"), df[text].alias("text")).where("text is not null")
    picked = texts.join(chosen.select(F.col("lead").alias("key")).distinct(), "key", "left_semi")
    # A key's rows may have several sets; the hashes tell which of them were chosen.
    drawn = shingle_sets(picked, width).withColumnRenamed("key", "lead").dropDuplicates(["lead", *same])
    sets = written(drawn.join(chosen, ["lead", *same]).select(F.col("id").alias("key"), "n", "signature", "shingles"), f"{work}/sets")
    # Texts under one key are linked.
    several = filled.groupBy("key").agg(F.min(F.struct(*same)).alias("low"), F.max(F.struct(*same)).alias("high")).where("low <> high")
    numbers = different.select(*same, F.col("key").alias("id"))
    of_several = hot_join(filled.join(several.select("key"), "key", "left_semi").select("key", *same).distinct(), numbers, same, hot)
    of_several = written(of_several.select("key", "id"), f"{work}/several")
    low = of_several.groupBy("key").agg(F.min("id").alias("a"))
    links = of_several.join(low, "key").where("a <> id").select("a", F.col("id").alias("b")).distinct()
    links = written(links, f"{work}/own")
    nodes = posts.select("key").union(of_several.select(F.col("id").alias("key"))).distinct()
    label = nodes.select("key", F.col("key").alias("component"))
    if not links.isEmpty():
        label = components(nodes, links, f"{work}/start")
    tested = None
    for step in range(LEADER_ROUNDS):
        # The leader of a value is another one each round; those in its group already need no test.
        with_label = posted.join(label, "key")
        order = F.xxhash64("key", F.lit(step)) if step else F.col("key")
        leader = with_label.groupBy("token").agg(
            F.min(F.struct(order.alias("o"), "key", "component")).alias("leader"),
            F.min("component").alias("low"), F.max("component").alias("high"),
        ).where("low <> high").select("token", F.col("leader.key").alias("leader"), F.col("leader.component").alias("of"))
        asked = with_label.join(leader, "token").where("component <> of").select(
            F.least("key", "leader").alias("a"), F.greatest("key", "leader").alias("b")
        ).distinct()
        asked = asked if tested is None else asked.join(tested, ["a", "b"], "left_anti")
        asked = written(asked, f"{work}/asked{step}")
        found = written(_confirmed(asked, sets, percent, matches), f"{work}/found{step}")
        tested = asked if tested is None else tested.union(asked)
        linked = found.count()
        if linked:
            links = links.union(found)
            label = components(nodes, links, f"{work}/round{step}")
        if linked * LEADER_YIELD < asked.count():
            break
    found = written(_rest(posted.join(label, "key"), sets, percent, matches), f"{work}/rest")
    if not found.isEmpty():
        label = components(nodes, links.union(found), f"{work}/last")
    # The smallest document of each group of sets, then of each set, then of each row.
    placed = written(label.join(different.select("key", "lead"), "key"), f"{work}/placed")
    least = placed.groupBy("component").agg(F.min("lead").alias("least"), F.count("*").alias("many"))
    large = least.where(F.col("many") * HOT_SHARE > placed.count()).select("component")
    by_set = hot_join(placed.select("key", "component"), least.select("component", "least"), ["component"], large)
    answer = different.select(*same, "lead", "key").join(by_set.select("key", "least"), "key", "left").select(
        *same, F.coalesce("least", "lead").alias("component")
    )
    linked_rows = hot_join(filled.select("key", *same), written(answer, f"{work}/answer"), same, hot).select("key", "n", "component")
    alone = all_rows.where("n = 0 or key is null").select("key", "n", F.col("key").alias("component"))
    return linked_rows.union(alone).select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")
    )


def kept(component: str = "component_id", key: str = "doc_id") -> Column:
    """True for the row that stays of each group."""
    return F.coalesce(F.col(key) == F.col(component), F.lit(True))
