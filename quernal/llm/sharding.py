"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows of equal text (null counts as empty) form a group, and a group stays in one shard unless it exceeds a shard's fair
share in some dimension; only then it is cut, by a hash of the row, into pieces of a quarter of that share at most.
Large groups are packed one by one, all others in bundles that a hash of the digest makes. So the driver packs a bounded
number of items (about BUNDLES + 3 * shards * FINE), whatever the input: largest first, each to the shard with the
highest dot product of the item with the residual capacity, among those it still fits.

Slots are gapless from 0 in each shard: rows are numbered in cells of a shard, which a hash fills evenly, and cells by
running sums of their counts. Last, items move between the fullest and the emptiest shard in bytes, where no shard's worst load rises by
it. Null ids are allowed. An empty table gives no rows; rows that repeat are rows of their own, and equal ones get slots in any order. Very long
texts are measured where they lie. Columns are found by position, so names that clash do no harm. Building the result runs the packing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernal.llm.common import materialize, packed

#: Bundles of small groups.
BUNDLES = 4096
#: A group is packed on its own from 1/FINE of a shard's fair share in any dimension.
FINE = 64
#: Rows of a cell, about; a cell is numbered by one task.
CELL_ROWS = 50_000

DIMS = ("size", "tokens", "n_rows")


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of items: its vector), by the dot-product rule."""
    total = items.sum(axis=0) if len(items) else np.ones(items.shape[1])
    need = items / np.where(total > 0, total / shards, 1)  # a shard's capacity is 1 in each dimension
    room, out = np.ones((shards, items.shape[1])), np.zeros(len(items), dtype="int64")
    for i in np.lexsort((np.arange(len(need)), -need.sum(axis=1), -need.max(axis=1))):
        fits = (room - need[i] >= -1e-9).all(axis=1)
        # Where it fits nowhere any more, it goes where the worst overflow stays least.
        score = np.where(fits, room @ need[i], -np.inf) if fits.any() else (room - need[i]).min(axis=1)
        out[i] = int(np.argmax(score))
        room[out[i]] -= need[i]
    return _levelled(need, out, shards) if len(items) else out


def _levelled(need: np.ndarray, at: np.ndarray, shards: int) -> np.ndarray:
    """at, with items moved from the fullest to the emptiest shard in bytes, while that brings their bytes closer and raises no shard's worst load."""
    load = np.stack([np.bincount(at, weights=w, minlength=shards) for w in need.T], axis=1)
    for _ in range(64 * shards):
        full, empty = int(load[:, 0].argmax()), int(load[:, 0].argmin())
        apart = load[full, 0] - load[empty, 0]
        mine = np.flatnonzero(at == full)
        mine = mine[(need[mine, 0] > 0) & (need[mine, 0] < apart) & (load[empty] + need[mine] <= load.max() + 1e-12).all(axis=1)]
        if not len(mine):
            break
        i = mine[np.abs(need[mine, 0] - apart / 2).argmin()]
        at[i] = empty
        load[full] -= need[i]
        load[empty] += need[i]
    return at


def measured(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, size, tokens, n_rows, crc): the narrow table that all the rest works on."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return packed(df, id=id_col, text=text_col).select(
        "id", F.unhex(F.md5(text)).alias("digest"), (F.octet_length(text) + F.lit(1).cast("long")).alias("size"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"), F.lit(1).cast("long").alias("n_rows"), F.crc32(text).alias("crc"),
    )


def shard(df: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, digest, size, tokens, crc, shard, slot. Null ids are allowed and rank first."""
    spark = df.sparkSession
    rows = materialize(measured(df, id_col, text_col), "measured")
    total = [float(x or 0) for x in rows.agg(*(F.sum(d) for d in DIMS)).first()]
    share = [max(t / shards, 1.0) for t in total]
    groups = rows.groupBy("digest").agg(*(F.sum(d).alias(d) for d in DIMS))
    bundle = F.pmod(F.xxhash64("digest"), F.lit(BUNDLES))
    load = F.greatest(*(F.col(d) / F.lit(s) for d, s in zip(DIMS, share, strict=True)))
    groups = materialize(groups.withColumns({"load": load, "bundle": bundle}), "groups")

    large = groups.where(F.col("load") >= 1 / FINE).orderBy("digest").collect()  # each has 1/(shards * FINE) of a total: 3 * shards * FINE at most
    small = groups.where(F.col("load") < 1 / FINE).groupBy("bundle").agg(*(F.sum(d).alias(d) for d in DIMS)).orderBy("bundle").collect()  # BUNDLES at most
    pieces = {bytes(x.digest): 1 if x.load <= 1 else int(np.ceil(4 * x.load)) for x in large}
    whole = spark.createDataFrame(list(pieces.items()), "digest binary, pieces int")
    piece = F.pmod(F.xxhash64("id", "digest", F.lit(7)), F.col("pieces")).cast("int")
    keys = [(bytes(x.digest), 0) for x in large if pieces[bytes(x.digest)] == 1]
    vectors = [[x[d] for d in DIMS] for x in large if pieces[bytes(x.digest)] == 1]
    if max(pieces.values(), default=1) > 1:
        # What a hash deals to the pieces is counted, not assumed to be equal; 12 * shards pieces at most, about.
        cuts = rows.join(F.broadcast(whole.where("pieces > 1")), "digest").withColumn("piece", piece)
        for x in cuts.groupBy("digest", "piece").agg(*(F.sum(d).alias(d) for d in DIMS)).orderBy("digest", "piece").collect():
            keys.append((bytes(x.digest), x.piece))
            vectors.append([x[d] for d in DIMS])
    vectors += [[x[d] for d in DIMS] for x in small]
    at = pack(np.array(vectors, dtype="float64").reshape(-1, len(DIMS)), shards).tolist()
    of_large = spark.createDataFrame([(*k, s) for k, s in zip(keys, at, strict=False)], "digest binary, piece int, large_shard int")
    of_small = spark.createDataFrame([(x.bundle, s) for x, s in zip(small, at[len(keys) :], strict=True)], "bundle long, small_shard int")

    # Both tables that are broadcast have a bounded number of rows, as above.
    cut = rows.join(F.broadcast(whole), "digest", "left").withColumns({"piece": piece, "bundle": bundle})
    placed = cut.join(F.broadcast(of_large), ["digest", "piece"], "left").join(F.broadcast(of_small), "bundle", "left")
    placed = placed.select("id", "digest", "size", "tokens", "crc", F.coalesce("large_shard", "small_shard").alias("shard"))
    return numbered(placed, max(64, round(total[-1] / shards / CELL_ROWS)))


def numbered(placed: DataFrame, cells: int) -> DataFrame:
    """placed with slot, 0 to the shard's rows less one."""
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("id", "digest"), F.lit(cells)))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "cell").count().select("shard", "cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("id", "digest"))
    return placed.withColumn("rank", rank).join(starts, ["shard", "cell"]).withColumn("slot", F.col("start") + F.col("rank") - 1).drop("cell", "start", "rank")
