"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries find the digests that may hold more than 1/(k+1) of the rows. Their groups are then counted
exactly, and the winners (k rows at most) are broadcast, so copies of a frequent text are settled map-side. All other
digests go through an ordinary shuffle, of digests and ids only.

Two texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts the row with
the largest id stays; null ids rank lowest and equal each other. Rows that repeat both id and text are all marked kept
by annotate(), and collapse to one of them in deduplicate(). An empty table gives an empty result. Very long texts are hashed where
they lie. Other columns, of whatever name, pass through deduplicate() unchanged. Building a result runs the jobs up to the digests' groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernal.llm.common import BROADCAST_ROWS, lower_ascii, materialize, packed, release, small_enough, tidied

#: Counters of a Misra-Gries summary: every digest with more than 1/(COUNTERS + 1) of the rows is found.
COUNTERS = 256
#: Tasks of the first merge of summaries.
FAN_IN = 32


def _reduced(counts: pd.Series, k: int) -> pd.Series:
    """The Misra-Gries step for a batch: subtract the (k+1)th largest count from all, and keep what is above 0."""
    if len(counts) <= k:
        return counts
    counts = counts.sort_values(ascending=False)
    counts = counts - counts.iloc[k]
    return counts[counts > 0]


@tidied
def summary(batches: Iterator[pd.DataFrame], k: int = COUNTERS) -> Iterator[pd.DataFrame]:
    """One summary (digest, n) of at most k rows for all batches of a partition; n may be a weight or absent."""
    held = pd.Series(dtype="int64")
    for x in batches:
        n = x.groupby("digest")["n"].sum() if "n" in x else x["digest"].value_counts()
        held = _reduced(held.add(n, fill_value=0).astype("int64"), k)
    yield pd.DataFrame({"digest": pd.Series(held.index, dtype=object), "n": held.to_numpy("int64")})


def frequent(digests: DataFrame, k: int = COUNTERS) -> DataFrame:
    """(digest, n): candidates for frequent digests, k at most; n is at most the true count.

    Summaries are made per partition, merged in FAN_IN tasks, then in one task of FAN_IN * k rows at most.
    """
    schema, merge = "digest binary, n long", lambda it: summary(it, k)
    parts = digests.select("digest").mapInPandas(merge, schema)
    return parts.repartition(FAN_IN).mapInPandas(merge, schema).repartition(1).mapInPandas(merge, schema)


def digested(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, digest, n_bytes) of df: SHA-256 and length of the normalised text."""
    rows = packed(df, id=id_col, text=text_col)
    norm = lower_ascii(F.col("text"))
    return rows.select("row", "id", F.unhex(F.sha2(norm, 256)).alias("digest"), F.octet_length(norm).alias("n_bytes"))


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest", "n_bytes").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))


def _split(digests: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Verified winners of frequent digests (k rows at most), and the groups of all other digests."""
    spark = digests.sparkSession
    found = [(bytes(x.digest),) for x in frequent(digests, k).collect()]  # k at most
    candidates = F.broadcast(spark.createDataFrame(found, "digest binary"))
    heavy = _groups(digests.join(candidates, "digest"))
    winners = spark.createDataFrame([tuple(x) for x in heavy.collect()], heavy.schema)  # as many
    return winners, _groups(digests.join(candidates, "digest", "left_anti"))


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """One row per row of df: id, digest (binary), n_bytes, keep_id, group_size, kept."""
    digests = materialize(digested(df, id_col, text_col).drop("row"), "digests")
    winners, others = _split(digests, k)
    marked = digests.join(F.broadcast(winners), ["digest", "n_bytes"], "left")
    rest = marked.where("group_size is null").select(*digests.columns).join(others, ["digest", "n_bytes"])
    both = marked.where("group_size is not null").unionByName(rest)
    return both.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """df's rows that stay, with all their columns.

    What goes is found among digests and ids; the rows then decide where they lie, by a broadcast of the pairs of id and digest that
    go, if they are BROADCAST_ROWS at most, else by a join. Of rows that repeat id and text, the one of the least JSON text stays.
    """
    digests = materialize(digested(df, id_col, text_col).drop("row"), "digests")
    winners, others = _split(digests, k)
    pairs = digests.groupBy("id", "digest", "n_bytes").count()
    marked = pairs.join(F.broadcast(winners), ["digest", "n_bytes"], "left")
    rest = marked.where("group_size is null").select(*pairs.columns).join(others, ["digest", "n_bytes"])
    both = marked.where("group_size is not null").unionByName(rest)
    stays = F.col("id").eqNullSafe(F.col("keep_id"))
    found = both.where(~stays | (F.col("count") > 1)).select(F.col("id").alias("id2"), F.col("digest").alias("digest2"), stays.alias("twice"))
    found = materialize(found, "found")
    release(digests)
    if small_enough(found, BROADCAST_ROWS):
        found = F.broadcast(found)
    rows = digested(df, id_col, text_col).drop("n_bytes")
    rows = rows.join(found, F.col("id").eqNullSafe(F.col("id2")) & (F.col("digest") == F.col("digest2")), "left")
    out = rows.where("twice is null").select("row")
    if found.where("twice").limit(1).count():
        again = rows.where("twice").groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
        out = out.unionByName(again.select("row"))
    return out.select("row.*")
