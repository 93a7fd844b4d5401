"""Mixing sources to target weights by capped water-filling; DataFrame operations only.

Sources by code point, null last, weigh WEIGHTS in turn, and share all words by weight. No target exceeds CAP times its
source's words: sources above are clamped there, and the excess is reshared by weight until none is above. That is one
water level: a target is the smaller of its cap and level * weight. The level is found by clamping and resharing: each round is one
sum over the sources, and rounds grow with the logarithm of their number (Newton's steps on a concave function).

A document is repeated floor(target / source words) times. In the seeded order of its source, documents get one
repetition more while their running size stays within the rest of the target; what that leaves, less than one document,
is filled in the same way from small ones that have none yet. The order is that of a hash of seed and id, then of id and size. So each of
the two prefixes is told by the document where it ends, its edge, and every other row decides for itself: no row is moved, texts least of all.
An edge is found by descent: words are summed up over 2^DIGIT ranges of the hash, the range where the prefix ends is cut into
as many again, and so on until at most FEW rows are left in it. Rows that agree with an edge in id and size are numbered, as only some of them count.

Null and empty texts have size 0. Sources without words get target 0, and their documents no repetition. Rows that repeat an
id are documents of their own. An empty table gives no rows. Reruns agree: all depends on ids, sizes and seed only, and for equal ids and sizes in
repeat() on the rows' contents. Very long texts are counted where they lie. Columns are found by position, so names that clash do no harm.
Building a result runs the jobs up to the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernal.llm.common import materialize, packed, release, small_enough

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
SEED = "mix-1"
#: A table of sources up to so many rows is broadcast; a larger one is joined by a salted key.
BROADCAST_ROWS = 100_000
SALTS = 64
#: Bits of the hash, bits that a step of the descent takes, and rows that may be left in a range.
KEY_BITS, DIGIT, FEW = 60, 8, 1000
#: What the first prefix leaves of a target is filled from documents of at most 1/SMALL of that.
SMALL = 4

ORDER = ("key", "id", "size")


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def order_key(doc_id: Column, seed: str) -> Column:
    """60 bits of MD5 of seed and id, as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def _ranked(by_source: DataFrame) -> DataFrame:
    """by_source with place, from 0 by code point, null last: numbers within the parts of a sort, and the parts' offsets."""
    parts = materialize(by_source.orderBy(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranked")
    offsets, before = [], 0
    for x in parts.groupBy("part").count().orderBy("part").collect():  # one row per partition of the sort
        offsets.append((x["part"], before))
        before += x["count"]
    offsets = by_source.sparkSession.createDataFrame(offsets, "part int, before long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return parts.withColumn("rank", rank).join(F.broadcast(offsets), "part").withColumn("place", F.col("before") + F.col("rank") - 1).drop("part", "rank", "before")


def targets(by_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) with target. No task holds all sources."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    x = _ranked(by_source).select("source", "source_size", weight.alias("weight"), (F.col("source_size") * cap).alias("cap"))
    x = materialize(x, "weights")
    total, weight_left = x.agg(F.sum("source_size"), F.sum("weight")).first()
    words_left = total
    while weight_left:
        over = F.col("weight") * F.lit(float(words_left)) > F.col("cap") * F.lit(weight_left)
        clamped, left = x.agg(F.sum(F.when(over, F.col("cap")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if (total - clamped, left) == (words_left, weight_left):
            share = F.col("weight") * F.lit(float(words_left)) / F.lit(weight_left)
            return x.select("source", "source_size", F.when(over, F.col("cap").cast("double")).otherwise(share).alias("target"))
        words_left, weight_left = total - clamped, left
    return x.select("source", "source_size", F.col("cap").cast("double").alias("target"))


def _with_sources(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (source, key, ...) with the columns of a written table that has one row per source, called `of` there."""
    same = F.col("source").eqNullSafe(F.col("of"))
    if small_enough(table, BROADCAST_ROWS):
        return rows.join(F.broadcast(table), same)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, same & (F.pmod("key", F.lit(SALTS)).cast("int") == F.col("salt"))).drop("salt")


def _edges(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(of, edge, taken, words): where the prefix of each source ends, the first (key, id, size) beyond its budget.

    rows: (source, key, id, size), budgets: (of, budget), written. taken: how many rows equal to the edge are within, words: those of
    the whole prefix. Sources whose rows are all within have no edge.
    """
    at = budgets.select("of", "budget", F.lit(0).cast("long").alias("begins"))
    shift, scratch = KEY_BITS, []
    while True:
        shift = max(0, shift - DIGIT)
        known = _with_sources(rows.select("source", *ORDER), at)
        cells = known.groupBy("of", "budget", "begins", F.shiftright("key", shift).alias("cell")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        ends = F.col("begins") + F.sum("words").over(Window.partitionBy("of").orderBy("cell"))  # 2^DIGIT cells of a source at most
        cells = cells.withColumn("ends", ends).where("ends > budget").groupBy("of", "budget")
        cells = cells.agg(F.min(F.struct("cell", (F.col("ends") - F.col("words")).alias("begins"), "n")).alias("x"))
        at = materialize(cells.select("of", "budget", "x.*"), "range")
        rows = _with_sources(rows.select("source", *ORDER), at).where(F.shiftright("key", shift) == F.col("cell"))
        rows = materialize(rows.select("source", *ORDER), "inside")
        scratch += [at, rows]
        if not shift or (at.agg(F.max("n")).first()[0] or 0) <= FEW:
            break
    alike = _with_sources(rows, at).groupBy("of", "budget", "begins", *ORDER).count()
    ends = F.col("begins") + F.sum(F.col("size") * F.col("count")).over(Window.partitionBy("of").orderBy(*ORDER))
    beyond = alike.withColumn("ends", ends).where("ends > budget")
    first = beyond.groupBy("of", "budget").agg(F.min(F.struct(F.struct(*ORDER).alias("edge"), (F.col("ends") - F.col("size") * F.col("count")).alias("begins"))).alias("x"))
    first = first.select("of", "budget", "x.*")
    taken = F.floor((F.col("budget") - F.col("begins")) / F.col("edge.size")).cast("long")
    # The quotient may be rounded over a whole number.
    taken = F.when(F.col("begins") + taken * F.col("edge.size") > F.col("budget"), taken - 1).otherwise(taken)
    first = materialize(first.withColumn("taken", taken).select("of", "edge", "taken", (F.col("begins") + F.col("taken") * F.col("edge.size")).alias("words")), "edges")
    for x in scratch:
        release(x)
    return first


def plan(rows: DataFrame, weights: tuple[float, ...], cap: int) -> DataFrame:
    """One row per source of rows (source, key, id, size): (of, source_size, target, whole, small, edge1, taken1, edge2, taken2)."""
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = sources.withColumn("whole", F.floor(ratio)).withColumn("extra", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = materialize(sources.withColumnRenamed("source", "of"), "sources")
    first = _edges(rows, sources.select("of", F.col("extra").alias("budget")))
    missed = F.col("extra") - F.col("words")
    same = sources["of"].eqNullSafe(first["of"])
    second = sources.join(first, same).select(sources["of"], "edge", "taken", missed.alias("missed"), (missed / SMALL).alias("small"))
    # The rows that equal the first edge and are within come first here too, so the budget provides for them.
    again = F.when(F.col("edge.size") <= F.col("small"), F.col("taken") * F.col("edge.size")).otherwise(0)
    second = materialize(second.withColumn("again", again), "second")
    may = _with_sources(rows, second).where((F.struct(*ORDER) >= F.col("edge")) & (F.col("size") <= F.col("small")))
    ends = _edges(may.select("source", *ORDER), second.select("of", (F.col("missed") + F.col("again")).alias("budget")))
    x, y = second.alias("x"), ends.alias("y")
    taken = F.col("y.taken") - F.when(F.col("x.edge") == F.col("y.edge"), F.col("x.taken")).otherwise(0)
    both = x.join(y, F.col("x.of").eqNullSafe(F.col("y.of")), "left")
    both = both.select(F.col("x.of").alias("of2"), "small", F.col("x.edge").alias("edge1"), F.col("x.taken").alias("taken1"), F.col("y.edge").alias("edge2"), taken.alias("taken2"))
    out = sources.drop("extra").join(both, F.col("of").eqNullSafe(F.col("of2")), "left").drop("of2")
    return materialize(out, "plan")


def _decided(rows: DataFrame, by_source: DataFrame, tie: Column | None = None) -> DataFrame:
    """rows (source, key, id, size, ...) with source_size, target and copies. tie orders rows that equal an edge."""
    known = _with_sources(rows, by_source)
    place = F.struct(*ORDER)
    number = {k: (place == F.col(f"edge{k}")) & (F.col(f"taken{k}") > 0) for k in (1, 2)}
    tied = F.coalesce(number[1], F.lit(False)) | F.coalesce(number[2], F.lit(False))

    def within(number: Column) -> DataFrame:
        one = F.col("edge1").isNull() | (place < F.col("edge1")) | ((place == F.col("edge1")) & (number <= F.col("taken1")))
        rest = number - F.when(place == F.col("edge1"), F.col("taken1")).otherwise(0)
        two = F.col("edge2").isNull() | (place < F.col("edge2")) | ((place == F.col("edge2")) & (rest <= F.col("taken2")))
        more = one | ((F.col("size") <= F.col("small")) & two)
        return F.when(F.col("source_size") > 0, F.col("whole") + F.coalesce(more, F.lit(False)).cast("long")).otherwise(F.lit(0)).cast("long")

    hidden = ("of", "whole", "small", "edge1", "taken1", "edge2", "taken2")
    if by_source.where("taken1 > 0 or taken2 > 0").limit(1).count() == 0:
        return known.withColumn("copies", within(F.lit(2**62))).drop(*hidden)
    apart = known.where(~tied).withColumn("copies", within(F.lit(2**62)))
    order = Window.partitionBy("source", *ORDER).orderBy(F.lit(0) if tie is None else tie)
    numbered = known.where(tied).withColumn("number", F.row_number().over(order).cast("long"))
    return apart.unionByName(numbered.withColumn("copies", within(F.col("number"))).drop("number")).drop(*hidden)


def mix(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """rows: (id, source, size) or more columns, which go. Adds source_size, target, copies."""
    narrow = rows.select("id", "source", "size").withColumn("key", order_key(F.col("id"), seed))
    return _decided(narrow, plan(narrow, weights, cap)).select("id", "source", "size", "source_size", "target", "copies")


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size) of df, written: the texts are read once."""
    rows = packed(df, id=id_col, text=text_col, source=source_col)
    return materialize(rows.select("id", "source", n_words(F.col("text")).alias("size")), "sizes")


def repeat(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The mixture itself: df's rows, each as often as the mix takes it. Rows decide where they lie, by their source's edges."""
    measured = sizes(df, id_col, text_col, source_col)
    narrow = measured.withColumn("key", order_key(F.col("id"), seed))
    rows = packed(df, id=id_col, text=text_col, source=source_col).withColumns({"size": n_words(F.col("text")), "key": order_key(F.col("id"), seed)})
    mixed = _decided(rows.drop("text"), plan(narrow, weights, cap), F.to_json("row"))
    release(measured)
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
