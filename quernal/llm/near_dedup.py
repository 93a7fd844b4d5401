"""Near-duplicate texts by bottom-k sketches: one hash function, inverted lists, union-sketch estimates, exact checks.

A text's set are its distinct shingles of five words (ASCII white space splits, A-Z is lower-cased); with fewer words,
all of them as one shingle; without words, nothing, and it links with nothing. Sets are linked from a Jaccard similarity of 0.75.

1. Each text gives its set's size, a 128-bit hash of the set, and its bottom-k sketch (the SKETCH smallest hashes).
   Texts of equal sets form a class, and only its smallest id goes on: copies are settled without any pair.
2. Inverted lists hold the classes by retained values. Linked sets share any one of the least values of their union
   with probability 0.75 or more, so the LISTED least values miss a pair with probability 0.25^20. A class that retains
   values of more than COMMON classes (a passage that many share) is listed by a prefix instead: linked sketches share at
   least `allowed` values, so all but that many less one, in an order with common values last, by their counts, hold a shared one.
3. Star round: on each list, the most central member (with most common values) is compared with all others, as many as
   the list has entries. Groups of near copies join into components here.
4. Residual round: members of different components of a list are compared. On lists of COMMON members at most, their
   pairs go through the sketches. The members of longer lists are listed anew, by a prefix of their full sets: linked sets share at least
   0.75 of either, so a quarter of a set, in any order that is the same for all, holds a shared shingle. The order puts the HEAVY shingles that
   most of these texts hold last, so that a passage that many share makes no list where texts have a quarter of their own. What long
   lists remain are dealt out in blocks: members outside a list's largest component meet all, where they lie, and no pairs are
   returned but links that join components.
   After that no unseen pair can join two components.
5. A pair counts if the union sketch allows it (at least `allowed` of the union's least values in both; a true pair fails
   with probability under 1e-8) and the exact Jaccard similarity of the two full sets does. Full sets are made once a round, of the
   texts that pairs are left of, and travel as hashes; their texts are found by a broadcast of ids, if these are BROADCAST_ROWS at most.

Ids must be integers. Null ids form documents of their own that link with nothing (their set's size is reported);
rows that repeat an id count as one document, and if their texts differ, the one of the least (size, hash) of its set stands for it. Of
linked documents the smallest id stays. Empty tables give no rows; columns are found by position, so names that clash do no harm.
Very long texts are whole sets like any other. Building a result runs its jobs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernal.llm.common import BROADCAST_ROWS, materialize, packed, release, small_enough, tidied
from quernal.llm.components import components

WORDS = 5
#: A similarity as a ratio of integers, so that it is tested exactly.
SIMILARITY = (75, 100)
SKETCH, LISTED, COMMON = 48, 20, 32
#: Members and shingles of a block of a long list, at most about; shingles of a product of incidence matrices.
BLOCK_ROWS, BLOCK_SHINGLES, PRODUCT = 1024, 1_000_000, 2048
#: Pairs with one and the same first member that one task's group holds at most, about.
BLOCK = 64
#: Shingles that are known to be common when members of long lists are listed anew, at most; all others count as rare.
HEAVY = 200_000
#: Words whose hashes a task keeps at hand.
REMEMBERED = 200_000

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, hashes: dict, words: int = WORDS) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; bytes.lower and bytes.split know just ASCII."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    n, out = max(1, len(h) - words + 1), np.zeros(max(1, len(h) - words + 1), np.uint64)
    with np.errstate(over="ignore"):
        for i in range(min(words, len(h))):
            out = _mixed(out * _ODD[i % 5] + h[i : i + n] + np.uint64(i))
        # A text of fewer words is one shingle, unlike any shingle of full length.
        return np.unique(out) if len(h) >= words else _mixed(out + np.uint64(len(h)))


def _digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


@tidied
def _sketched(batches: Iterator[pa.RecordBatch], k: int, words: int) -> Iterator[pa.RecordBatch]:
    hashes = _WordHashes()
    for b in batches:
        sizes, digests, sketches = [], [], []
        for text in b.column("text"):
            s = shingle_set(text.as_py(), hashes, words)
            sizes.append(len(s))
            digests.append(_digest(s))
            sketches.append(s[:k].view(np.int64))
        lengths = np.cumsum([0] + [len(s) for s in sketches])
        flat = np.concatenate(sketches) if sketches else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(flat, pa.int64()))
        high, low = (pa.array([d[i] for d in digests], pa.int64()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes, pa.int64()), high, low, lists], ["id", "n", "h1", "h2", "sketch"])


@tidied
def _full_sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(id, set) of rows (id, text, h1, h2) whose set has that hash."""
    hashes = _WordHashes()
    for b in batches:
        ids, sets = [], []
        for i, text, *digest in zip(*(b.column(c) for c in ("id", "text", "h1", "h2")), strict=True):
            s = shingle_set(text.as_py(), hashes, words)
            if _digest(s) == tuple(x.as_py() for x in digest):
                ids.append(i.as_py())
                sets.append(s.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], ["id", "set"])


def _set(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


@tidied
def _exploded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for x in batches:
        for raw in x["set"]:
            yield pd.DataFrame({"value": _set(raw).view(np.int64)})


@tidied
def _prefixes(batches: Iterator[pd.DataFrame], heavy: np.ndarray, similarity: tuple[int, int]) -> Iterator[pd.DataFrame]:
    """(value, rep, n): of each set the values that any linked set shares one of; heavy values, given rarest first, come last."""
    num, den = similarity
    order = np.argsort(heavy)
    known = heavy[order]
    for x in batches:
        for rep, raw in zip(x["rep"], x["set"], strict=True):
            s = _set(raw)
            at = np.minimum(np.searchsorted(known, s), max(0, len(known) - 1))
            rank = np.where(known[at] == s, order[at] + 1, 0) if len(known) else np.zeros(len(s), np.int64)
            first = s[np.lexsort((s, rank))][: len(s) - -(-len(s) * num // den) + 1]
            yield pd.DataFrame({"value": first.view(np.int64), "rep": rep, "n": len(s)})


def allowed(k: int, of: float, miss: float = 1e-8) -> int:
    """The most m with P(Binomial(k, of) < m) <= miss."""
    p, m = 0.0, 0
    while (p := p + math.comb(k, m) * of**m * (1 - of) ** (k - m)) <= miss:
        m += 1
    return m


def _unsigned(x: Column) -> Column:
    """Sketches hold unsigned hashes as longs; this orders them as the hashes are."""
    return F.transform(x, lambda v: v.bitwiseXOR(F.lit(-(2**63))))


def _may_link(a: Column, b: Column, na: Column, nb: Column, k: int, similarity: tuple[int, int]) -> Column:
    """Whether sizes and union sketch allow a link."""
    num, den = similarity
    union = F.slice(F.array_sort(F.array_union(_unsigned(a), _unsigned(b))), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(_unsigned(a), _unsigned(b)), union))
    whole = (na <= k) & (nb <= k)  # the sketches are the sets
    exact = F.size(F.array_intersect(a, b)) * den >= F.size(F.array_union(a, b)) * num
    return F.when(whole, exact).otherwise(both >= F.lit(allowed(k, num / den)))


@tidied
def _verify(batches: Iterator[pd.DataFrame], similarity: tuple[int, int]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (a, block), the set of a first, then those of its partners b: the pairs that link."""
    key, first = None, np.empty(0, np.uint64)
    num, den = similarity
    for x in batches:
        out = []
        for a, block, role, b, raw in zip(x["a"], x["block"], x["role"], x["b"], x["set"], strict=True):
            s = _set(raw)
            if role == 0:
                key, first = (a, block), s
            elif key == (a, block):
                both = len(np.intersect1d(first, s, assume_unique=True))
                if both * den >= (len(first) + len(s) - both) * num:
                    out.append((a, b))
        yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The number of shingles that each set of left shares with each of right: products of incidence matrices, some shared shingles at a time."""
    out = np.zeros((len(left), len(right)), np.float32)
    if not left or not right:
        return out
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    places = [[_within(s, shared) for s in side] for side in (left, right)]
    for k in range(0, len(shared), PRODUCT):
        out += _incidence(places[0], k) @ _incidence(places[1], k).T
    return out


def _within(s: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Where values hold those of s that they hold; both are sorted."""
    at = np.searchsorted(values, s)
    at = at[at < len(values)]
    return at[values[at] == s[: len(at)]]


def _incidence(places: list[np.ndarray], start: int) -> np.ndarray:
    out = np.zeros((len(places), PRODUCT), np.float32)
    for i, at in enumerate(places):
        a, b = np.searchsorted(at, (start, start + PRODUCT))
        out[i, at[a:b] - start] = 1
    return out


@tidied
def _block_links(batches: Iterator[pd.DataFrame], similarity: tuple[int, int]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (value, one, two, role): links between members of the left block (role 0) and the right, that join components."""
    key, held = None, []
    num, den = similarity

    def compared() -> pd.DataFrame:
        sides = [[x for x in held if x[0] == role] for role in (0, 1)]
        sizes = [np.array([len(x[3]) for x in side], np.float64) for side in sides]
        shared = _overlaps(*([x[3] for x in side] for side in sides))
        hit = shared * den >= (sizes[0][:, None] + sizes[1][None, :] - shared) * num
        roots = [np.array([x[2] for x in side], np.int64) for side in sides]
        parent: dict[int, int] = {}

        def top(v: int) -> int:
            while (p := parent.get(v, v)) != v:
                parent[v] = parent.get(p, p)
                v = p
            return v

        out = []
        for i, j in zip(*np.nonzero(hit & (roots[0][:, None] != roots[1][None, :])), strict=True):
            p, q = top(int(roots[0][i])), top(int(roots[1][j]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                out.append(sorted((sides[0][i][1], sides[1][j][1])))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    for x in batches:
        for value, one, two, role, component, i, raw in zip(*(x[c] for c in ("value", "one", "two", "role", "component", "id", "set")), strict=True):
            if (value, one, two) != key:
                if held:
                    yield compared()
                key, held = (value, one, two), []
            held.append((role, i, component, _set(raw)))
    if held:
        yield compared()


class NearDuplicates:
    """The operator on one table. classes: (id, n, rep), rep being the smallest id with the same set; reps: (rep, n, h1, h2, sketch)."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: tuple[int, int] = SIMILARITY, k: int = SKETCH, listed: int = LISTED, common: int = COMMON):
        self.words, self.similarity, self.k, self.listed, self.common = words, similarity, k, listed, common
        self.texts = packed(df, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
        kind = "id long, n long, h1 long, h2 long, sketch array<long>"
        self.sets = materialize(self.texts.mapInArrow(lambda it: _sketched(it, k, words), kind), "sketches")
        usable = self.sets.where("n > 0 and id is not null")
        own = usable.groupBy("id").agg(F.min(F.struct("n", "h1", "h2")).alias("set")).select("id", "set.*")
        own = materialize(own, "own")
        reps = own.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"))
        sketches = usable.groupBy("n", "h1", "h2").agg(F.first("sketch").alias("sketch"))  # equal in a group
        self.reps = materialize(reps.join(sketches, ["n", "h1", "h2"]), "reps")
        self.classes = materialize(own.join(self.reps.drop("sketch"), ["n", "h1", "h2"]).select("id", "n", "rep"), "classes")
        release(own)

    def listed_reps(self) -> DataFrame:
        """(rep, n, central, keys): keys are the values to list a class by, central its share of common ones."""
        values = self.reps.select("rep", F.explode("sketch").alias("value"))
        often = materialize(values.groupBy("value").count().where(F.col("count") > self.common), "often")
        if small_enough(often, BROADCAST_ROWS):
            often = F.broadcast(often)
        seen = values.join(often, "value").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("count", "value"))).alias("often"))  # at most k values each
        x = self.reps.select("rep", "n", "sketch").join(seen, "rep", "left")
        # Linked sets share at least `least` values of their sketches, so they share one of all values but least - 1, in any common order.
        num, den = self.similarity
        least = F.when(F.col("n") * den <= self.k * num, F.ceil(F.col("n") * num / den)).otherwise(F.lit(allowed(self.k, num / den)))
        ordered = F.concat(F.array_except("sketch", "often.value"), "often.value")
        keys = F.when(F.col("often").isNull(), F.slice("sketch", 1, self.listed)).otherwise(F.slice(ordered, F.lit(1), (F.size("sketch") - least + 1).cast("int")))
        central = F.coalesce(F.size("often"), F.lit(0)) / F.size("sketch")
        return materialize(x.select("rep", "n", central.alias("central"), keys.alias("keys")), "listed")

    def full_sets(self, ids: DataFrame) -> DataFrame:
        """(id, set) of classes (id); partitioned by id."""
        ids = materialize(ids.distinct().join(self.reps.select(F.col("rep").alias("id"), "h1", "h2"), "id"), "wanted")
        if small_enough(ids, BROADCAST_ROWS):
            ids = F.broadcast(ids)
        words = self.words
        made = self.texts.join(ids, "id").select("id", "text", "h1", "h2").mapInArrow(lambda it: _full_sets(it, words), "id long, set binary")
        return made.dropDuplicates(["id"])

    def links(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of classes, those that link: by union sketch, then by the full sets."""
        pairs = materialize(pairs, "pairs")
        wanted = materialize(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "wanted")
        reps = self.reps.join(F.broadcast(wanted) if small_enough(wanted, BROADCAST_ROWS) else wanted, "rep", "left_semi")
        sketch = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
        near = pairs.join(sketch("a"), "a").join(sketch("b"), "b")
        near = materialize(near.where(_may_link(F.col("s_a"), F.col("s_b"), F.col("n_a"), F.col("n_b"), self.k, self.similarity)).select("a", "b"), "near")
        blocks = near.groupBy("a").count().select("a", F.ceil(F.col("count") / BLOCK).alias("blocks"))
        rows = near.join(blocks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), "b", F.lit(1).alias("role"))
        firsts = rows.select("a", "block").distinct().select("a", "block", F.col("a").alias("b"), F.lit(0).alias("role"))
        rows = rows.unionByName(firsts).withColumn("id", F.col("b"))
        sets, similarity = self.full_sets(near.select(F.explode(F.array("a", "b")).alias("id"))), self.similarity
        dealt = rows.join(sets, "id").repartition(F.col("a"), F.col("block")).sortWithinPartitions("a", "block", "role", "b").select("a", "block", "role", "b", "set")
        return dealt.mapInPandas(lambda it: _verify(it, similarity), "a long, b long")

    def components(self) -> DataFrame:
        """(rep, component) for each class that links with another; ids of components are the smallest of their documents."""
        ordered = (F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        listed = self.listed_reps()
        lists = listed.select(F.explode("keys").alias("value"), "rep", "n", "central")
        stars = lists.groupBy("value").agg(F.max(F.struct("central", (-F.col("rep")).alias("minus"), "n")).alias("star"), F.count(F.lit(1)).alias("m")).where("m > 1")
        lists = materialize(lists.join(stars, "value").withColumn("star_rep", -F.col("star.minus")), "lists")
        first = lists.where((F.col("rep") != F.col("star_rep")) & self._alike("n", "star.n")).select(F.col("star_rep").alias("a"), F.col("rep").alias("b"))
        first = materialize(first.select(*ordered).distinct(), "first")
        found = materialize(self.links(first), "links")
        joined = components(found)
        apart = self._still_apart(lists.select("value", "rep", "n"), joined)
        again = self._still_apart(self.prefix_lists(apart.where(F.col("m") > self.common).select("rep")), joined)
        rest = self._pairs(apart).unionByName(self._pairs(again)).distinct().join(first, ["a", "b"], "left_anti")
        more = self.links(rest).unionByName(self.block_links(self._sides(again.where(F.col("m") > self.common))))
        out = components(found.unionByName(materialize(more, "links"))).withColumnRenamed("v", "rep")
        for done in (listed, lists, first, apart, again):
            release(done)
        return out

    def _sides(self, lists: DataFrame) -> DataFrame:
        """lists with `few`: whether a member is outside its list's largest component; such members are compared with all, others with these only."""
        best = lists.groupBy("value", "component").count().groupBy("value").agg(F.max(F.struct("count", F.col("component").alias("largest"))).alias("best"))
        return lists.join(best.select("value", "best.largest"), "value").withColumn("few", F.col("component") != F.col("largest")).drop("largest")

    def _alike(self, x: str, y: str) -> Column:
        num, den = self.similarity
        return (F.col(x) * den >= F.col(y) * num) & (F.col(y) * den >= F.col(x) * num)

    def _pairs(self, apart: DataFrame) -> DataFrame:
        """Pairs of members of different components of the short lists."""
        few = apart.where(F.col("m") <= self.common).drop("m", "shingles")
        other = few.select("value", *(F.col(c).alias(f"{c}2") for c in ("rep", "n", "component")))
        rest = few.join(other, "value").where((F.col("rep") < F.col("rep2")) & (F.col("component") != F.col("component2")) & self._alike("n", "n2"))
        return rest.select(F.col("rep").alias("a"), F.col("rep2").alias("b")).distinct()

    def prefix_lists(self, reps: DataFrame) -> DataFrame:
        """(value, rep, n): classes listed by prefixes of their full sets, written."""
        sets = materialize(self.full_sets(reps.select(F.col("rep").alias("id"))).withColumnRenamed("id", "rep"), "sets")
        values = sets.mapInPandas(_exploded, "value long")
        often = values.groupBy("value").count().where(F.col("count") > self.common).orderBy(F.desc("count"), "value").limit(HEAVY)
        heavy = often.toPandas()["value"].to_numpy("int64")[::-1].view(np.uint64)  # HEAVY at most
        held, similarity = sets.sparkSession.sparkContext.broadcast(heavy), self.similarity
        return sets.mapInPandas(lambda it: _prefixes(it, held.value, similarity), "value long, rep long, n long")

    def block_links(self, lists: DataFrame) -> DataFrame:
        """Links between members of different components of long lists (value, rep, component, n, few), enough to join these.

        Members outside a list's largest component are dealt out in blocks of bounded size, and so are all its members; each block of the
        former meets each of the latter. The pairs of sets within are counted there as products of incidence matrices; only
        links that join components leave the task.
        """
        size = lambda which: F.greatest(F.ceil(F.count(which) / BLOCK_ROWS), F.ceil(F.sum(F.when(which, F.col("n"))) / BLOCK_SHINGLES), F.lit(1)).cast("int")
        blocks = lists.groupBy("value").agg(size(F.when(F.col("few"), True)).alias("ones"), size(F.lit(True)).alias("twos"))
        dealt = lists.join(blocks, "value").select("value", "few", "component", F.col("rep").alias("id"), "ones", "twos")
        block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = dealt.where("few").withColumns({"one": block("ones"), "role": F.lit(0)}).withColumn("two", every("twos"))
        right = dealt.withColumns({"two": block("twos"), "role": F.lit(1)}).withColumn("one", every("ones"))
        dealt = left.unionByName(right).select("value", "one", "two", "role", "component", "id")
        sets, similarity = self.full_sets(lists.select(F.col("rep").alias("id"))), self.similarity
        dealt = dealt.join(sets, "id").repartition("value", "one", "two").sortWithinPartitions("value", "one", "two", "role", "id")
        return dealt.mapInPandas(lambda it: _block_links(it, similarity), "a long, b long")

    def _still_apart(self, lists: DataFrame, joined: DataFrame) -> DataFrame:
        """Lists (value, rep, n) with their members' components, without those that lie in one component."""
        lists = lists.join(joined.withColumnRenamed("v", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        lists = materialize(lists, "members")
        mixed = lists.groupBy("value").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles")).where("c1 <> c2").select("value", "m", "shingles")
        out = materialize(lists.join(mixed, "value"), "apart")
        release(lists)
        return out

    def documents(self) -> DataFrame:
        """One row per row of the table: id, n, component, kept."""
        grouped = self.classes.join(self.components(), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
        out = self.sets.select("id", "n").join(grouped, "id", "left").withColumn("component", F.coalesce("component", "id"))
        return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component")))


def annotate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of df: id, n (size of its set), component, kept."""
    return NearDuplicates(df, id_col, text_col, **options).documents()


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df's rows of the documents that stay: of each component the one with the smallest id, and all null ids.

    Rows decide where they lie, by a broadcast of the ids that go, if they are BROADCAST_ROWS at most, else by a join.
    """
    gone = materialize(annotate(df, id_col, text_col, **options).where("not kept").select("id").distinct(), "gone")
    if small_enough(gone, BROADCAST_ROWS):
        gone = F.broadcast(gone)
    return packed(df, id=id_col).join(gone, "id", "left_anti").select("row.*")
