"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

1. Vectors of equal components form a class; one of each class goes on, with the number of its copies. Classes are known by their
   SHA-256, and by a number that is theirs alone in the table that they are written to.
2. ITQ learns rotations from a bounded sample (SAMPLE vectors, the least by a hash of the components): PCA, then alternating the binary
   codes sign(V R) and the orthogonal Procrustes solution R. Random starts add up to a code of BITS bits. Vectors of a length that
   the sample lacks get random directions instead.
3. Each Hamming table is keyed by a substring of the code, a choice of `width` of its bits. Width grows with the number of vectors, so that
   buckets hold about 2^BUCKET_BITS of them, and there are as many tables as a pair at the threshold needs to share a bucket
   with probability `recall`: bits of vectors at an angle t differ with a probability of about t / pi. Tables grow as about the 0.3rd power
   of the vectors: 16 up to 260,000, 25 at a million, 228 at a billion. Their entries hold codes (32 bytes), no vectors.
4. In a bucket, codes are compared first: pairs whose Hamming distance, in GLANCE bits or in all, is six deviations over that of the threshold go, and each other pair counts only in the first
   table where its codes collide. Vectors are fetched for the entries that such pairs are left of, once for each bucket, and
   these pairs are reranked by the cosine of the original vectors, in double precision.

Buckets over BLOCK vectors are dealt out by pairs of blocks. A task returns, for each vector, the copies linked to it, and
a spanning forest of the links it found, never the pairs themselves. All pairs in a bucket are compared, none is capped or sampled.

Null, zero or non-finite vectors, or vectors with a null component, link with nothing. Vectors of different lengths never
link. Ids are integers; null ids link with nothing, and rows that repeat an id count as several vectors of that id. A cosine equal
to the threshold links. An empty table gives no rows; columns are found by position, so names that clash do no harm. Building the result runs its jobs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernal.llm.common import materialize, packed, release, tidied
from quernal.llm.components import components

THRESHOLD = 0.9
#: Vectors that the rotations are learnt from, at most.
SAMPLE = 20_000
#: Wanted probability that a pair at the threshold shares a bucket.
RECALL = 0.999
ROUNDS = 20
#: Bits of a code, 64 to a word, and those of them that are looked at first.
BITS, GLANCE = 256, 128
#: A bucket holds about two to this power.
BUCKET_BITS = 12
#: Vectors of a bucket that one task compares with each other, at most about twice.
BLOCK = 8192
#: Rows of buckets, pairs whose codes are compared, and pairs that are reranked, that a task holds at a time, about.
CHUNK, CODE_SLICE, SLICE = 20_000, 1_000_000, 50_000
BUCKET = ("tab", "key", "left", "right")
WORDS = [f"c{k}" for k in range(BITS // 64)]
CODE = ", ".join(f"{c} long" for c in WORDS)


def itq(x: np.ndarray, bits: int, seed: int, rounds: int = ROUNDS) -> np.ndarray:
    """A (dim, bits) projection: PCA of the rows of x, then the learnt rotation. bits <= dim."""
    cov = x.T @ x / max(1, len(x))
    _, vectors = np.linalg.eigh(cov)
    w = vectors[:, ::-1][:, :bits]
    v = x @ w
    r = np.linalg.qr(np.random.default_rng(seed).standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ wt).T
    return w @ r


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """(bits of a substring, number of tables) for n vectors."""
    width = min(60, max(6, math.ceil(math.log2(max(2, n))) - BUCKET_BITS))
    p = math.acos(threshold) / math.pi
    # How likely a code differs in d bits, and a substring in none of them.
    weight = [math.comb(BITS, d) * p**d * (1 - p) ** (BITS - d) for d in range(BITS + 1)]
    same = [math.comb(BITS - d, width) / math.comb(BITS, width) for d in range(BITS + 1)]
    count = 1
    while sum(w * (1 - s) ** count for w, s in zip(weight, same, strict=True)) > 1 - recall:
        count += 1
    return width, count


class Tables:
    """Projections to bits by vector length, and the substring of each table."""

    def __init__(self, sample: list[np.ndarray], n: int, threshold: float, recall: float):
        self.width, self.count = plan(n, threshold, recall)
        by_length: dict[int, list[np.ndarray]] = {}
        for x in sample:
            by_length.setdefault(len(x), []).append(x)
        self.projections = {dim: self._learnt(np.stack(x), dim) for dim, x in by_length.items()}
        g = np.random.default_rng(99)
        dealt = -(-self.width * self.count // BITS) + 1
        # Whole permutations are dealt to tables, so that neighbouring tables share no bit.
        order = np.concatenate([g.permutation(BITS)[: BITS // self.width * self.width] for _ in range(self.count * dealt)])
        self.subsets = order[: self.width * self.count].reshape(self.count, self.width)
        used = np.zeros((self.count, BITS), bool)
        used[np.arange(self.count)[:, None], self.subsets] = True
        self.masks = _words(used)
        p = math.acos(threshold) / math.pi
        self.radius, self.glance_radius = (math.ceil(n * p + 6 * math.sqrt(n * p * (1 - p))) for n in (BITS, GLANCE))

    @staticmethod
    def _learnt(x: np.ndarray, dim: int) -> np.ndarray:
        x = _unit(x)
        return np.concatenate([itq(x, dim, seed) for seed in range(-(-BITS // dim))], axis=1)[:, :BITS]

    def bits(self, x: np.ndarray) -> np.ndarray:
        """(rows, BITS) of unit vectors of one length."""
        dim = x.shape[1]
        if dim not in self.projections:
            self.projections[dim] = np.random.default_rng(dim).standard_normal((dim, BITS))
        return x @ self.projections[dim] >= 0

    def keys(self, bits: np.ndarray) -> np.ndarray:
        """(rows, tables) of int64."""
        return bits[:, self.subsets].astype("int64") @ (np.int64(1) << np.arange(self.width, dtype="int64"))

    def pairs(self, codes: np.ndarray, tab: int, low: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers, in slices, of the pairs of a bucket that count in its table: all, or those of the first `low` rows with the others."""
        n, columns = len(codes), np.ascontiguousarray(codes[:, : GLANCE // 64].T)
        step = max(1, CODE_SLICE // max(1, n))
        for a in range(0, low or n, step):
            b = min(a + step, low or n)
            first = low or a  # pairs with rows before a were seen from there
            # A glance at some words of the code, which few unlike pairs pass, then all of it.
            apart = np.zeros((b - a, n - first), np.uint8)
            for word in columns:
                apart += np.bitwise_count(word[a:b, None] ^ word[None, first:])
            i, j = np.divmod(np.flatnonzero(apart <= self.glance_radius), n - first)
            i, j = i + a, j + first
            i, j = (i, j) if low else (i[i < j], j[i < j])
            for k in range(0, len(i), SLICE):
                u, v = i[k : k + SLICE], j[k : k + SLICE]
                differ = codes[u] ^ codes[v]
                fresh = np.bitwise_count(differ).sum(axis=1) <= self.radius
                for mask in self.masks[:tab]:
                    fresh &= (differ & mask).any(axis=1)
                yield u[fresh], v[fresh]


def _words(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(np.uint64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype("float64")
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@tidied
def _keyed(batches: Iterator[pd.DataFrame], tables: Tables) -> Iterator[pd.DataFrame]:
    for x in batches:
        lengths = x["vec"].map(len).to_numpy() if len(x) else np.empty(0, int)
        for dim in np.unique(lengths):
            mine = x[lengths == dim]
            bits = tables.bits(_unit(np.stack(mine["vec"].to_numpy())))
            at = np.repeat(np.arange(len(mine)), tables.count)
            tab = np.tile(np.arange(tables.count, dtype="int64"), len(mine)) + int(dim) * tables.count
            out = {"tab": tab, "key": tables.keys(bits).ravel(), "rep": mine["rep"].to_numpy()[at]}
            yield pd.DataFrame(out | dict(zip(WORDS, _words(bits)[at].T.view("int64"), strict=True)))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sorted rows of a partition in frames of about CHUNK rows, each bucket whole in one of them."""
    held: list[pd.DataFrame] = []
    for x in batches:
        held.append(x)
        if sum(map(len, held)) >= CHUNK:
            x = pd.concat(held, ignore_index=True)
            last = x.iloc[-1]
            cut = int(np.logical_and.reduce([x[c].to_numpy() == last[c] for c in BUCKET]).argmax())
            if cut:
                yield x.iloc[:cut]
            held = [x.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _buckets(x: pd.DataFrame) -> Iterator[tuple[slice, int, int]]:
    """(rows, table, rows of the left block, or 0 if there is one block) of each bucket of sorted rows."""
    keys = x[list(BUCKET)].to_numpy("int64")
    starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
    block = x["block"].to_numpy()
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(x)], strict=True):
        cross = keys[a, 2] != keys[a, 3]
        low = int((block[a:b] == keys[a, 2]).sum()) if cross else 0
        if b - a > 1 and (not cross or 0 < low < b - a):
            yield slice(a, b), int(keys[a, 0]), low


def _codes(x: pd.DataFrame) -> np.ndarray:
    return np.ascontiguousarray(x[WORDS].to_numpy("int64")).view(np.uint64)


@tidied
def _near(batches: Iterator[pd.DataFrame], tables: Tables) -> Iterator[pd.DataFrame]:
    """Of rows sorted by BUCKET and block, those that a pair within the radius is left of."""
    for x in _runs(batches):
        if not len(x):
            continue
        codes, wanted = _codes(x), np.zeros(len(x), bool)
        for rows, tab, low in _buckets(x):
            for i, j in tables.pairs(codes[rows], tab % tables.count, low):
                wanted[rows.start + i] = wanted[rows.start + j] = True
        yield x[wanted]


@tidied
def _compared(batches: Iterator[pd.DataFrame], tables: Tables, threshold: float) -> Iterator[pd.DataFrame]:
    """Such rows with copies and vec: (v, links, other, kind), counts of links and edges of a forest."""
    for x in _runs(batches):
        if not len(x):
            continue
        codes, reps, copies = _codes(x), x["rep"].to_numpy(), x["copies"].to_numpy("int64")
        links, edges = np.zeros(len(x), "int64"), [np.empty((0, 2), "int64")]
        for rows, tab, low in _buckets(x):
            unit = _unit(np.stack(x["vec"].iloc[rows].to_numpy()))  # one length: it is part of the table's number
            for i, j in tables.pairs(codes[rows], tab % tables.count, low):
                hit = np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold
                i, j = i[hit] + rows.start, j[hit] + rows.start
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                edges.append(_forest(i, j, len(x)))
        some, pairs = np.flatnonzero(links), np.concatenate(edges)
        yield pd.DataFrame({"v": reps[some], "links": links[some], "other": np.int64(0), "kind": 0})
        yield pd.DataFrame({"v": reps[pairs[:, 0]], "links": np.int64(0), "other": reps[pairs[:, 1]], "kind": 1})


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Pairs that span the same components as the pairs (i, j) of n rows, n - 1 at most."""
    root, out = list(range(n)), []
    for p, q in zip(i.tolist(), j.tolist(), strict=True):
        while root[p] != p:
            root[p] = p = root[root[p]]
        while root[q] != q:
            root[q] = q = root[root[q]]
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((p, q))
    return np.array(out, "int64").reshape(-1, 2)


def usable(vec: str = "vec"):
    """Whether the array column can link: not null or empty, all components finite numbers, and not all zero."""
    v = F.col(vec)
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda c: c != 0), F.lit(False))


def annotate(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of df: id, n_links, component, kept."""
    spark = df.sparkSession
    rows = packed(df, id=id_col, vec=vec_col).select(F.col("id").cast("long").alias("id"), "vec")
    rows = rows.withColumn("ok", usable() & F.col("id").isNotNull())
    digest = F.sha2(F.concat_ws(",", F.transform("vec", lambda c: F.when(c == 0, F.lit("0")).otherwise(c.cast("string")))), 256)
    rows = rows.select("id", "vec", "ok", F.when(F.col("ok"), F.unhex(digest)).alias("digest"))
    members = materialize(rows.select("id", "digest"), "members")
    kinds = rows.where("ok").groupBy("digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("vec").alias("vec"))
    kinds = materialize(kinds.select(F.monotonically_increasing_id().alias("rep"), "digest", "least", "copies", "vec"), "kinds")

    sample = kinds.orderBy(F.xxhash64("digest"), "digest").limit(SAMPLE).select("vec").toPandas()["vec"]
    tables = Tables([np.asarray(v, "float64") for v in sample], kinds.count(), threshold, recall)
    held = spark.sparkContext.broadcast(tables)
    entries = kinds.select("rep", "vec").mapInPandas(lambda it: _keyed(it, held.value), f"tab long, key long, rep long, {CODE}")
    large = entries.groupBy("tab", "key").count().where(F.col("count") > BLOCK)
    large = materialize(large.select("tab", "key", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "large")
    dealt = entries.join(large, ["tab", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("tab", "key", F.least("block", "with").alias("left"), F.greatest("block", "with").alias("right"), "block", "rep", *WORDS)
    sides = lambda x: x.repartition(*map(F.col, BUCKET)).sortWithinPartitions(*BUCKET, "block", "rep")
    near = sides(dealt).mapInPandas(lambda it: _near(it, held.value), f"tab long, key long, left int, right int, block int, rep long, {CODE}")
    near = materialize(near, "near")
    out = sides(near.join(kinds.select("rep", "copies", "vec"), "rep"))
    out = out.mapInPandas(lambda it: _compared(it, held.value, threshold), "v long, links long, other long, kind int")
    out = materialize(out, "compared")
    counted = out.where("kind = 0").groupBy(F.col("v").alias("rep")).agg(F.sum("links").alias("links"))
    joined = components(out.where("kind = 1").select(F.col("v").alias("a"), F.col("other").alias("b"))).toDF("rep", "root")
    known = kinds.drop("vec").join(counted, "rep", "left").join(joined, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    known = materialize(known, "known")
    for done in (kinds, large, near, out):
        release(done)
    least = known.groupBy("root").agg(F.min("least").alias("component"))
    known = known.join(least, "root").select("digest", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component")
    out = members.join(known, "digest", "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component"), F.col("id").eqNullSafe(component).alias("kept"))
