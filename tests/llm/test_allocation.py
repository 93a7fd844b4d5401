"""Mixing and sharding: laws that every result must keep, against plain computations."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernal.llm import mixing, sharding


def water_levels(sizes, weights, cap=3):
    """By the iteration itself: clamp, reshare, until none is above."""
    total, left = sum(sizes), set(range(len(sizes)))
    target = [0.0] * len(sizes)
    while left:
        level = (total - sum(cap * sizes[i] for i in range(len(sizes)) if i not in left)) / sum(weights[i] for i in left)
        over = {i for i in left if level * weights[i] > cap * sizes[i]}
        for i in left:
            target[i] = level * weights[i]
        if not over:
            break
        left -= over
    return [cap * sizes[i] if i not in left else target[i] for i in range(len(sizes))]


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 5000, 2, 3, 900], [0, 10, 0, 400], [7], [1, 1, 1, 1, 10**9]])
def test_targets(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    df = spark.createDataFrame([(n, s) for n, s in zip(names, sizes, strict=True)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    want = water_levels(sizes, [mixing.WEIGHTS[i % 3] for i in range(len(sizes))])
    assert [got[n] for n in names] == pytest.approx(want)


@pytest.mark.parametrize("limit", [mixing.BROADCAST_ROWS, 0])
def test_mix(make, corpus, limit, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", limit)
    df = make(corpus)
    got = mixing.mix(mixing.sizes(df)).collect()
    again = mixing.mix(mixing.sizes(df.repartition(7))).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(corpus)
    words, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        words[r.source] += r.size
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        assert 0 <= r.copies <= 3
    assert {r.source: r.source_size for r in got} == words
    names = sorted((n for n in words if n is not None)) + [None]
    assert [target[n] for n in names] == pytest.approx(water_levels([words[n] for n in names], [mixing.WEIGHTS[i % 3] for i in range(len(names))]))
    assert sum(target.values()) == pytest.approx(sum(words.values()))
    largest = defaultdict(int)
    for r in got:
        largest[r.source] = max(largest[r.source], r.size)
    for n in names:
        assert 0 <= target[n] - taken[n] + 1e-6 <= largest[n] + 1e-6
    text = {i: t for i, t, _ in corpus}
    assert all(r.size == len((text[r.id] or "").split()) for r in got if r.id is not None and r.id != 606)


def test_repeat(make, corpus):
    df = make(corpus)
    out = mixing.repeat(df)
    assert out.columns == df.columns
    want = sum(r.copies for r in mixing.mix(mixing.sizes(df)).collect())
    assert out.count() == want
    assert mixing.repeat(make([])).count() == 0 and mixing.mix(mixing.sizes(make([]))).count() == 0
    assert mixing.mix(mixing.sizes(make([(1, None, "s"), (2, "", "s")]))).agg(F.sum("copies")).first()[0] == 0


def brute_mix(rows, weights=mixing.WEIGHTS, cap=3):
    """Repetitions of rows (id, source, size), by plain running sums over each source; a Counter of (id, source, size, copies)."""
    names = sorted({s for _, s, _ in rows if s is not None}) + [None] * any(s is None for _, s, _ in rows)
    words = [sum(n for _, s, n in rows if s == name) for name in names]
    out = Counter()
    for name, size, target in zip(names, words, water_levels(words, [weights[i % 3] for i in range(len(names))], cap), strict=True):
        mine = [(int(hashlib.md5(f"mix-1:{'' if i is None else i}".encode()).hexdigest()[:15], 16), -1 if i is None else i, n, i) for i, s, n in rows if s == name]
        mine.sort(key=lambda x: x[:3])
        whole = int(target // size) if size else 0
        extra, run, more = target - whole * size, 0, []
        for x in mine:
            run += x[2]
            more.append(run <= extra)
        missed, run = extra - sum(x[2] for x, m in zip(mine, more, strict=True) if m), 0
        for k, x in enumerate(mine):
            if not more[k] and x[2] <= missed / 4:
                run += x[2]
                more[k] = run <= missed
        for x, m in zip(mine, more, strict=True):
            out[x[3], name, x[2], whole + m if size else 0] += 1
    return out


@pytest.mark.parametrize("few", [mixing.FEW, 1])
def test_mix_against_running_sums(spark, few, monkeypatch):
    monkeypatch.setattr(mixing, "FEW", few)
    r = random.Random(8)
    cases = [
        [(i, r.choice("abcd"), r.choice([0, 1, 3, 50, 400])) for i in range(500)],
        [(7, "a", 10) for _ in range(40)] + [(i, "b", 30) for i in range(20)] + [(None, None, 5), (None, None, 9)],
        [(i % 3, r.choice(["a", None]), r.choice([1, 2, 300])) for i in range(200)] + [(1000 + i, "z", 7) for i in range(30)],
    ]
    for rows in cases:
        df = spark.createDataFrame(rows, "id long, source string, size long")
        assert Counter((x.id, x.source, x.size, x.copies) for x in mixing.mix(df).collect()) == brute_mix(rows)
        texts = spark.createDataFrame([(i, f"{k} " + "w " * (n - 1) if n else "", s) for k, (i, s, n) in enumerate(rows)], "doc_id long, text string, source string")
        got = Counter((x.doc_id, x.source, len(x.text.split())) for x in mixing.repeat(texts).collect())
        want = Counter()
        for (i, s, n, copies), times in brute_mix(rows).items():
            want[i, s, n] += copies * times
        assert got == +want


def test_many_sources(spark):
    """No task holds all sources: places come from the parts of a sort."""
    sizes = [1 + i * 7919 % 1000 for i in range(3000)]
    df = spark.createDataFrame([(f"{i:05d}", s) for i, s in enumerate(sizes)], "source string, source_size long")
    got = {x.source: x.target for x in mixing.targets(df.repartition(7)).collect()}
    assert [got[f"{i:05d}"] for i in range(3000)] == pytest.approx(water_levels(sizes, [mixing.WEIGHTS[i % 3] for i in range(3000)]))


def test_shard(make, corpus):
    df = make(corpus)
    got = sharding.shard(df, 4).collect()
    again = sharding.shard(df.repartition(5), 4).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(corpus)
    text, slots, shards = {i: t for i, t, _ in corpus}, defaultdict(list), defaultdict(set)
    load = defaultdict(int)
    for r in got:
        if r.id is not None:
            raw = (text[r.id] or "").encode()
            assert (r.size, r.crc) == (len(raw) + 1, zlib.crc32(raw))
        slots[r.shard].append(r.slot)
        shards[bytes(r.digest)].add(r.shard)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for d, s in shards.items())
    assert sharding.shard(make([]), 4).count() == 0


def test_shard_balance(make, prose):
    rows = [(i, prose(i, 20 + i % 90), "s") for i in range(800)] + [(1000 + i, prose(1, 50), "s") for i in range(400)]
    got = sharding.shard(make(rows), 8).collect()
    load = np.bincount([r.shard for r in got], weights=[r.size for r in got], minlength=8)
    assert load.max() / load.mean() < 1.02 and load.min() / load.mean() > 0.98
    # The group of 400 copies is more than a shard's share of rows, so it is cut; no other group is.
    where = defaultdict(set)
    for r in got:
        where[bytes(r.digest)].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) == 1


def test_pack():
    g = np.random.default_rng(0)
    items = g.random((500, 3)) * [100, 10, 1]
    at = sharding.pack(items, 7)
    load = np.array([items[at == s].sum(axis=0) for s in range(7)])
    assert (load[:, 0] / load[:, 0].mean() < 1.01).all() and (load / load.mean(axis=0) < 1.15).all()
    assert len(sharding.pack(np.empty((0, 3)), 4)) == 0 and sharding.pack(np.zeros((2, 3)), 4).tolist() == [0, 0]


def plain_packing(groups, shards):
    """The dot-product rule, one item after the other: {digest: shard} of {digest: (bytes, tokens, rows)}."""
    total = [sum(g[d] for g in groups.values()) for d in range(3)]
    need = {k: [g[d] * shards / total[d] if total[d] else g[d] for d in range(3)] for k, g in groups.items()}
    room, out = [[1.0] * 3 for _ in range(shards)], {}
    for k in sorted(need, key=lambda k: (-max(need[k]), -sum(need[k]), k)):
        v = need[k]
        fits = [s for s in range(shards) if all(room[s][d] - v[d] >= -1e-9 for d in range(3))]
        dot = lambda s, v=v: sum(room[s][d] * v[d] for d in range(3))
        spare = lambda s, v=v: min(room[s][d] - v[d] for d in range(3))
        out[k] = max(fits, key=dot) if fits else max(range(shards), key=spare)
        room[out[k]] = [room[out[k]][d] - v[d] for d in range(3)]
    return out, need


def test_shard_by_brute_force(make, prose, monkeypatch):
    rows = [(i, prose(i % 37, 5 + i % 37 * 3) if i % 37 else None, "s") for i in range(150)]
    groups = defaultdict(lambda: [0, 0, 0])
    for _, t, _ in rows:
        g = groups[hashlib.md5((t or "").encode()).digest()]
        g[0], g[1], g[2] = g[0] + len((t or "").encode()) + 1, g[1] + len((t or "").split()), g[2] + 1
    monkeypatch.setattr(sharding, "_levelled", lambda need, at, shards: at)
    want, _ = plain_packing(groups, 4)
    got = {bytes(r.digest): r.shard for r in sharding.shard(make(rows), 4).collect()}
    assert got == want


def test_levelling_raises_no_load():
    g = np.random.default_rng(2)
    for _ in range(20):
        need = g.random((60, 3)) * [1, 0.2, 0.5]
        at = g.integers(0, 5, 60)
        load = lambda at, need=need: np.stack([np.bincount(at, weights=w, minlength=5) for w in need.T], axis=1)
        before, after = load(at), load(sharding._levelled(need, at.copy(), 5))
        assert after.max() <= before.max() + 1e-9 and np.ptp(after[:, 0]) <= np.ptp(before[:, 0]) + 1e-9
