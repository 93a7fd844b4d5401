"""Exact and near deduplication, components and vectors against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quernal.llm import embedding_dedup, exact_dedup, near_dedup
from quernal.llm.components import components


def ascii_lower(t):
    return (t or "").encode().lower().decode()


def roots(n, links):
    parent = {v: v for v in n}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {v: find(v) for v in n}


def test_exact(make, corpus):
    got = exact_dedup.annotate(make(corpus), k=4).toPandas()
    groups = defaultdict(list)
    for i, t, _ in corpus:
        groups[ascii_lower(t)].append(i)
    want = []
    for i, t, _ in corpus:
        g = groups[ascii_lower(t)]
        keep = max((x for x in g if x is not None), default=None)
        want.append((i, keep, len(g), i == keep, hashlib.sha256(ascii_lower(t).encode()).hexdigest()))
    rows = [(None if pd.isna(r.id) else int(r.id), None if pd.isna(r.keep_id) else int(r.keep_id), r.group_size, r.kept, bytes(r.digest).hex()) for r in got.itertuples()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))


def test_exact_deduplicate(make, corpus):
    df = make(corpus)
    out = exact_dedup.deduplicate(df, k=4)
    assert out.columns == df.columns
    texts = [ascii_lower(r[1]) for r in out.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {ascii_lower(t) for _, t, _ in corpus}
    assert exact_dedup.deduplicate(make([])).count() == 0 and exact_dedup.annotate(make([])).count() == 0


@pytest.mark.parametrize("limit", [exact_dedup.BROADCAST_ROWS, 0])
def test_exact_deduplicate_repeated_rows(spark, limit, monkeypatch):
    """Rows that repeat an id, with one text or several, or lack it; a broadcast and a join give the same."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", limit)
    rows = [(1, "A b", "x"), (1, "a B", "w"), (2, "a b", "z"), (2, "a b", "y"), (2, "other", "q"), (None, "a b", "n"), (None, "lone", "n"), (3, None, "e"), (4, "", "e")]
    out = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, tag string"), k=2)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([(2, "a b", "y"), (2, "other", "q"), (None, "lone", "n"), (4, "", "e")], key=repr)


def test_misra_gries():
    r = random.Random(1)
    rows = ["hot"] * 400 + ["warm"] * 150 + [f"c{i}" for i in range(450)]
    r.shuffle(rows)
    parts = [next(exact_dedup.summary(iter([pd.DataFrame({"digest": rows[i : i + 100]})]), 9)) for i in range(0, 1000, 100)]
    merged = next(exact_dedup.summary(iter(parts), 9))
    n = dict(zip(merged["digest"], merged["n"], strict=True))
    assert len(n) <= 9 and 400 - 100 <= n["hot"] <= 400 and 0 < n["warm"] <= 150


def shingles(text):
    """Tuples of five words, or of all of them where there are fewer."""
    w = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_near(rows):
    sets = {i: shingles(t) for i, t, _ in rows if i is not None}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return sets, roots(ids, links)


@pytest.mark.parametrize("common", [near_dedup.COMMON, 3])
def test_near(make, corpus, common):
    sets, want = brute_near(corpus)
    got = near_dedup.annotate(make(corpus), common=common).collect()
    assert len(got) == len(corpus)
    for r in got:
        if r.id is not None:
            assert (r.n, r.component, r.kept) == (len(sets[r.id]), want[r.id], r.id == want[r.id]), r.id
    assert len(set(want.values())) < len(want)


def test_near_many_alike(make, prose):
    """A large group of texts that share most of their words: some link, some do not, in long lists."""
    base = prose(1, 150).split()
    rows = []
    for i in range(90):
        w, r = list(base), random.Random(i)
        for k in range(r.choice([1, 2, 5, 6])):
            w[r.randrange(len(w))] = f"own{i}x{k}"
        rows.append((i + 1, " ".join(w), "s"))
    _, want = brute_near(rows)
    got = {r.id: r.component for r in near_dedup.annotate(make(rows), common=8).collect()}
    assert got == want


def test_near_deduplicate(make, corpus):
    df = make(corpus)
    _, want = brute_near(corpus)
    out = near_dedup.deduplicate(df)
    assert out.columns == df.columns
    kept = [r[0] for r in out.collect()]
    assert sorted(i for i in kept if i is not None) == sorted([i for i in want if want[i] == i] + [607]) and kept.count(None) == 2
    assert near_dedup.deduplicate(make([])).count() == 0


def test_shingles_and_bounds():
    h = near_dedup._WordHashes()
    s = lambda t: set(near_dedup.shingle_set(t, h).tolist())
    assert s(None) == s("") == s(" \t") == set() and len(s("a")) == 1 and s("A b\nC d") == s("a b c d") and s("a b") != s("b a")
    assert s("É a b c d") != s("é a b c d") and len(s("a b c d e f")) == 2 and len(s("a a a a a a a")) == 1
    assert near_dedup.allowed(48, 0.75, 1e-6) > near_dedup.allowed(48, 0.75) >= 15
    sets = [near_dedup.shingle_set(" ".join(f"w{(i * j) % 17}" for j in range(60)), h) for i in range(40)]
    for left, right in ((sets[:15], sets), (sets, sets[3:9]), ([], sets)):
        want = [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]
        assert near_dedup._overlaps(left, right).tolist() == want


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(1, 60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(-5, 7000), (9, 9)]
    want = roots({v for e in links for v in e}, links)
    got = {x.v: x.component for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {v: c for v, c in want.items() if any(v in e for e in links if e[0] != e[1])}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def vectors():
    g = np.random.default_rng(5)
    base = g.standard_normal((300, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(60):
        rows.append((1000 + i, (base[i % 20] + 0.25 * g.standard_normal(32)).tolist()))
    rows += [(2000 + i, base[7].tolist()) for i in range(30)] + [(3000, (2 * base[7]).tolist())]
    hub = g.standard_normal(32)
    rows += [(4000 + i, (hub + 0.2 * g.standard_normal(32)).tolist()) for i in range(80)]
    bad = [None, [], [0.0] * 32, [float("nan")] + [1.0] * 31, [None] + [1.0] * 31, [float("inf")] + [1.0] * 31, [1.0] * 5]
    return rows + [(5000 + i, b) for i, b in enumerate(bad)] + [(None, base[7].tolist()), (6000, [1.0] * 5)]


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK, 16])
def test_vectors(spark, vectors, block, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<double>, id int, ok int")
    got = {r.id: r for r in embedding_dedup.annotate(df).collect() if r.id is not None}
    good = {i: np.array(v) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.linalg.norm(good[a]) / np.linalg.norm(good[b]) >= 0.9]
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    want = roots(got, links)
    found = sum(r.n_links for r in got.values())
    assert found <= 2 * len(links) and found >= 0.995 * 2 * len(links)
    for i, r in got.items():
        assert r.n_links <= n[i] and r.kept == (r.id == r.component) and (i in good or (r.n_links == 0 and r.component == i))
    assert sum(got[i].component == want[i] for i in got) >= 0.99 * len(got)
    empty = spark.createDataFrame([], df.schema)
    assert embedding_dedup.annotate(empty).count() == 0
    assert embedding_dedup.annotate(df.where("id is null").unionByName(df.where("vec_id = 5000"))).collect()[0].n_links == 0


def test_rotation():
    g = np.random.default_rng(0)
    x = g.standard_normal((500, 16)) * np.linspace(0.2, 2, 16)
    w = embedding_dedup.itq(x, 16, 1)
    assert np.allclose(w.T @ w, np.eye(16), atol=1e-8)
    # Codes of pairs at the threshold, by a draw of their own: the share that meets in no table.
    width, count = embedding_dedup.plan(50_000, 0.9, 0.98)
    apart = g.random((20_000, embedding_dedup.BITS)) < np.arccos(0.9) / np.pi
    chosen = [g.permutation(embedding_dedup.BITS)[:width] for _ in range(count)]
    assert 0.97 <= np.mean(np.any([~apart[:, c].any(axis=1) for c in chosen], axis=0)) <= 0.995
    assert embedding_dedup.plan(10, 0.9, 0.9)[0] == 6 and embedding_dedup.plan(10**9, 0.9, 0.9)[0] == 18


@pytest.mark.parametrize("mean", [0.0, 1.0])
def test_vectors_at_the_threshold(spark, mean):
    """Thousands of links just above 0.9 and many just below, against all pairs; with a common mean, most vectors are alike anyway."""
    g = np.random.default_rng(11)
    centres = g.standard_normal((150, 64)) + mean
    x = np.concatenate([c + s * g.standard_normal((20, 64)) for c, s in zip(centres, np.linspace(0.2, 0.45, 150), strict=True)]).astype("float32")
    unit = x.astype("float64")
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    cosine = unit @ unit.T
    np.fill_diagonal(cosine, 0)
    links = cosine >= 0.9
    assert (links & (cosine < 0.91)).sum() > 2000
    got = {r.id: r for r in embedding_dedup.annotate(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")).collect()}
    assert sum(r.n_links for r in got.values()) >= 0.998 * links.sum() and all(got[i].n_links <= n for i, n in enumerate(links.sum(axis=1)))
    want = roots(range(len(x)), zip(*np.nonzero(np.triu(links)), strict=True))
    assert sum(got[i].component == want[i] for i in got) >= 0.998 * len(x)
    # The Hamming radius takes no link away: the codes of all links are within it.
    tables = embedding_dedup.Tables(list(x.astype("float64")), len(x), 0.9, 0.999)
    codes = embedding_dedup._words(tables.bits(unit))
    i, j = np.nonzero(np.triu(links))
    far = np.bitwise_count(codes[i] ^ codes[j]).sum(axis=1)
    near = np.bitwise_count(codes[i, :2] ^ codes[j, :2]).sum(axis=1)
    assert ((far <= tables.radius) & (near <= tables.glance_radius)).mean() >= 0.9999
    assert np.bitwise_count(codes[:500, None] ^ codes[None, 500:1000]).sum(axis=2).max() > tables.radius or mean


def test_heavy_text_is_settled_without_shuffle(make):
    """The winners' join is a broadcast."""
    out = exact_dedup.annotate(make([(i, "same", "s") for i in range(50)] + [(100 + i, f"t{i}", "s") for i in range(50)]), k=4)
    assert "BroadcastHashJoin" in out._jdf.queryExecution().toString()
    assert out.where("kept").count() == 51 and out.agg(F.max("group_size")).first()[0] == 50
