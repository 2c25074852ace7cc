"""Prefix trie and centroid clustering on small fixtures: brute force, odd rows and small blocks."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from siftworks.llm import centroids, prefix_trie

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth int, n_convs string"


def brute_trie(rows):
    convs = {}
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())
    for r in sorted((r for r in rows if r[0] is not None), key=key):
        convs.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    members, stops = {(): set()}, {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(np.fmod(c, 100))
        path = convs.get(base, [])[:h] + turns[h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), set()).add(c)
        stops.setdefault(tuple(path), set()).add(c)
    out = set()
    if not convs:
        return out
    below = lambda p: [q for q in members if q[: len(p)] == p]
    for p, m in members.items():
        sub = below(p)
        leaves = sum(1 for q in sub if not any(len(x) == len(q) + 1 and x[:-1] == q for x in sub))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in sub if q)
        ids = hashlib.sha256(",".join(map(str, sorted(stops.get(p, ())))).encode()).hexdigest()
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), sum(len(q) == len(p) + 1 for q in sub), leaves, saved, ids))
    return out


def trie_of(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], CONVERSATIONS)
    got = prefix_trie.prefix_trie(df).collect()
    places = sorted([r.entered for r in got] + [r.left for r in got])
    assert places == list(range(2 * len(got)))
    return {tuple(r)[:8] for r in got}, len(got)


@pytest.mark.parametrize("blocks", [None, 6])
def test_trie_equals_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(prefix_trie, "ARCS", blocks)
        monkeypatch.setattr(prefix_trie, "DEPTHS", 2)
        monkeypatch.setattr(prefix_trie, "CHUNK", 1)
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "bot"]), rng.choice(["a", "bé", "ccc"])) for c in [0, 1, 2, 3, 7, 100, 101, 105, 250, 251, -5] for t in range(rng.randrange(1, 9))]
    rows += [(0, None, None, None), (3, 1, "user", "a"), (3, 1, "user", "a"), (None, 1, "user", "lost"), (8, 0, "", ""), (9, 0, "user", "x" * 5000)]
    want = brute_trie(rows)
    got, n = trie_of(spark, rows)
    assert got == want and n == len(want)


def test_trie_of_odd_tables(spark, monkeypatch):
    assert trie_of(spark, []) == (set(), 0)
    assert trie_of(spark, [(None, 1, "a", "b")]) == (set(), 0)
    monkeypatch.setattr(prefix_trie, "ARCS", 20)
    wide = [(1000 + i, 0, "user", str(i)) for i in range(12)]
    long = [(1206, t, "user", "again") for t in range(30)]  # one conversation and one parent hold the rows
    same = [(1300 + i, 0, "user", "hello") for i in range(30)]
    for rows in (wide, long, same):
        got, n = trie_of(spark, rows)
        assert got == brute_trie(rows) and n == len(got)


def brute_clusters(rows, count, size, rounds):
    kept = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    at = [v for _, v in named[:count]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(at))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        at = [[sum(col) // len(col) for col in zip(*mine, strict=True)] if (mine := [v for (_, v), k in zip(kept, own, strict=True) if k == c]) else at[c] for c in range(len(at))]
    done = [(i, *near(v)[::-1]) for i, v in kept]
    return sorted(((i, c, d, sum(x[2] for x in done if x[1] == c), sum(x[2] for x in done), tuple(at[c])) for i, c, d in done), key=repr)


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 1024]) for i in range(60)]  # many ties
    rows += [(3, rows[3][1]), (None, rows[5][1]), (70, None), (71, [1.0]), (72, [1.0, None, 0.0, 0.0]), (73, [float("nan")] * 4), (74, [float("inf"), 0.0, 0.0, 0.0]), (75, [-0.5, 2.5, 0.1, 1e-9])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, v string")
    got = sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in centroids.cluster_vectors(df, count=5, size=4, rounds=4).collect()), key=repr)
    assert got == brute_clusters(rows, 5, 4, 4) and len(got) == 63


def test_clusters_of_few_and_huge_vectors(spark):
    few = spark.createDataFrame([(1, [1e30, -1e30]), (2, [0.0, 0.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in centroids.cluster_vectors(few, size=2).collect()}
    assert len(got) == 2 and all(r.distance == 0 for r in got.values()) and sorted(got[1].centroid) == [-centroids.BOUND, centroids.BOUND]
    assert centroids.cluster_vectors(few.limit(0)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    assert centroids.cluster_vectors(few).count() == 0  # none has 64 components


def test_lists_find_the_nearest():
    rng = np.random.default_rng(1)
    for count in (1, 2, 8):
        at, x = rng.integers(-4, 5, (count, 3)), rng.integers(-6, 7, (500, 3))
        number, distance = centroids.Lists(at).nearest(x)
        d = ((x[:, None] - at[None]) ** 2).sum(2)
        assert (number == d.argmin(1)).all() and (distance == d.min(1)).all()
