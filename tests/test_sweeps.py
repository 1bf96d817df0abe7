"""Many covers at once, their numbers and stability, and nearest neighbours by leaves, against plain versions."""

import hashlib
import math
from itertools import combinations

import numpy as np
import pytest

from coverscope.operators import cover, near, stability, sweep


def cloud(spark, n, seed, crowd=0):
    """n points in three axes, of which crowd at one place and as many in one tiny cell, with a class."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(6)
    x[:crowd] = 0.25
    x[crowd : 2 * crowd] = 0.1 + rng.random((crowd, 3)).round(3) * 1e-6
    rows = [(i, *map(float, r), "abc"[i % 3]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, z1 double, z2 double, z3 double, kind string").repartition(3), x


AXES = ["z1", "z2", "z3"]


def plain_cover(x, radius, replicate, seed=20260807, step=1009):
    """Landmarks in order and the members of each."""
    key = [(hashlib.md5(f"{i}:{seed + step * replicate}".encode()).hexdigest(), i) for i in range(len(x))]
    free, out = np.ones(len(x), bool), {}
    for _, i in sorted(key):
        if free[i]:
            inside = ((x - x[i]) ** 2).sum(axis=1) <= radius * radius
            out[i] = set(np.flatnonzero(inside))
            free &= ~inside
    return out


RADII, ORDERS = [0.2, 0.9, 2.0, 50.0], [1, 2, 3]


@pytest.fixture(scope="module")
def swept(spark):
    df, x = cloud(spark, 500, 1, crowd=20)
    s = sweep.Sweep(df, AXES, RADII, ORDERS, block=170, chunk=3, head=64)
    return df, x, s, {(r, k): plain_cover(x, r, k) for r in RADII for k in ORDERS}


def test_sweep_equals_the_walks(swept):
    _, _, s, want = swept
    assert s.blocks.count() == 3
    got = {}
    for r in sorted(s.balls().collect(), key=lambda r: r["ball_id"]):
        got.setdefault((r["radius"], r["replicate"]), []).append(r["landmark"])
    assert got == {k: list(v) for k, v in want.items()}
    members = {}
    for r in s.members().collect():
        members.setdefault((r["radius"], r["replicate"]), {}).setdefault(r["landmark"], set()).add(r["unit"])
    assert members == want


def test_cover_diagnostics_equal_the_plain_numbers(swept):
    _, x, s, want = swept
    rows = {(r["radius"], r["replicate"]): r for r in stability.cover_diagnostics(s.counts(), RADII).collect()}
    assert rows.keys() == want.keys() and len(stability.METRICS) + len(stability.FLAGS) + 5 == 33
    for key, balls in want.items():
        r, sets = rows[key], list(balls.values())
        sizes = [len(b) for b in sets]
        edges = [(a, b) for a, b in combinations(range(len(sets)), 2) if sets[a] & sets[b]]
        label = list(range(len(sets)))
        for a, b in edges * len(sets):
            label[a] = label[b] = min(label[a], label[b])
            if len(edges) > 3000:
                break
        degree = [sum(i in e for e in edges) for i in range(len(sets))] if len(sets) < 80 else None
        h = -sum(n / sum(sizes) * math.log(n / sum(sizes)) for n in sizes)
        assert (r["n_balls"], r["n_edges"], r["max_size"], r["min_size"], r["n_units"]) == (len(sets), len(edges), max(sizes), min(sizes), len(x))
        assert r["effective_balls"] == pytest.approx(math.exp(h)) and r["mean_memberships"] == pytest.approx(sum(sizes) / len(x))
        if degree is not None:
            assert r["n_components"] == len(set(label)) and r["connected"] == (len(set(label)) == 1)
            assert (r["max_degree"], r["n_isolated"]) == (max(degree), degree.count(0))
            assert r["sd_degree"] == pytest.approx(np.std(degree, ddof=1) if len(sets) > 1 else 0)
            assert r["cycle_rank"] == len(edges) - len(sets) + len(set(label))


def plain_jaccards(sets, radius):
    out = []
    for a, b in combinations(ORDERS, 2):
        x, y = sets[radius, a], sets[radius, b]
        out.append(len(x & y) / len(x | y) if x | y else 1.0)
    return out


def test_stability_by_bitmaps(swept):
    df, _, s, want = swept
    sample = df.where("id < 90 AND id % 2 = 0")
    got = {r["radius"]: r for r in stability.sweep_stability(s, sample).collect()}
    pairs = {k: {(a, b) for ball in v.values() for a, b in combinations(sorted(i for i in ball if i < 90 and i % 2 == 0), 2)} for k, v in want.items()}
    marks = {k: set(v) for k, v in want.items()}
    for radius in RADII:
        for name, sets in (("cover", pairs), ("landmark", marks)):
            j = plain_jaccards(sets, radius)
            assert got[radius][f"{name}_mean"] == pytest.approx(np.mean(j)) and got[radius][f"{name}_min"] == pytest.approx(min(j))
            assert got[radius][f"{name}_median"] == pytest.approx(np.median(j)) and got[radius][f"{name}_q10"] == pytest.approx(np.quantile(j, 0.1))


def test_a_large_sample_of_pairs_raises(swept, monkeypatch):
    df, _, s, _ = swept
    monkeypatch.setattr(sweep, "BLOCK", 100)
    with pytest.raises(ValueError, match="sample"):
        s.pair_bits(df)


@pytest.mark.parametrize("head", [1, 40])
def test_cover_by_dependency_equals_the_walk(spark, head):
    df, x = cloud(spark, 400, 5)
    balls, _ = cover.build_cover(df, AXES, 0.6, head=head)
    free, want = np.ones(len(x), bool), []
    for i in range(len(x)):
        if free[i]:
            want.append(i)
            free &= ~(((x - x[i]) ** 2).sum(axis=1) <= 0.36)
    assert [r["landmark"] for r in balls.orderBy("ball_id").collect()] == want


def plain_knn(x, ids, k):
    out = {}
    for i, a in zip(ids, x):
        d = sorted((math.sqrt((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2), j) for j, b in zip(ids, x) if j != i)[:k]
        out[i] = [(j, round(v, 9)) for v, j in d]
    return out


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["id"], []).append((r["neighbour"], round(r["distance"], 9)))
    return out


@pytest.mark.parametrize(("leaf", "k"), [(25, 4), (60, 15), (5000, 4)])
def test_knn_by_leaves_equals_all_pairs(spark, leaf, k):
    df, x = cloud(spark, 300, 2, crowd=60)
    assert listed(near.knn(df, "id", AXES, k, leaf=leaf)) == plain_knn(x, range(len(x)), k)


def test_knn_by_class_and_leaf(spark, monkeypatch):
    monkeypatch.setattr(near, "GROUP", 20)  # several groups ask one leaf
    df, x = cloud(spark, 200, 3, crowd=30)
    want = {}
    for c in range(3):
        own = [i for i in range(len(x)) if i % 3 == c]
        want |= plain_knn(x[own], own, 7)
    assert listed(near.knn(df, "id", AXES, 7, "kind", leaf=30)) == want


def test_knn_inside_a_large_leaf():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(700, 2)), rng.normal(size=(30, 2)) * 50])
    ids, q = np.arange(len(x)), rng.normal(size=(40, 2)) * 3
    for (d, i), (e, j) in zip(near.nearest_in(q, x, ids, 9, part=64), near.nearest(q, x, ids, 9), strict=True):
        assert list(i) == list(j) and np.allclose(d, e)


@pytest.mark.parametrize("sent", [32, 0])
def test_vector_search_by_tiles(spark, sent, monkeypatch):
    monkeypatch.setattr(near, "TILES_SENT", sent or 1)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 12))
    x[50:60] = x[0]
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(999, None)], "id bigint, v array<double>")
    monkeypatch.setattr(near, "TILE", 30)
    monkeypatch.setattr(near.tiles, "__defaults__", (30,))
    got = {}
    for r in sorted(near.knn_search(rows, rows.where("id % 2 = 0"), "id", "v", 5).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query"], []).append(r["neighbour"])
    want = {i: [j for _, j in sorted((round(float(np.sqrt(((x[i] - x[j]) ** 2).sum())), 12), j) for j in range(150) if j != i)[:5]] for i in range(0, 150, 2)}
    assert got == want


def test_many_blocks_stay_where_they_are_and_chunks_go_to_them(spark):
    rng = np.random.default_rng(12)
    points = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(rng.normal(size=(2000, 2)).round(3))], "id long, x double, y double")
    few, many = (sweep.Sweep(points, ["x", "y"], [0.5, 1.0, 2.0], [1, 2], block=b) for b in (4096, 20))
    assert many.blocks.count() > sweep.SENT and many.work.count() == 2 < few.work.count()
    assert "Exchange hashpartitioning" not in sweep.met_with(many.work, many.blocks)._jdf.queryExecution().toString()
    order = ["radius", "replicate", "kind", "a", "b", "n"]
    rows = [sorted(map(tuple, s.counts().select(*order).where("kind <> 'units'").collect())) for s in (few, many)]
    assert rows[0] == rows[1]


def test_scenarios_count_balls_without_a_row_for_each_membership(spark, monkeypatch):
    points, _ = cloud(spark, 300, 9)
    want = {(r.radius, r.replicate): (r.b, r.m) for r in cover.cover_grid(points, AXES, [0.9], [1, 2])[1].groupBy("radius", "replicate", "ball_id").count().groupBy("radius", "replicate").agg({"ball_id": "count", "count": "max"}).toDF("radius", "replicate", "m", "b").selectExpr("radius", "replicate", "least(b, m) b", "greatest(b, m) m").collect()}
    monkeypatch.setattr(sweep.Sweep, "members", lambda self: pytest.fail("a row for each membership"))
    got = {(r.radius, r.replicate): (r.n_balls, round(r.largest_share * 300)) for r in stability.scenario_sweep({"all": points}, AXES, [0.9], [1, 2]).collect()}
    assert {k: tuple(sorted(v)) for k, v in got.items()} == want
