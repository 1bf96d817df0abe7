"""Counts over pairs of places, block by block, against the pairs themselves."""

import numpy as np
import pytest

from coverscope.operators import ground, near, profile

RADIUS = 12.0


@pytest.fixture(scope="module")
def random_ground(spark):
    """120 units at random places on a lattice (some share one, some pairs lie exactly RADIUS apart), three without a place, five balls of different sizes, and all pairs."""
    rng = np.random.default_rng(8)
    xy = rng.integers(0, 60, size=(120, 2)) * 2.0 - 40
    xy[100:110] += 500  # a second group, and one unit alone
    xy[110] = (9000, 9000)
    rows = [(i, None if i > 116 else float(x), None if i > 116 else float(y)) for i, (x, y) in enumerate(xy)]
    balls = [(b, i) for b, share in enumerate((0.9, 0.5, 0.3, 0.1, 0.02), 1) for i in range(120) if rng.random() < share] + [(6, 110), (6, 118)]
    pairs = [(i, j) for i in range(117) for j in range(i + 1, 117) if ((xy[i] - xy[j]) ** 2).sum() <= RADIUS**2]
    places = spark.createDataFrame(rows, "unit bigint, x double, y double")
    return places, spark.createDataFrame(balls, "ball_id bigint, unit bigint"), spark.createDataFrame(pairs, "a bigint, b bigint")


def table(df, *keys):
    columns = sorted(df.columns)
    return {tuple(r[k] for k in keys): [None if r[c] is None else round(float(r[c]), 9) for c in columns] for r in df.collect()}


@pytest.mark.parametrize("sizes", [(7, 11), (ground.HOME, ground.OTHERS)])
def test_morans_i_without_pairs(random_ground, sizes):
    places, m, pairs = random_ground
    want = table(profile.membership_moran(m, pairs), "ball_id")
    got = table(ground.membership_moran(m, places, RADIUS, sizes), "ball_id")
    assert {k: v for k, v in got.items() if k in want} == want
    assert set(got) == {(b,) for b in range(1, 7)} and got[6,] == [6, None]  # no member of the last ball has a neighbour


@pytest.mark.parametrize("sizes", [(7, 11), (ground.HOME, ground.OTHERS)])
def test_adjacency_in_balls_without_pairs(random_ground, sizes):
    places, m, pairs = random_ground
    assert table(ground.ball_adjacency(m, places, RADIUS, sizes), "ball_id") == table(profile.ball_adjacency(m, pairs), "ball_id")


@pytest.mark.parametrize("sizes", [(7, 11), (ground.HOME, ground.OTHERS)])
def test_cross_adjacency_without_pairs(random_ground, sizes):
    places, m, pairs = random_ground
    assert table(ground.cross_adjacency(m, places, RADIUS, sizes), "a", "b") == table(profile.cross_adjacency(m, pairs), "a", "b")


@pytest.mark.parametrize("home, wanted", [(7, 2), (ground.HOME, 512)])
def test_exclusive_gaps_without_a_row_for_each_unit_and_pair(random_ground, home, wanted):
    places, m, _ = random_ground
    placed = places.dropna()
    inside = m.unionByName(m.where("ball_id = 2").selectExpr("7L ball_id", "unit")).join(placed.select("unit"), "unit").select("ball_id", "unit")  # the same members twice: no gap either way
    want = table(profile.exclusive_gaps(inside, placed), "a", "b")
    assert len(want) > 10 and (2, 7) not in want
    assert table(ground.exclusive_gaps(inside, placed, home, wanted), "a", "b") == want


def test_facility_access_in_parts_equals_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(2)
    q, f = rng.integers(0, 40, size=(90, 2)) * 1.0, rng.integers(0, 40, size=(70, 2)) * 1.0
    side = lambda x, name: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], f"{name} bigint, x double, y double")
    monkeypatch.setattr(near, "within_radius", None)  # a row for each pair in range is not wanted
    got = near.facility_access(side(q, "id"), side(f, "fid"), "id", "fid", ["x", "y"], [3, 5], [2], 25.0, sizes=(8, 16)).collect()
    d = np.sqrt(((q[:, None] - f[None]) ** 2).sum(axis=2))
    assert len(got) == 90
    for r in got:
        own = d[r.id]
        order = np.lexsort((np.arange(70), own))
        assert r.nearest_id == order[0] and [r.distance_1, r.distance_3, r.distance_5] == [own[order[i]] for i in (0, 2, 4)]
        assert [r.n_within_3, r.n_within_5] == [(own <= 3).sum(), (own <= 5).sum()]
        assert r.access_2 == pytest.approx(np.exp(-own[own <= 25] / 2).sum())


def test_nearest_distances_of_sets_far_apart_meet_few_leaves(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x, y = rng.random((400, 2)) * [10, 10], rng.random((500, 2)) * [10, 10] + [30, 30]
    x[:50] = x[0]
    side = lambda z: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(z)], "id bigint, x double, y double")
    monkeypatch.setattr(near, "within_radius", None)  # doubled radii make all cells one before such sets meet
    monkeypatch.setattr(near, "GROUP", 7)
    got = {r.id: r.d for r in near.nearest_distance(side(x), side(y), "id", ["x", "y"], 0, 20).collect()}
    want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2)).min(axis=1)
    assert len(got) == 400 and np.allclose([got[i] for i in range(400)], want)
