"""Rings, checked writes, clusters, quantiles, scans, histograms and spatial closure, against plain versions."""

import hashlib
import itertools
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverscope.operators import bins, contract, contrast, geo, graph, profile, scale, stats
from coverscope.operators.joins import ContractError
from coverscope.sources import files


def ring(*at):
    return [{"x": float(x), "y": float(y)} for x, y in at]


@pytest.fixture(scope="module")
def shapes(spark):
    """A square with a hole, and one polygon of two parts of which one lies in the hole."""
    square = lambda a, b: ring((a, a), (b, a), (b, b), (a, b))
    rows = [(1, [square(0, 10), square(3, 7)]), (2, [square(4, 6), square(20, 25)])]
    return spark.createDataFrame(rows, "p int, rings array<array<struct<x: double, y: double>>>")


def test_points_in_rings(spark, shapes):
    at = {"in ring": (1, 1), "in hole": (3.5, 5), "on the hole's edge": (3, 5), "island": (5, 5), "island's edge": (4, 5), "second part": (22, 22), "far": (50, 50), "corner": (0, 0), "level with corners": (1, 7)}
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in at.items()], "id string, x double, y double")
    got = {r["id"]: r["p"] for r in geo.assign_points(points, shapes, "id", "p", "rings", 2.0).collect()}
    assert got == {"in ring": 1, "in hole": None, "on the hole's edge": 1, "island": 2, "island's edge": 2, "second part": 2, "far": None, "corner": 1, "level with corners": 1}
    over = shapes.unionByName(spark.createDataFrame([(3, [ring((0, 0), (2, 0), (2, 2), (0, 2))])], shapes.schema))
    several = sorted((r["id"], r["p"], r["boundary"], r["n_hits"]) for r in geo.ambiguous_points(points, over, "id", "p", "rings", 2.0).collect())
    assert several == [("corner", 1, True, 2), ("corner", 3, True, 2), ("in ring", 1, False, 2), ("in ring", 3, False, 2)]
    assert [(r["a"], r["b"]) for r in geo.queen_adjacency(over, "p", "rings", 2.0).collect()] == [(1, 3)]


def test_geojson_with_holes_parts_and_others(spark):
    one = '{"features": [{"properties": {"k": 1}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0,0],[4,0],[4,4]],[[1,1],[2,1],[2,2]]],[[[9,9],[8,9],[8,8]]]]}}]}'
    got = files.read_geojson(spark.createDataFrame([(one,)], "v string"), "v", {"k": "int"}).first()
    assert got["k"] == 1 and [len(r) for r in got["rings"]] == [3, 3, 3] and got["rings"][1][0] == (1.0, 1.0)
    bad = one.replace("MultiPolygon", "Point")
    with pytest.raises(Exception, match="not a polygon"):
        files.read_geojson(spark.createDataFrame([(bad,)], "v string"), "v", {"k": "int"}).collect()


def test_a_broken_table_is_not_published(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0), (2, -1.0), (2, 3.0)], "id int, x double")
    out = str(tmp_path / "t")
    for key, spec in ((None, {"positive": ["x"]}), ("id", {})):
        with pytest.raises(ContractError, match="positive:x|unique:id"):
            contract.write_checked(df, out, key=key, **spec)
        assert os.listdir(tmp_path) == []
    report = contract.write_checked(df, out, non_missing=["x"])
    assert {r["check"] for r in report.collect()} == {"min_rows", "required_columns", "non_missing:x"} and spark.read.parquet(out).count() == 3
    with pytest.raises(ContractError, match="exists"):
        contract.write_checked(df, out)


def test_clusters_reach_the_least_sum_of_squares(spark):
    x = np.random.default_rng(2).normal(size=(10, 2)).round(3)
    x[:5] += 4
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, x double, y double").repartition(3)
    best = {}
    for k in (2, 3):
        for own in itertools.product(range(k), repeat=10):
            if len(set(own)) == k:
                own = np.array(own)
                best[k] = min(best.get(k, np.inf), sum(((x[own == c] - x[own == c].mean(axis=0)) ** 2).sum() for c in range(k)))
    found = stats.lloyd(df, "id", ["x", "y"], [1, 2, 3], starts=8)
    assert {k: found[k][0] for k in (2, 3)} == pytest.approx(best)
    assert found[1][0] == pytest.approx(((x - x.mean(axis=0)) ** 2).sum()) and sum(found[3][2]) == 10


def test_quantiles_of_large_groups_and_columns(spark, monkeypatch):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=400).round(1), "b": rng.normal(size=3), None: rng.normal(size=90)}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("a", None)], "k string, v double").repartition(5)
    levels = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r["k"]: r["q"] for r in scale.group_quantiles(df, ["k"], "v", levels, "q", small=50).collect()}
    assert {k: pytest.approx(list(np.quantile(x, levels))) for k, x in groups.items()} == got
    every = np.concatenate(list(groups.values()))
    monkeypatch.setattr(scale, "SMALL", 10)
    assert scale.bracketed(df.where("v is not null").select(F.col("v").alias("_v")), len(every), levels) == pytest.approx(list(np.quantile(every, levels)))
    assert scale.quantiles(df, "v", levels).first()[0] == pytest.approx(list(np.quantile(every, levels)))
    monkeypatch.setattr(scale, "INSIDE", 0)
    assert scale.quantiles(df, "v", levels).first()[0] == pytest.approx(list(np.quantile(every, levels)))


def test_prefix_scan_with_groups_and_nulls(spark):
    rng = np.random.default_rng(4)
    rows = [(["a", "b", None][i % 3], i, None if rng.random() < 0.6 else int(rng.integers(9))) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, t int, v int").repartition(4)
    got = {r["t"]: (r["last"], r["total"]) for r in bins.prefix_scan(df, ["t"], {"last": ("last", "v"), "total": ("sum", "v")}, ["g"]).collect()}
    seen, want = {}, {}
    for g, t, v in rows:
        last, total = seen.get(g, (None, None))
        seen[g] = (last, total) if v is None else (v, (total or 0) + v)
        want[t] = seen[g]
    assert got == want


def test_threshold_histogram_equals_counting(spark):
    rng = np.random.default_rng(5)
    gap, dist = rng.random(300).round(2) / 2, (rng.random(300) * 4).round(1)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(gap, dist)], "score_gap double, axis_distance double")
    got = {(r["gap"], r["distance"]): (r["n_pairs"], r["n_qualifying"]) for r in contrast.threshold_grid(df, [0.1, 0.25, 0.3], [1, 2.5]).collect()}
    assert got == {(g, x): (300, int(((gap < g) & (dist > x)).sum())) for g in (0.1, 0.25, 0.3) for x in (1.0, 2.5)}


def test_spatial_closure_equals_plain_versions(spark):
    rng = np.random.default_rng(6)
    at = {u: rng.random(2) * 1e5 for u in range(60)}
    balls = {1: set(range(0, 30)), 2: set(range(20, 50)), 3: set(range(48, 60)), 4: set(range(22, 28))}
    m = spark.createDataFrame([(b, u) for b, us in balls.items() for u in us], "ball_id bigint, unit bigint").repartition(3)
    places = spark.createDataFrame([(u, float(x), float(y)) for u, (x, y) in at.items()], "unit bigint, x double, y double")
    links = {(a, b) for a, b in itertools.combinations(range(58), 2) if np.hypot(*(at[a] - at[b])) < 15000}
    adjacency = spark.createDataFrame(sorted(links), "a bigint, b bigint")
    gaps = {(r["a"], r["b"]): (r["min_exclusive_km"], r["median_exclusive_km"]) for r in profile.exclusive_gaps(m, places).collect()}
    want = {}
    for a, b in itertools.combinations(balls, 2):
        mine, other = balls[a] - balls[b], balls[b] - balls[a]
        if mine and other:
            d = [min(np.hypot(*(at[u] - at[v])) for v in other) / 1000 for u in mine]
            want[a, b] = (min(d), np.median(d))
    assert gaps.keys() == want.keys() and all(gaps[k] == pytest.approx(want[k]) for k in want)
    cross = {(r["a"], r["b"]): r["n_cross"] for r in profile.cross_adjacency(m, adjacency).collect()}
    assert cross == {(a, b): n for a, b in itertools.combinations(balls, 2) if (n := sum(u in balls[a] and v in balls[b] or u in balls[b] and v in balls[a] for u, v in links))}
    moran = {r["ball_id"]: r["moran"] for r in profile.membership_moran(m, adjacency).collect()}
    for b, us in balls.items():
        flags = spark.createDataFrame([(u, float(u in us)) for u in at], "node bigint, value double")
        assert moran[b] == pytest.approx(graph.morans_i(flags, adjacency).first()["morans_i"])


@pytest.mark.parametrize("whole_bytes", [1 << 28, 3])
def test_manifest_has_the_hash_of_every_file(spark, tmp_path, whole_bytes):
    """Beyond whole_bytes files are read in pieces; an empty file has no row (see the docstring)."""
    (tmp_path / "sub folder").mkdir()
    content = {"a.bin": b"abc", "sub folder/b c.bin": b"x" * 20_000_000, "empty.bin": b""}
    for name, data in content.items():
        (tmp_path / name).write_bytes(data)
    got = files.file_manifest(spark, str(tmp_path), whole_bytes=whole_bytes).collect()
    assert {(r.path.split(str(tmp_path) + "/")[1], r.bytes, r.sha256) for r in got} == {(n, len(x), hashlib.sha256(x).hexdigest()) for n, x in content.items() if x}


def test_verify_manifest_roles_marks_and_odd_rows(spark):
    listed = spark.createDataFrame(
        [("a", " AB ", "input", "TRUE"), ("b", "cd", "input", "no"), ("c", "ef", "output", "yes"), ("d", None, "input", "yes"), ("e", "aa", "input", "yes"), ("e", "aa", "input", "yes"), (None, "aa", "input", "yes"), ("g", "aa", None, None)],
        "path string, sha256 string, role string, immutable string",
    )
    found = spark.createDataFrame([("a", "ab"), ("b", "cd"), ("c", "ee"), ("d", "cd"), ("e", "aa"), ("f", "aa"), ("g", "aa")], "path string, sha256 string")
    told = lambda **more: {r.path: r.status for r in files.verify_manifest(listed, found, **more).collect()}
    all_ = {"a": "OK", "b": "OK", "c": "CHANGED", "d": "CHANGED", "e": "DUPLICATE", "f": "UNLISTED", "g": "OK", None: "MISSING"}
    assert told() == all_
    assert told(immutable=True) == all_ | {"b": "MUTABLE", "g": "MUTABLE"}
    assert told(roles=["output"]) == {"c": "CHANGED", "f": "UNLISTED"}
    bare = files.verify_manifest(listed.drop("immutable"), found, immutable=True).collect()
    assert "OK" not in {r.status for r in bare}
    assert {r.status for r in files.verify_manifest(listed.limit(0), found).collect()} == {"UNLISTED"}


def test_neighbours_of_a_hub_are_not_listed(spark):
    edges = spark.createDataFrame([(0, i, i % 3) for i in range(1, 30)] + [(1, 2, 5)], "a int, b int, strength int")
    nodes = spark.range(31).select(F.col("id").cast("int").alias("node"))
    got = {r.node: r for r in graph.context(nodes, edges, max_listed=5).collect()}
    assert len(got) == 31 and got[0].degree == 29 and got[0].neighbours is None and got[0].strongest == 2
    assert got[1].neighbours == "0,2" and got[1].weighted_degree == 6 and got[30].degree == 0


def test_ols_with_covariates_equals_least_squares(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2))
    y = 1 + 2 * x[:, 0] - x[:, 1] + 0.5 * x[:, 0] * x[:, 1] + rng.normal(size=200)
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack([x, y])] + [(None, 1.0, 2.0)], "p double, q double, y double")
    got = stats.ols(df, "y", {"p": F.col("p"), "q": F.col("q"), "pq": F.col("p") * F.col("q")}).collect()
    design = np.column_stack([np.ones(200), x, x[:, 0] * x[:, 1]])
    beta, rss = np.linalg.lstsq(design, y, rcond=None)[:2]
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * rss[0] / 196)
    assert [r.coefficient for r in got] == pytest.approx(beta.tolist()) and [r.std_error for r in got] == pytest.approx(se.tolist())
    assert got[0].r2 == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum())
