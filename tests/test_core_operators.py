"""Operators on small tables with known results."""

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from coverscope.functions import columns as C
from coverscope.operators import bins, contract, cover, geo, graph, joins, near, profile, scale, stability, stats
from coverscope.operators.joins import ContractError
from coverscope.sources import cells, files
from coverscope.streaming.assign import assign_stream


@pytest.fixture(scope="module")
def hand(spark):
    """Three balls {1,2,3}, {3,4,5}, {5,6} and a value of each unit."""
    rows = [(1, 1, 1), (1, 1, 2), (1, 1, 3), (2, 4, 3), (2, 4, 4), (2, 4, 5), (3, 6, 5), (3, 6, 6)]
    m = spark.createDataFrame(rows, "ball_id bigint, landmark bigint, unit bigint")
    y = spark.createDataFrame([(1, 10.0, "a"), (2, 12.0, "a"), (3, 14.0, "b"), (4, 20.0, None), (5, 22.0, "b"), (6, 30.0, " ")], "id bigint, y double, c string")
    return m, y


def line(spark, order=("b", "a", "c")):
    at = {"a": 0.0, "b": 2.0, "c": 4.0}
    return spark.createDataFrame([(k, at[k], 0.0) for k in order], "id string, x double, y double")


@pytest.mark.parametrize("order", [("b", "a", "c"), ("c", "b", "a")])
def test_cover_does_not_depend_on_row_order(spark, order):
    balls, m = cover.build_cover(line(spark, order), ["x", "y"], 2.1)
    assert [(r.ball_id, r.landmark) for r in balls.orderBy("ball_id").collect()] == [(1, "a"), (2, "c")]
    assert sorted((r.ball_id, r.unit) for r in m.collect()) == [(1, "a"), (1, "b"), (2, "b"), (2, "c")]


@pytest.mark.parametrize("head", [2, 2048])
def test_cover_of_random_points_equals_the_walk(spark, head):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(200, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, x double, y double")
    got = [r.landmark for r in cover.landmarks(df.withColumn("eps", F.lit(0.7)), ["x", "y"], head=head).orderBy("ball_id").collect()]
    free, want = np.ones(len(x), bool), []
    for i in range(len(x)):
        if free[i]:
            want.append(i)
            free &= ((x - x[i]) ** 2).sum(axis=1) > 0.7**2
    assert got == want


def test_degenerate_radii(spark):
    p = line(spark)
    assert cover.build_cover(p, ["x", "y"], 0.1)[0].count() == 3
    assert cover.edges(cover.build_cover(p, ["x", "y"], 0.1)[1]).count() == 0
    assert cover.build_cover(p, ["x", "y"], 99.0)[0].count() == 1


def test_hand_cover(hand):
    m, y = hand
    assert sorted((r.a, r.b, r.strength) for r in cover.edges(m).collect()) == [(1, 2, 1), (2, 3, 1)]
    local = {r.unit: r.y for r in cover.local_colour(m, y, "id", ["y"]).collect()}
    assert local[3] == pytest.approx((12 + (14 + 20 + 22) / 3) / 2)
    s = profile.topology_summary(m.select("ball_id", "landmark").distinct(), m, cover.edges(m)).first()
    assert (s.n_balls, s.n_edges, s.n_components) == (3, 2, 1)
    assert s.share_multicovered == pytest.approx(2 / 6)
    mix = {(r.ball_id, r.level): r.n for r in profile.category_mix(m, y, "id", "c").collect()}
    assert mix[2, "UNRESOLVED"] == 1 and mix[2, "a"] == 0 and mix[3, "UNRESOLVED"] == 1


def test_components_of_a_chain_and_of_isolates(spark):
    nodes = spark.createDataFrame([(i,) for i in range(12)], "node bigint")
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "a bigint, b bigint")
    assert {r.node: r.component for r in graph.components(nodes, edges).collect()} == {**{i: 0 for i in range(10)}, 10: 10, 11: 11}


def test_grid_and_broadcast_radius_joins_agree(spark):
    p = spark.range(400).select("id", ((F.col("id") * 37) % 101).cast("double").alias("x"), ((F.col("id") * 53) % 97).cast("double").alias("y"))
    q = p.where("id % 9 = 0").select(F.col("id").alias("c"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    by = [near.within_radius(p, q, ["x", "y"], ["cx", "cy"], F.lit(7.0), n_centres=n, cell=7.0).select("id", "c") for n in (1, near.MAX_BROADCAST + 1)]
    assert sorted(by[0].collect()) == sorted(by[1].collect())


def test_knn_with_duplicate_points_and_few_rows(spark):
    p = spark.createDataFrame([(1, 0.0), (2, 0.0), (3, 5.0)], "id bigint, x double")
    assert [(r.id, r.neighbour, r["rank"]) for r in near.knn(p, "id", ["x"], 5).orderBy("id", "rank").collect()] == [(1, 2, 1), (1, 3, 2), (2, 1, 1), (2, 3, 2), (3, 1, 1), (3, 2, 2)]


def test_facilities_out_of_range_still_count(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0)], "id bigint, x double, y double")
    f = spark.createDataFrame([(7, 30.0, 0.0), (8, 40.0, 0.0)], "fid bigint, x double, y double")
    r = near.facility_access(q, f, "id", "fid", ["x", "y"], [5], [2], 10.0).first()
    assert (r.nearest_id, r.distance_1, r.distance_3, r.n_within_5, r.access_2) == (7, 30.0, None, 0, 0.0)


def test_points_on_a_boundary_are_hits(spark):
    square = "array(struct(0D as x, 0D as y), struct(2D as x, 0D as y), struct(2D as x, 2D as y), struct(0D as x, 2D as y))"
    poly = spark.range(1).select(F.lit(5).alias("p"), F.expr(square).alias("ring"))
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 2.0, 1.0), (3, 2.1, 1.0)], "id int, x double, y double")
    assert {r.id: r.n_hits for r in geo.assign_points(pts, poly, "id", "p", "ring", 1.0).collect()} == {1: 1, 2: 1, 3: 0}


def test_broken_contracts_raise(spark):
    a, twice = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (1, "z")], "k int, w string")
    with pytest.raises(ContractError):
        joins.left_join_preserving(a, twice, "k")
    with pytest.raises(ContractError):
        joins.align_exact(a, twice, "k")
    with pytest.raises(ContractError):
        contract.exclude_values(a, "k", [1])
    with pytest.raises(ContractError):
        contract.enforce(contract.table_contract(twice, key="k"))


def test_columns_with_odd_values(spark):
    df = spark.createDataFrame([("1,234.5",), ("..",), (None,), ("x",), (" 7 ",)], "t string")
    assert [r[0] for r in df.select(C.to_number(F.col("t"))).collect()] == [1234.5, None, None, None, 7.0]
    n = spark.createDataFrame([(float("nan"),), (float("inf"),), (-0.0,), (1234567.0,), (2.346,), (None,)], "x double")
    assert [r[0] for r in n.select(C.format_number_strict(F.col("x"))).collect()] == ["NA", "NA", "0", "1,234,567", "2.35", "NA"]
    ids = spark.createDataFrame([("ball 1, and 10 B1 1.0",), ("only 10",)], "t string")
    assert [r[0] for r in ids.select(C.mentions_id(F.col("t"), F.lit(1))).collect()] == [True, False]


def test_statistics_of_constant_and_short_columns(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, 5.0), (3.0, 5.0)], "x double, y double")
    assert df.agg(stats.correlation(F.col("x"), F.col("y"))).first()[0] is None
    assert df.limit(2).agg(stats.correlation(F.col("x"), F.col("x"))).first()[0] is None
    flagged = stats.outliers(df, "x", ["y"]).first()
    assert flagged.status == "zero_robust_scale" and flagged.flag is False
    q = spark.createDataFrame([(v,) for v in (1.0, 2.0, 4.0, 10.0)], "v double")
    assert stats.quantile_type8(q, "v", 0.5).first()[0] == pytest.approx(3.0)
    assert scale.z_score(df, {"y": "z"}).first().z is None


def test_average_ranks_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 1.0), (4, None)], "id int, v double")
    assert {r.id: r.k and float(r.k) for r in scale.average_rank(df, "v", "k").collect()} == {1: 2.5, 2: 2.5, 3: 1.0, 4: None}


def test_first_crossing_statuses(spark):
    grid = lambda ys: spark.createDataFrame([(float(i + 1), y) for i, y in enumerate(ys)], "x double, y double")
    assert bins.first_crossing(grid([0.1, 0.2]), "x", "y", 0.5).first().status == "NO_CROSSING_IN_GRID"
    assert bins.first_crossing(grid([0.6, 0.7]), "x", "y", 0.5).first().status == "CROSSING_AT_OR_BELOW_GRID_MINIMUM"
    r = bins.first_crossing(grid([0.0, 1.0]), "x", "y", 0.5).first()
    assert r.status == "LOG_RADIUS_INTERPOLATED" and r.crossing == pytest.approx(math.sqrt(2))


def test_quantile_bins_of_tied_values(spark):
    df = spark.createDataFrame([(float(v),) for v in [1] * 8 + [2, 3]], "v double")
    got = [r.bin for r in bins.quantile_bins(df, "v", 4).orderBy("v").collect()]
    assert got[:8] == [1] * 8 and got[8] >= 1 and got == sorted(got)


def test_published_benchmark_value(spark):
    one = spark.range(1).select(C.zero_overlap_chance(F.lit(33754), F.lit(25)))
    assert one.first()[0] == pytest.approx(0.98164084547110, abs=1e-12)


def test_grids(spark):
    assert [r.radius for r in stability.arithmetic_grid(spark, 1.4, 1.6, 0.05).orderBy("radius").collect()] == [1.4, 1.45, 1.5, 1.55, 1.6]
    with pytest.raises(ValueError):
        stability.arithmetic_grid(spark, 1.0, 2.0, 0.3)


def test_header_tokens_must_be_unique(spark):
    heads = spark.createDataFrame([(1, "A b"), (2, "ab")], "col int, value string")
    with pytest.raises(ContractError):
        cells.resolve_header_tokens(heads, spark.createDataFrame([("ab",)], "token string"))


def test_sink_refuses_an_existing_path(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "x")], "k int, v string")
    files.write_table(df, f"{tmp_path}/t")
    assert sorted(files.read_table(spark, f"{tmp_path}/t", "k int, v string").collect()) == [(1, None), (2, "x")]
    with pytest.raises(Exception, match="exists"):
        files.write_table(df, f"{tmp_path}/t")


def test_stream_of_units_meets_a_frozen_cover(spark, tmp_path):
    p = line(spark)
    balls, m = cover.build_cover(p, ["x", "y"], 2.1)
    p.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(p.schema).parquet(f"{tmp_path}/in")
    q = assign_stream(stream, balls, ["x", "y"]).writeStream.format("memory").queryName("assigned").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.ball_id, r.id) for r in spark.table("assigned").collect()) == sorted((r.ball_id, r.unit) for r in m.collect())


def cloud(spark, n, seed, axes=("x", "y", "z")):
    """(rows of id and axes, the same as an array), with doubles and a null row."""
    import numpy as np

    x = np.random.default_rng(seed).normal(size=(n, len(axes))).round(3)
    x[1] = x[0]
    rows = [(i, *map(float, v)) for i, v in enumerate(x)] + [(n, *[None] * len(axes))]
    return spark.createDataFrame(rows, "id bigint, " + ", ".join(f"{a} double" for a in axes)), x


@pytest.mark.parametrize("bound", [0, 20_000])
def test_nearest_distances_equal_all_pairs(spark, bound):
    import numpy as np

    (a, x), (b, y) = cloud(spark, 60, 1), cloud(spark, 80, 2)
    want = np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2)).min(axis=1)
    got = {r.id: r.d for r in near.nearest_distance(a, b, "id", ["x", "y", "z"], bound).collect()}
    assert sorted(got) == list(range(60)) and np.allclose([got[i] for i in range(60)], want)
    assert near.nearest_distance(a, b.limit(0), "id", ["x", "y", "z"], bound).count() == 0


@pytest.mark.parametrize("n", [2, 3, 300])
def test_diameter_equals_all_pairs(spark, n):
    import numpy as np

    df, x = cloud(spark, n, n)
    assert near.diameter(df, ["x", "y", "z"]).first()["diameter"] == pytest.approx(float(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)).max()))


def test_diameter_of_no_and_one_row(spark):
    df, _ = cloud(spark, 2, 5)
    assert near.diameter(df.limit(0), ["x", "y"]).first()["diameter"] is None
    assert near.diameter(df, ["x", "y"]).first()["diameter"] == 0


def test_distance_diagnostics_equal_all_pairs(spark):
    import numpy as np

    df, x = cloud(spark, 50, 7, ("x", "y"))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    pairs = d[np.triu_indices(50, 1)]
    np.fill_diagonal(d, np.inf)
    nearest = d.min(axis=1)
    nearest = nearest[nearest > 0]
    r = stability.distance_diagnostics(df, "id", ["x", "y"])
    r = r.first()
    assert (r.n_units, r.n_duplicates) == (50, (pairs == 0).sum())
    want = {"min_positive": pairs[pairs > 0].min(), "max": pairs.max(), "nn_min": nearest.min(), "nn_q25": np.quantile(nearest, 0.25), "nn_q95": np.quantile(nearest, 0.95), "nn_max": nearest.max(), "pair_q10": np.quantile(pairs, 0.1), "pair_q99": np.quantile(pairs, 0.99)}
    assert {k: r[k] for k in want} == pytest.approx(want)


def test_quantiles_from_places(spark):
    import numpy as np

    x = [1.0, 5.0, 2.0, 2.0, 9.0, -3.0, 2.0]
    df = spark.createDataFrame([(v,) for v in [*x, None]], "x double").repartition(3)
    levels = [0.0, 0.1, 0.5, 0.77, 1.0]
    assert scale.quantiles(df, "x", levels).first()[0] == pytest.approx(list(np.quantile(x, levels)))
    assert scale.quantiles(df.limit(0), "x", [0.5]).first()[0] == [None]


def test_vector_search_equals_all_pairs(spark):
    import numpy as np

    x = np.random.default_rng(9).normal(size=(70, 4)).round(2)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(99, None)], "id bigint, v array<double>").repartition(3)
    got = near.knn_search(df, df.where("id % 5 = 0"), "id", "v", 3).collect()
    for q in range(0, 70, 5):
        d = ((x - x[q]) ** 2).sum(axis=1)
        want = [int(i) for i in np.lexsort((np.arange(70), d)) if i != q][:3]
        assert [r.neighbour for r in sorted(got, key=lambda r: r["rank"]) if r.query == q] == want
    assert near.knn_search(df, df.limit(0), "id", "v", 3).count() == 0


def test_readouts_are_held_to_their_rules(spark):
    df = spark.createDataFrame([(1, 1, 1.5, 7), (2, 2, 2.5, 7), (3, 2, 2.5, 9)], "id int, count_a int, count_b double, count_c int")
    pick = lambda d, **rules: [r.column for r in cells.resolve_readout({"t": d}, "^count_", **rules).orderBy("rank").collect()]
    assert pick(df.drop("count_c")) == ["count_a", "count_b"]
    assert pick(df.drop("count_c"), integer=True) == ["count_a"]
    assert pick(df, mean_low=5.0) == ["count_c"] and pick(df.drop("count_c"), mean_high=2.0) == ["count_a"]
    with pytest.raises(ContractError):  # a and c part the rows differently
        pick(df)
    with pytest.raises(ContractError):
        pick(df.select("id"))


def test_run_matrix_with_several_axes_and_tiers(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 3), float(i)) for i in range(12)], "id bigint, x double, y double, c double")
    spec = {"run_id": "a", "dataset": "d", "axes": ["x", "y"], "colour": "c", "radius_min": 1.0, "radius_max": 2.0, "radius_step": 0.5, "repetitions": 2, "tier": 1}
    rows = stability.run_matrix({"d": df}, [spec, spec | {"run_id": "b", "axes": ["x"]}, spec | {"run_id": "no", "tier": 2}], tiers=[1]).collect()
    assert sorted((r.run_id, r.radius, r.replicate) for r in rows) == [(n, q, k) for n in "ab" for q in (1.0, 1.5, 2.0) for k in (1, 2)]
    with pytest.raises(ValueError):
        stability.run_matrix({"d": df}, [spec], tiers=[3])
    with pytest.raises(ValueError):
        stability.run_matrix({"d": df}, [spec | {"radius_step": 0.3}])


def test_clusters_of_two_heaps(spark):
    df = spark.createDataFrame([(i, (i % 2) * 50.0 + i / 10, 0.0) for i in range(20)] + [(99, None, 0.0)], "id bigint, x double, y double")
    table = {r.k: r for r in stats.kmeans_benchmark(df, "id", ["x", "y"], [1, 2, 3]).collect()}
    heaps = [[(i % 2) * 50.0 + i / 10 for i in range(20) if i % 2 == s] for s in (0, 1)]
    within = sum(sum((v - sum(h) / 10) ** 2 for v in h) for h in heaps)
    assert table[2].within_ss == pytest.approx(within) and table[2].calinski_harabasz == pytest.approx((table[1].within_ss - within) / (within / 18))
    assert sum(r.chosen for r in table.values()) == 1
    found = stats.kmeans_clusters(df, "id", ["x", "y"], [2])
    assert {r.id: r.cluster for r in found.collect()} == {i: 1 + i % 2 for i in range(20)}
    assert [(r.cluster, r.n) for r in stats.cluster_profiles(found, df, "id", ["x"]).orderBy("cluster").collect()] == [(1, 10), (2, 10)]


def test_marks_of_letters(spark):
    from coverscope.operators import tidy

    df = spark.createDataFrame([("Café Żółć e\u0301 ø",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(C.strip_accents(F.col("t"))).collect()] == ["Cafe Zołc e ø", "", None]
    assert tidy.normalise_names(df.toDF("Café %")).columns == ["cafe"]
    b = spark.createDataFrame([(bytearray("é".encode()),), (bytearray(b"\xe9x"),), (None,)], "b binary")
    assert [r[0] for r in b.select(C.valid_utf8(F.col("b"))).collect()] == [True, False, None]


def test_archive_members_with_line_breaks_in_quotes(spark):
    import io
    import zipfile

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a-lsoa.csv", 'k,t\n1,"two\nlines, ""quoted"""\n\n2,x\n')
    df = spark.createDataFrame([("a.zip", bytearray(data.getvalue()))], "path string, content binary")
    got = files.read_zip_csv(df, "k int, t string", "lsoa").orderBy("k").collect()
    assert [(r.k, r.t) for r in got] == [(1, 'two\nlines, "quoted"'), (2, "x")]


def test_median_unbiased_quantile_with_and_without_groups(spark):
    df = spark.createDataFrame([("g", float(v)) for v in (4, 1, 3, 2, 2)] + [("g", None)], "k string, x double").repartition(3)
    for p, want in ((0.5, 2.0), (0.25, 1.0 + (16 / 3 * 0.25 + 1 / 3 - 1)), (1.0, 4.0), (0.0, 1.0)):
        assert stats.quantile_type8(df, "x", p).first()["quantile"] == pytest.approx(want)
        assert stats.quantile_type8(df, "x", p, ["k"]).first()["quantile"] == pytest.approx(want)


def test_the_nearest_of_a_leaf_are_found_in_little_memory():
    x = np.random.default_rng(3).random((2048, 3))
    tracemalloc.start()
    found = list(near.nearest(x, x, np.arange(2048), 2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [i[0] for _, i in found] == list(range(2048))
    assert peak < 16e6  # four million distances at once before
