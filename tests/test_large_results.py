"""Results that grow with the square of a table: nothing of that size is shuffled."""

import numpy as np
from pyspark.sql import functions as F

from coverscope.operators import near
from coverscope.plans import covers


def test_comembership_unfolds_pairs_once_without_a_shuffle(spark):
    rng = np.random.default_rng(3)
    balls = [[b for b in range(1, 5) if rng.random() < 0.4] for _ in range(80)]
    balls[40:60] = [[1, 2]] * 20  # alike in two balls: more than a pack
    membership = spark.createDataFrame([(b, u) for u, own in enumerate(balls) for b in own], "ball_id bigint, unit bigint")
    got = covers.comembership(membership, covers.F.col("id1") % 4 == 0, pack=3, meeting=2)
    want = sorted((u, v) for u in range(0, 80, 4) for v in range(u + 1, 80) if set(balls[u]) & set(balls[v]))
    assert sorted(map(tuple, got.collect())) == want
    top = got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Generate" in top and "Aggregate" not in top  # no distinct over the pairs


def test_comembership_lies_in_files_of_a_fifth_of_a_byte_a_pair(spark, tmp_path):
    membership = spark.range(20_000).select((F.col("id") % 3).alias("ball_id"), F.col("id").alias("unit"))
    membership = membership.union(spark.range(0, 20_000, 2).select(F.lit(3), "id"))
    covers.comembership(membership, F.col("id1") % 20 == 0).write.option("compression", "snappy").parquet(f"{tmp_path}/pairs")
    n = spark.read.parquet(f"{tmp_path}/pairs").count()
    assert n > 4_000_000
    assert sum(x.stat().st_size for x in tmp_path.rglob("*.parquet") if x.is_file()) < 0.25 * n


def test_pairs_within_a_radius_come_part_by_part(spark):
    rng = np.random.default_rng(5)
    x, y = (rng.integers(-20, 20, size=(n, 2)) * 1.0 for n in (60, 50))
    y[:20] = y[0]  # a crowded place: more than a part
    side = lambda z, name: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(z)] + [(99, None, 1.0)], f"{name} bigint, x double, y double")
    got = near.pairs_within(side(x, "id"), side(y, "fid"), "id", "fid", ["x", "y"], 5.0, sizes=(4, 7))
    i, j = np.nonzero(((x[:, None] - y[None]) ** 2).sum(axis=2) <= 25)  # some lie exactly 5 apart
    assert sorted(map(tuple, got.collect())) == list(zip(i.tolist(), j.tolist(), strict=True))


def test_a_round_of_k_means_reads_packed_points_in_parts(spark, monkeypatch):
    from coverscope.operators import stats

    monkeypatch.setattr(stats, "NEAR_AT_ONCE", 7)
    x = np.random.default_rng(6).integers(0, 9, size=(50, 2)) * 1.0
    packed = stats.packed_points(spark.createDataFrame(x.tolist(), "x double, y double"), ["x", "y"])
    assert packed.count() < 50
    centres = {(k, 0): x[:k] + 0.5 for k in (1, 3)}
    got = {(r.config, r.cluster): (r.n, r.within_ss, r.x, r.y) for r in stats.packed_step(packed, ["x", "y"], centres).collect()}
    for i, c in enumerate(centres.values()):
        d2 = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own = d2.argmin(axis=1)  # lattice points: some are as near to two centres, and the first one has them
        for j in range(len(c)):
            mine = own == j
            assert np.allclose(got[i, j], (mine.sum(), d2[mine, j].sum(), *x[mine].sum(axis=0)))


def test_shared_neighbours_are_counted_from_lists(spark):
    from coverscope.operators import joins, scale

    a = spark.createDataFrame([(1, [7, 8, 9]), (2, [8, 7, 1]), (3, []), (4, [5, 6, 7])], "id bigint, neighbours array<bigint>")
    b = spark.createDataFrame([(1, [9, 7, 8]), (2, [8, 1, 7]), (3, [1]), (4, [1, 2, 3])], "id bigint, neighbours array<bigint>")
    shared = joins.knn_shared(a, b, "id", [1, 2, 3])
    assert {r.id: r.s for r in shared.collect()} == {1: [0, 1, 3], 2: [1, 1, 3], 3: [0, 0, 0], 4: [0, 0, 0]}
    got = {r.k: (r.mean_shared, r.zero_share) for r in joins.shared_counts(shared, [1, 2, 3]).groupBy("k").agg(*joins.overlap()).collect()}
    assert got == {1: (0.25, 0.75), 2: (0.5, 0.5), 3: (1.5, 0.5)}
    plan = joins.knn_shared(a, b, "id", [3])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no row for a neighbour
    values = {1: [1.0] * 9 + [5.0], 2: [3.0, 1.0, 2.0, 900.0], 3: [2.0], 4: [0.0, 1000.0]}
    rows = spark.createDataFrame([(k, v) for k, vs in values.items() for v in [*vs, None]], "k int, v double")
    assert {r.k: r["median"] for r in scale.bracketed_medians(rows, "k", "v", 8).collect()} == {k: float(np.median(vs)) for k, vs in values.items()}
