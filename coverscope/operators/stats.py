"""Descriptive statistics, association, outliers and regressions, each in a few aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverscope.functions.columns import finite, squared
from coverscope.operators.scale import average_rank, group_quantiles, places
from coverscope.operators.scratch import cut


def long(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "variable", value: str = "value") -> DataFrame:
    """One row for each row and column, values as doubles."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(ids), list(columns), name, value)


def describe_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    rows = long(df, [], columns)
    plain = rows.groupBy("variable").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = group_quantiles(rows, ["variable"], "value", [0.25, 0.5, 0.75], "_q")
    return plain.join(F.broadcast(q), "variable", "left").select("variable", "n", "mean", "sd", "min", *[F.get("_q", F.lit(i)).alias(c) for i, c in enumerate(("p25", "median", "p75"))], "max")


def summary_table(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    """describe_long, with skewness and excess kurtosis (population forms), rounded."""
    shape = long(df, [], columns).groupBy("variable").agg(F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"))
    out = describe_long(df, columns).join(shape, "variable")
    return out.select("variable", "n", *[F.round(c, digits).alias(c) for c in out.columns[2:]])


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(x * w) / F.nullif(F.sum(F.when(x.isNotNull(), w)), F.lit(0.0))


def correlation(x: Column, y: Column) -> Column:
    """Pearson's coefficient of complete pairs; null for fewer than 3 of them or a constant side."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.when(F.count(a) >= 3, F.covar_samp(a, b) / F.nullif(F.stddev_samp(a) * F.stddev_samp(b), F.lit(0.0)))


def spearman(df: DataFrame, x: str, y: str, name: str) -> DataFrame:
    """One row: the correlation of the average ranks of complete pairs."""
    both = df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = average_rank(average_rank(both, x, "_rx"), y, "_ry")
    return ranked.agg(correlation(F.col("_rx"), F.col("_ry")).alias(name))


def corr_matrix(df: DataFrame, columns: Sequence[str], digits: int = 3) -> DataFrame:
    """row, column, value: Pearson below the diagonal, Spearman above it."""
    ranked = df.select(*columns)
    for c in columns:
        ranked = average_rank(ranked, c, f"_r_{c}")
    cells = [(a, b, correlation(F.col(a), F.col(b)) if i > j else correlation(F.col(f"_r_{a}"), F.col(f"_r_{b}"))) for i, a in enumerate(columns) for j, b in enumerate(columns) if i != j]
    one = ranked.agg(*[c.alias(f"{a}|{b}") for a, b, c in cells])
    flat = one.unpivot([], one.columns, "cell", "value")
    return flat.select(F.split_part("cell", F.lit("|"), F.lit(1)).alias("row"), F.split_part("cell", F.lit("|"), F.lit(2)).alias("column"), F.round("value", digits).alias("value"))


def corr_against(df: DataFrame, x: str, columns: Sequence[str]) -> DataFrame:
    one = df.agg(*[correlation(F.col(x), F.col(c)).alias(c) for c in columns])
    return one.unpivot([], list(columns), "variable", "pearson")


def frequency(df: DataFrame, column: str) -> DataFrame:
    """level, n and share; null is a level."""
    counts = df.groupBy(F.col(column).alias("level")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return counts.crossJoin(F.broadcast(total)).select("level", "n", (F.col("n") / F.col("_t")).alias("share"))


def crosstab_long(df: DataFrame, a: str, b: str) -> DataFrame:
    counts = df.groupBy(a, b).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(a)))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, chi2 and v; v is null if a side has fewer than two levels."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy(a).agg(F.sum("o").alias("r")), cells.groupBy(b).agg(F.sum("o").alias("c"))
    total = cells.agg(F.sum("o").alias("n"))
    # the squares over all pairs of levels come to n * (sum of o * o / (r * c) - 1), a sum over those that occur
    share = cells.join(rows, a).join(cols, b).agg(F.sum(F.col("o") * F.col("o") / (F.col("r") * F.col("c"))).alias("s"))
    levels = rows.agg(F.count("*").alias("ka")).crossJoin(cols.agg(F.count("*").alias("kb")))
    one = total.crossJoin(share).crossJoin(levels).select("n", (F.col("n") * (F.col("s") - 1)).alias("chi2"), F.least("ka", "kb").alias("k"))
    return one.select("n", "chi2", F.when(F.col("k") > 1, F.sqrt(F.col("chi2") / (F.col("n") * (F.col("k") - 1)))).alias("v"))


def entropy(df: DataFrame, by: Sequence[str], column: str, normalised: bool = True) -> DataFrame:
    """Shannon entropy of a category in each group, by default over that of the group's number of levels."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("_n"))
    p = F.col("_n") / F.sum("_n").over(Window.partitionBy(*by))
    h = counts.withColumn("_p", p).groupBy(*by).agg(F.sum(-F.col("_p") * F.log("_p")).alias("_h"), F.count("*").alias("levels"))
    value = F.when(F.col("levels") > 1, F.col("_h") / F.log("levels")).otherwise(0.0) if normalised else F.col("_h")
    return h.select(*by, "levels", value.alias("entropy"))


def mode_by(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """The most frequent value of each group, the first by value of equals, with its count and share."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    top = counts.groupBy(*by).agg(F.min_by(F.struct(column, "n"), F.struct(-F.col("n"), column)).alias("_top"), F.sum("n").alias("_total"))
    return top.select(*by, F.col(f"_top.{column}").alias("mode"), F.col("_top.n").alias("n"), (F.col("_top.n") / F.col("_total")).alias("share"))


def total_variation(mix: DataFrame, group: str, level: str, share: str) -> DataFrame:
    """a, b and total_variation of every pair of groups, a < b. mix: share of each level in each group; a missing level has share 0.

    Half the sum of absolute differences is 1 less the sum of the smaller shares: an equi join on the level."""
    left = mix.select(F.col(group).alias("a"), level, F.col(share).alias("_p"))
    right = mix.select(F.col(group).alias("b"), level, F.col(share).alias("_q"))
    common = left.join(right, level).where("a < b").groupBy("a", "b").agg(F.sum(F.least("_p", "_q")).alias("_c"))
    groups = mix.select(group).distinct()
    pairs = groups.withColumnRenamed(group, "a").join(groups.withColumnRenamed(group, "b"), F.col("a") < F.col("b"))
    return pairs.join(common, ["a", "b"], "left").select("a", "b", (1 - F.coalesce("_c", F.lit(0.0))).alias("total_variation"))


def quantile_type8(df: DataFrame, column: str, p: float, by: Sequence[str] = ()) -> DataFrame:
    """The median-unbiased quantile: h = (n + 1/3) p + 1/3, linear between order statistics, counted by value so that equal ones take one row."""
    if by:
        counts = df.where(F.col(column).isNotNull()).groupBy(*by, F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
        w = Window.partitionBy(*by).orderBy("_v")
        ranked = counts.withColumns({"_hi": F.sum("_c").over(w), "_n": F.sum("_c").over(Window.partitionBy(*by))})
    else:
        placed = places(df, column).select("_v", F.col("_upto").alias("_hi"))
        ranked = placed.crossJoin(F.broadcast(placed.agg(F.max("_hi").alias("_n"))))
    h = (F.col("_n") + 1 / 3) * p + 1 / 3
    low = F.least(F.greatest(F.floor(h), F.lit(1)), F.col("_n"))
    high = F.least(low + 1, F.col("_n"))
    at = lambda k: F.min(F.when(F.col("_hi") >= k, F.col("_v")))
    part = F.greatest(F.least(h - F.floor(h), F.lit(1.0)), F.lit(0.0))
    part = F.when((h < 1) | (h >= F.col("_n")), 0.0).otherwise(part)
    out = ranked.withColumns({"_l": low, "_h": high, "_f": part}).groupBy(*by).agg(at(F.col("_l")).alias("_a"), at(F.col("_h")).alias("_b"), F.max("_f").alias("_f"))
    return out.select(*by, (F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a"))).alias("quantile"))


def outliers(df: DataFrame, item: str, columns: Sequence[str], method: str = "mad", threshold: float = 3.5) -> DataFrame:
    """id, variable, value, centre, scale, lower, upper, score, flag and status. A MAD score is flagged from the threshold on, an IQR value strictly outside."""
    rows = long(df, [item], columns).withColumn("value", finite(F.col("value")))
    if method == "mad":
        med = group_quantiles(rows, ["variable"], "value", [0.5], "_q").select("variable", F.get("_q", F.lit(0)).alias("centre"))
        off = rows.join(F.broadcast(med), "variable")
        scale = group_quantiles(off.withColumn("_off", F.abs(F.col("value") - F.col("centre"))), ["variable"], "_off", [0.5], "_q").select("variable", (1.4826 * F.get("_q", F.lit(0))).alias("scale"))
        out = off.join(F.broadcast(scale), "variable").withColumns({"lower": F.col("centre") - threshold * F.col("scale"), "upper": F.col("centre") + threshold * F.col("scale")})
        score = F.abs(F.col("value") - F.col("centre")) / F.nullif(F.col("scale"), F.lit(0.0))
        flag, zero = score >= threshold, "zero_robust_scale"
    else:
        q = group_quantiles(rows, ["variable"], "value", [0.25, 0.5, 0.75], "_q")
        out = rows.join(F.broadcast(q), "variable").withColumns({"centre": F.col("_q")[1], "scale": F.col("_q")[2] - F.col("_q")[0]})
        out = out.withColumns({"lower": F.col("_q")[0] - threshold * F.col("scale"), "upper": F.col("_q")[2] + threshold * F.col("scale")})
        score = F.greatest(F.col("lower") - F.col("value"), F.col("value") - F.col("upper"), F.lit(0.0)) / F.nullif(F.col("scale"), F.lit(0.0))
        flag, zero = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")), "zero_iqr"
    usable = F.col("value").isNotNull() & (F.col("scale") > 0)
    status = F.when(F.col("value").isNull(), "missing_or_non_finite").when(F.col("scale") == 0, zero).otherwise("analysed")
    return out.select(item, "variable", "value", "centre", "scale", "lower", "upper", F.when(usable, score).alias("score"), F.coalesce(usable & flag, F.lit(False)).alias("flag"), status.alias("status"))


def outlier_audit(rows: DataFrame) -> DataFrame:
    return rows.groupBy("variable").agg(F.count("*").alias("n"), F.sum(F.when(F.col("status") == "analysed", 1).otherwise(0)).alias("n_analysed"), F.sum(F.col("flag").cast("int")).alias("n_flagged"), F.max("score").alias("max_score"))


def outlier_units(rows: DataFrame, item: str) -> DataFrame:
    """Of each unit with a flag: how many, the largest score, and which variables."""
    flagged = rows.where("flag")
    return flagged.groupBy(item).agg(F.count("*").alias("n_flags"), F.max("score").alias("max_score"), F.array_join(F.array_sort(F.collect_set("variable")), ", ").alias("variables"))


def compare_vectors(df: DataFrame, a: str, b: str, by: Sequence[str] = ()) -> DataFrame:
    d = F.col(a) - F.col(b)
    return df.groupBy(*by).agg(F.count(d).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), correlation(F.col(a), F.col(b)).alias("pearson"))


def duplicate_column_audit(df: DataFrame, pairs: Sequence[tuple[str, str]], tolerance: float = 1e-12) -> DataFrame:
    """a, b, n_complete, n_equal, share_equal and pearson of each pair of columns, in one pass."""
    found = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        found += [F.count(F.when(both, 1)).alias(f"n{i}"), F.count(F.when(both & (F.abs(F.col(a) - F.col(b)) < tolerance), 1)).alias(f"e{i}"), correlation(F.col(a), F.col(b)).alias(f"c{i}")]
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"n{i}").alias("n_complete"), F.col(f"e{i}").alias("n_equal"), F.col(f"c{i}").alias("pearson")) for i, (a, b) in enumerate(pairs)])
    return df.agg(*found).select(F.inline(rows)).withColumn("share_equal", F.col("n_equal") / F.nullif(F.col("n_complete"), F.lit(0)))


def dispersion_ratio(df: DataFrame, group: str, measures: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """The mean of the groups' deviations over the overall one, for each measure (and each class of `within`)."""
    rows = long(df, [*within, group], measures)
    inner = rows.groupBy(*within, "variable", group).agg(F.stddev_samp("value").alias("_sd")).groupBy(*within, "variable").agg(F.avg("_sd").alias("within_sd"))
    outer = rows.groupBy(*within, "variable").agg(F.stddev_samp("value").alias("overall_sd"))
    return inner.join(outer, [*within, "variable"]).withColumn("ratio", F.col("within_sd") / F.nullif(F.col("overall_sd"), F.lit(0.0)))


def discordance(df: DataFrame, flag: str, distance: str, thresholds: Sequence[float]) -> DataFrame:
    """For each threshold: flagged rows beyond it and others within it, with shares of their groups."""
    found = []
    for t in thresholds:
        on, off = F.col(flag), ~F.col(flag)
        found.append(F.struct(F.lit(float(t)).alias("threshold"), F.count_if(on).alias("n_flagged"), F.count_if(on & (F.col(distance) > t)).alias("n_flagged_far"), F.count_if(off).alias("n_other"), F.count_if(off & (F.col(distance) <= t)).alias("n_other_near")))
    out = df.agg(F.array(*found).alias("_r")).select(F.inline("_r"))
    return out.withColumns({"share_flagged_far": F.col("n_flagged_far") / F.nullif(F.col("n_flagged"), F.lit(0)), "share_other_near": F.col("n_other_near") / F.nullif(F.col("n_other"), F.lit(0))})


def flag_summary(df: DataFrame, flags: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """n and the means of the measures under each flag; a flag that nothing has gets n 0 and null means."""
    found = [F.struct(F.lit(f).alias("flag"), F.count_if(F.col(f)).alias("n"), *[F.avg(F.when(F.col(f), F.col(m))).alias(f"mean_{m}") for m in measures]) for f in flags]
    return df.agg(F.array(*found).alias("_r")).select(F.inline("_r"))


def with_weighted_total(rows: DataFrame, label: str, weight: str, measures: Sequence[str], name: str = "ALL") -> DataFrame:
    total = rows.agg(F.lit(name).alias(label), F.sum(weight).alias(weight), *[weighted_mean(F.col(m), F.col(weight)).alias(m) for m in measures])
    return rows.select(F.col(label).cast("string").alias(label), weight, *measures).unionByName(total)


def partitions_equivalent(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: whether two category columns are one to one, nulls together with nulls."""
    pairs = df.select(a, b).distinct()
    na, nb = F.count("*").over(Window.partitionBy(a)), F.count("*").over(Window.partitionBy(b))
    mixed = F.col(a).isNull() != F.col(b).isNull()
    return pairs.select(na.alias("_a"), nb.alias("_b"), mixed.alias("_m")).agg(F.coalesce((F.max("_a") == 1) & (F.max("_b") == 1) & ~F.max("_m"), F.lit(True)).alias("equivalent"), F.count("*").alias("n_pairs"))


def ols(df: DataFrame, y: str, terms: dict[str, Column]) -> DataFrame:
    """term, coefficient, std_error, with r2, adj_r2 and aic of the fit. The normal equations come from one aggregate of (terms + 1)**2 sums; the driver solves them."""
    x = [F.lit(1.0), *terms.values()]
    names = ["intercept", *terms]
    cols = [c.cast("double") for c in [*x, F.col(y)]]
    base = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).dropna()
    k = len(cols)
    sums = base.agg(*[F.sum(F.col(f"c{i}") * F.col(f"c{j}")) for i in range(k) for j in range(i, k)]).first()
    m = np.zeros((k, k))
    m[np.triu_indices(k)] = [float(v or 0) for v in sums]
    m = m + np.triu(m, 1).T
    p, n = k - 1, m[0, 0]
    inverse = np.linalg.pinv(m[:p, :p])
    beta = inverse @ m[:p, p]
    rss, tss = m[p, p] - beta @ m[:p, p], m[p, p] - m[0, p] ** 2 / n
    r2, s2 = 1 - rss / tss, rss / (n - p)
    adj, aic = 1 - (1 - r2) * (n - 1) / (n - p), n * (np.log(2 * np.pi * rss / n) + 1) + 2 * (p + 1)
    se = np.sqrt(np.maximum(np.diag(inverse) * s2, 0))
    return df.sparkSession.createDataFrame([(t, float(b), float(e), float(r2), float(adj), float(aic)) for t, b, e in zip(names, beta, se, strict=True)], "term string, coefficient double, std_error double, r2 double, adj_r2 double, aic double")


def seeds(points: DataFrame, item: str, axes: Sequence[str], k: int, starts: Sequence[int], seed: int) -> dict[int, list[tuple]]:
    """For each start the first k centres: each next one is drawn with a chance that grows as its squared distance to those before it.

    The draw is a race of exponential clocks set by a hash of the id, so it doesn't depend on the order of rows; all starts share a pass for each centre."""
    centres: dict[int, list[tuple]] = {s: [] for s in starts}
    for turn in range(k):
        race = []
        for s in starts:
            share = (F.conv(F.substring(F.md5(F.concat_ws(":", F.col(item).cast("string"), F.lit(f"{seed}:{s}:{turn}"))), 1, 13), 16, 10).cast("double") + 0.5) / 16.0**13
            near = F.least(*[squared([F.col(a) for a in axes], [F.lit(x) for x in c]) for c in centres[s]], F.lit(float("inf"))) if centres[s] else F.lit(1.0)
            race.append(F.min_by(F.struct(*axes), F.when(near > 0, F.struct(-F.log(share) / near, item))).alias(f"s{s}"))
        row = points.agg(*race).first()
        for s in starts:
            if row[f"s{s}"] is not None:  # else fewer places than centres
                centres[s].append(tuple(row[f"s{s}"]))
    return centres


#: Points that are compared with the centres at once, so that what is computed of them stays in a core's cache.
NEAR_AT_ONCE = 8192


def packed_points(points: DataFrame, axes: Sequence[str]) -> DataFrame:
    """data: the axes of about 10,000 points in one row, axis by axis, as rounds read them again and again."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch({"data": pa.array([np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns]).astype(np.float64).tobytes()], pa.binary())})

    return points.select(*[F.col(a).cast("double").alias(a) for a in axes]).mapInArrow(pack, "data binary")


def lloyd_step(points: DataFrame, axes: Sequence[str], centres: dict[tuple, np.ndarray]) -> DataFrame:
    """config (its place in centres), cluster, n, within_ss and the sum of each axis, for all configurations at once; a point goes to its nearest centre, the first of equals."""
    return packed_step(packed_points(points, axes), axes, centres)


def packed_step(packed: DataFrame, axes: Sequence[str], centres: dict[tuple, np.ndarray]) -> DataFrame:
    """lloyd_step of packed_points. A task adds up its own points, so what moves is a row for each task, configuration and cluster."""
    known, axes = list(centres.values()), list(axes)

    def own(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each point: its nearest centre and the squared distance to it."""
        to, least = np.zeros(x.shape[1], np.int64), np.full(x.shape[1], np.inf)
        for j, centre in enumerate(c):
            d2 = np.zeros(x.shape[1])
            for column, at in zip(x, centre, strict=True):
                apart = column - at
                d2 += apart * apart
            to[d2 < least] = j
            np.minimum(least, d2, out=least)
        return to, least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((len(c), 2 + len(axes))) for c in known]
        for b in batches:
            for row in b.column("data"):
                whole = np.frombuffer(row.as_buffer()).reshape(len(axes), -1)
                for start in range(0, whole.shape[1], NEAR_AT_ONCE):
                    x = whole[:, start : start + NEAR_AT_ONCE]
                    for c, t in zip(known, total, strict=True):
                        to, least = own(x, c)
                        for column, weight in enumerate((None, least, *x)):
                            t[:, column] += np.bincount(to, weight, minlength=len(c))
        rows = np.concatenate(total)
        config, cluster = (np.concatenate(v).astype(np.int32) for v in ([np.full(len(c), i) for i, c in enumerate(known)], [np.arange(len(c)) for c in known]))
        yield pa.record_batch({"config": config, "cluster": cluster, "n": rows[:, 0].astype(np.int64), "within_ss": rows[:, 1].copy()} | {a: rows[:, 2 + i].copy() for i, a in enumerate(axes)})

    sums = packed.mapInArrow(run, "config int, cluster int, n bigint, within_ss double, " + ", ".join(f"`{a}` double" for a in axes))
    return sums.groupBy("config", "cluster").agg(F.sum("n").alias("n"), F.sum("within_ss").alias("within_ss"), *[F.sum(a).alias(a) for a in axes])


def lloyd(df: DataFrame, item: str, axes: Sequence[str], ks: Sequence[int], starts: int = 3, seed: int = 7, rounds: int = 50) -> dict[int, tuple[float, np.ndarray, list[int]]]:
    """For each k the best of several starts: (within-cluster sum of squares, centres, sizes). All k and starts advance together, a job for each round.

    The driver holds the centres alone (the sum of ks x starts rows). Clusters that lose all points keep their centre."""
    points = cut(df.select(item, *[F.col(a).cast("double").alias(a) for a in axes]).dropna())
    first = seeds(points, item, list(axes), max(ks), range(starts), seed)
    packed = cut(packed_points(points, axes))
    centres = {(k, s): np.array(c[:k], float) for k in ks for s, c in first.items() if c}
    moving, sizes, within = set(centres), {}, {}
    for _ in range(rounds + 1):
        part = {key: centres[key] for key in centres if key in moving}
        names, new = list(part), {key: (c.copy(), np.zeros(len(c)), np.zeros(len(c), int)) for key, c in part.items()}
        for r in packed_step(packed, axes, part).collect():
            c, ss, n = new[names[r["config"]]]
            ss[r["cluster"]], n[r["cluster"]] = r["within_ss"], r["n"]
            if r["n"]:
                c[r["cluster"]] = [r[a] / r["n"] for a in axes]
        for key, (c, ss, n) in new.items():
            within[key], sizes[key] = float(ss.sum()), [int(x) for x in n]
            if np.allclose(c, centres[key], rtol=0, atol=1e-12):
                moving.discard(key)
            else:
                centres[key] = c
        if not moving:
            break
    best = {k: min((key for key in centres if key[0] == k), key=lambda key: (round(within[key], 9), key[1]), default=None) for k in ks}
    return {k: (within[key], centres[key], sizes[key]) for k, key in best.items() if key is not None}


def kmeans_benchmark(df: DataFrame, item: str, axes: Sequence[str], ks: Sequence[int], seed: int = 7) -> DataFrame:
    """k, within_ss, total_ss, between_share, calinski_harabasz, smallest and largest cluster for each k (1: total alone), and chosen for the k of the largest index (the least of equals). Rows with a null axis are left out."""
    return _benchmark(df, axes, lloyd(df, item, axes, ks, seed=seed))


def _benchmark(df: DataFrame, axes: Sequence[str], found: dict) -> DataFrame:
    base = df.select(*[F.col(a).cast("double").alias(a) for a in axes]).dropna()
    n, total = base.agg(F.count("*"), sum((F.var_pop(a) for a in axes), F.lit(0.0))).first()
    rows = []
    for k, (within, _, sizes) in sorted(found.items()):
        index = None if k == 1 or within == 0 else ((n * total - within) / (k - 1)) / (within / (n - k))
        rows.append((k, within, n * total, 1 - within / (n * total) if total else 0.0, index, min(sizes), max(sizes)))
    best = min((r for r in rows if r[4] is not None), key=lambda r: (-r[4], r[0]), default=(None,))[0]
    return df.sparkSession.createDataFrame([(*r, r[0] == best) for r in rows], "k int, within_ss double, total_ss double, between_share double, calinski_harabasz double, smallest bigint, largest bigint, chosen boolean")


def kmeans_clusters(df: DataFrame, item: str, axes: Sequence[str], ks: Sequence[int], seed: int = 7) -> DataFrame:
    """item and cluster (from 1, by the first centre coordinate) under the k that kmeans_benchmark chooses."""
    found = lloyd(df, item, axes, ks, seed=seed)
    k = _benchmark(df, axes, found).where("chosen").first()["k"]
    centres = sorted(map(tuple, found[k][1]))
    base = df.select(item, *[F.col(a).cast("double").alias(a) for a in axes]).dropna()
    near = F.array_min(F.array(*[F.struct(squared([F.col(a) for a in axes], [F.lit(float(x)) for x in c]).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres, 1)]))
    return base.select(item, near["i"].alias("cluster"))


def cluster_profiles(clusters: DataFrame, df: DataFrame, item: str, columns: Sequence[str]) -> DataFrame:
    """cluster, n and the mean of each column."""
    return clusters.join(df.select(item, *columns), item).groupBy("cluster").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])
