"""Distance joins: within a radius, k nearest, facility access, Hausdorff."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverscope.functions.columns import squared
from coverscope.operators.ground import HOME, OTHERS, distances, meet, width
from coverscope.operators.scratch import cut

#: Up to so many centres are sent to all tasks; more go by grid cells.
MAX_BROADCAST = 20_000


def within_radius(points: DataFrame, centres: DataFrame, axes: Sequence[str], centre_axes: Sequence[str], eps: Column, keys: Sequence[str] = (), n_centres: int | None = None, cell: float | None = None) -> DataFrame:
    """points joined with the centres at most eps away (of the same keys). eps: a column of centres or a literal; cell: the largest eps, needed for the grid.

    Few centres (counted, if n_centres doesn't tell) are broadcast; for more, both sides are
    dealt out by grid cells as wide as the radius, every centre to its 3**d cells."""
    near = squared([F.col(a) for a in axes], [F.col(c) for c in centre_axes]) <= eps * eps
    if cell is None or (centres.count() if n_centres is None else n_centres) <= MAX_BROADCAST:
        pairs = points.join(F.broadcast(centres), list(keys)) if keys else points.crossJoin(F.broadcast(centres))
        return pairs.where(near)
    cells = [f"_cell{i}" for i in range(len(axes))]
    p = points.withColumns({c: F.floor(F.col(a) / cell) for c, a in zip(cells, axes, strict=True)})
    q = centres
    for c, a in zip(cells, centre_axes, strict=True):
        own = F.floor(F.col(a) / cell)
        q = q.withColumn(c, F.explode(F.sequence(own - 1, own + 1)))
    return p.join(q, [*keys, *cells]).where(near).drop(*cells)


def pairs_within(points: DataFrame, others: DataFrame, item: str, other: str, xy: Sequence[str], radius: float, sizes: tuple[int, int] = (HOME // 2, OTHERS // 2)) -> DataFrame:
    """item and other of all pairs at most radius apart, for results far larger than both tables.

    Parts of cells meet as in ground.meet and each gives its own pairs, so that the work is dealt out by pairs, not by the few and
    small rows of either side, and no pair is shuffled."""

    def inside(h: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        mine, theirs = h[item].to_numpy(), o[other].to_numpy()
        found = [(mine[at][row], theirs[col]) for at, d2 in distances(h, o, xy) for row, col in [np.nonzero(d2 <= radius * radius)]]
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (mine[:0], theirs[:0])
        return pd.DataFrame({item: a, other: b})

    kind = lambda df, c: f"`{c}` {df.schema[c].dataType.simpleString()}"
    p, q = points.select(item, *xy), others.select(other, *xy)
    return meet(p, q, item, other, xy, radius, width(p, xy, radius / 2), inside, f"{kind(p, item)}, {kind(q, other)}", sizes)


#: Rows that place the cuts between leaves; leaves; points of a leaf, unless the leaves would be too many; queries that are sent to another leaf in one group: at most about so many.
SAMPLE, LEAVES, LEAF, GROUP = 50_000, 4096, 2048, 100_000


def tree(x: np.ndarray, parts: int) -> tuple | int:
    """Nested (axis, cut, left, right): halves of the widest axis, down to about parts leaves; leaves are numbered from 0."""
    number = iter(range(2 * max(parts, 1)))

    def halve(x: np.ndarray, parts: int) -> tuple | int:
        wide = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(1)
        if parts < 2 or not wide.max() > 0:
            return next(number)
        axis = int(wide.argmax())
        values = x[:, axis]
        cut_ = np.partition(values, (len(values) - 1) // 2)[(len(values) - 1) // 2]
        if cut_ == values.max():
            cut_ = values[values < cut_].max()
        return axis, float(cut_), halve(x[values <= cut_], parts // 2), halve(x[values > cut_], parts - parts // 2)

    return halve(x, parts)


def leaf_of(x: np.ndarray, node: tuple | int) -> np.ndarray:
    out, stack = np.zeros(len(x), np.int32), [(node, np.arange(len(x)))]
    while stack:
        node, at = stack.pop()
        if isinstance(node, int):
            out[at] = node
        else:
            left = x[at, node[0]] <= node[1]
            stack += [(node[2], at[left]), (node[3], at[~left])]
    return out


def all_squared(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    d2 = np.zeros((len(q), len(x)))
    for i in range(x.shape[1]):
        d2 += (q[:, i, None] - x[None, :, i]) ** 2
    return d2


def nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, at_once: int = 2**18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query the (squared distances, ids) of its k nearest of x, ties by id."""
    for start in range(0, len(q), step := max(1, at_once // max(1, len(x)))):
        d2 = all_squared(q[start : start + step], x)
        last = np.partition(d2, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(d2), np.inf)
        row, col = np.nonzero(d2 <= last[:, None])
        order = np.lexsort((ids[col], d2[row, col], row))
        row, col = row[order], col[order]
        for r, (a, b) in enumerate(zip(np.searchsorted(row, np.arange(len(d2))), np.searchsorted(row, np.arange(len(d2)), "right"), strict=True)):
            own = col[a : min(b, a + k)]
            yield d2[r, own], ids[own]


def nearest_in(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, part: int = 512) -> list[tuple[np.ndarray, np.ndarray]]:
    """As nearest(), for many points: both sides are cut into parts, and a part's queries meet only the parts that can hold one of their nearest."""
    if len(x) <= 4 * part:
        return list(nearest(q, x, ids, k))
    cuts = tree(x, len(x) // part)
    own, asked = leaf_of(x, cuts), leaf_of(q, cuts)
    order = np.argsort(own, kind="stable")
    names, starts = np.unique(own[order], return_index=True)
    members = np.split(order, starts[1:])
    low, high = np.stack([x[m].min(axis=0) for m in members]), np.stack([x[m].max(axis=0) for m in members])
    out: list = [None] * len(q)
    for leaf in np.unique(asked):
        at = np.flatnonzero(asked == leaf)
        mine = members[int(np.searchsorted(names, leaf))] if leaf in names else order[:0]
        reach = max((d[-1] if len(d) == k else np.inf for d, _ in nearest(q[at], x[mine], ids[mine], k)), default=np.inf) if len(mine) else np.inf
        gap = np.maximum(0, np.maximum(low - q[at].max(axis=0), q[at].min(axis=0) - high))
        found = np.concatenate([members[i] for i in np.flatnonzero((gap**2).sum(axis=1) <= reach)])
        for i, pair in zip(at, nearest(q[at], x[found], ids[found], k), strict=True):
            out[i] = pair
    return out


def knn(df: DataFrame, item: str, axes: Sequence[str], k: int, by: str | None = None, leaf: int = LEAF) -> DataFrame:
    """knn_lists with a row for each neighbour: item, neighbour, distance and rank."""
    rows = knn_lists(df, item, axes, k, by, leaf).select(item, F.posexplode(F.arrays_zip("neighbours", "distances")).alias("rank", "_x"))
    return rows.select(item, F.col("_x.neighbours").alias("neighbour"), F.col("_x.distances").alias("distance"), (F.col("rank") + 1).alias("rank"))


def knn_lists(df: DataFrame, item: str, axes: Sequence[str], k: int, by: str | None = None, leaf: int = LEAF) -> DataFrame:
    """item, neighbours and distances (arrays, the nearest first) of the k nearest other rows of each row (of its class, if by is given); ties by id. Rows with a null axis or class are left out.

    For few axes. Points are dealt into leaves of bounded size by the cuts of a balanced tree, which a bounded
    sample places; a leaf answers its own points, and a point whose k-th neighbour is farther than the border
    of another leaf's box asks there too. Of points at one place only the k + 1 smallest ids can be anyone's
    neighbours, so a crowded place neither fills a leaf nor is searched more than once."""
    spark, keys, axes, most = df.sparkSession, [by] if by else [], list(axes), k + 1
    base = df.select(item, *keys, *[F.col(a).cast("double").alias(a) for a in axes]).dropna(subset=[*keys, *axes])
    crowd = Window.partitionBy(*keys, *axes).orderBy(item)
    few = cut(base.withColumn("_n", F.row_number().over(crowd)).where(F.col("_n") <= most))
    n, n_places = few.agg(F.count("*"), F.count_if(F.col("_n") == 1)).first()
    parts = min(LEAVES, -(-n // leaf))
    kind = few.schema[item].dataType.simpleString()
    named = ", ".join(f"`{c}` {few.schema[c].dataType.simpleString()}" for c in [*keys, item, *axes])
    cuts: tuple | int = 0
    if parts > 1:
        share = few if n <= SAMPLE else few.where(F.pmod(F.xxhash64(item, F.lit("cuts")), F.lit(n)) < SAMPLE)
        cuts = tree(share.select(*axes).toPandas().to_numpy(float), parts)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(_leaf=leaf_of(pdf[axes].to_numpy(float), cuts))

    dealt = cut(few.select(*keys, item, *axes, (F.col("_n") == 1).alias("_asks")).mapInPandas(deal, f"{named}, _asks boolean, _leaf int"))

    def answers(pdf: pd.DataFrame, found: list, **more) -> pd.DataFrame:
        return pd.DataFrame({c: pdf[c] for c in [*keys, item]} | more | {"_d2": [d for d, _ in found], "_ids": [i for _, i in found]})

    def at_home(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf[pdf["_asks"]]
        found = nearest_in(asks[axes].to_numpy(float), pdf[axes].to_numpy(float), pdf[item].to_numpy(), most)
        return answers(asks, found, **{a: asks[a] for a in axes}, _leaf=asks["_leaf"], _reach=[d[-1] if len(d) == most else np.inf for d, _ in found])

    keyed = ", ".join(f"`{c}` {few.schema[c].dataType.simpleString()}" for c in [*keys, item])
    home = cut(dealt.groupBy(*keys, "_leaf").applyInPandas(at_home, f"{named}, _leaf int, _reach double, _d2 array<double>, _ids array<{kind}>"))
    zipped = F.zip_with("_d2", "_ids", lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    found = home.select(*keys, item, *axes, zipped.alias("_found"))
    if parts > 1:
        boxes = dealt.groupBy(*keys, F.col("_leaf").alias("_to")).agg(*[f(a).alias(f"_{side}{i}") for i, a in enumerate(axes) for side, f in (("lo", F.min), ("hi", F.max))])
        gap = F.lit(0.0)
        for i, a in enumerate(axes):
            out = F.greatest(F.col(f"_lo{i}") - F.col(a), F.col(a) - F.col(f"_hi{i}"), F.lit(0.0))
            gap = gap + out * out
        asked = home.select(*keys, item, *axes, "_leaf", "_reach")
        sent = asked.join(boxes, keys) if keys else asked.crossJoin(F.broadcast(boxes))  # LEAVES boxes at most
        sent = cut(sent.where((F.col("_leaf") != F.col("_to")) & (gap <= F.col("_reach"))).select(*keys, item, *axes, "_reach", F.col("_to").alias("_leaf")))
        slices = sent.groupBy(*keys, "_leaf").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("_of"))
        sent = sent.join(F.broadcast(slices), [*keys, "_leaf"]).withColumn("_slice", F.pmod(F.xxhash64(item), F.col("_of")).cast("int")).drop("_of")
        again = slices.select(*keys, "_leaf", F.col("_of").alias("_copies"))
        there = dealt.join(F.broadcast(again), [*keys, "_leaf"]).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1))).drop("_copies", "_asks")

        def abroad(asks: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
            found = nearest_in(asks[axes].to_numpy(float), pdf[axes].to_numpy(float), pdf[item].to_numpy(), most)
            return answers(asks, [(d[d <= r], i[d <= r]) for (d, i), r in zip(found, asks["_reach"], strict=True)])

        groups = [*keys, "_leaf", "_slice"]
        far = sent.groupBy(*groups).cogroup(there.groupBy(*groups)).applyInPandas(abroad, f"{keyed}, _d2 array<double>, _ids array<{kind}>")
        more = far.groupBy(*keys, item).agg(F.flatten(F.collect_list(zipped)).alias("_more"))
        found = found.join(more, [*keys, item], "left").withColumn("_found", F.slice(F.sort_array(F.concat("_found", F.coalesce("_more", F.array().cast(f"array<struct<d:double,i:{kind}>>")))), 1, most)).drop("_more")
    if base.count() > n_places:  # rows at one place share its answer
        found = base.join(found.drop(item), [*keys, *axes])
    others = F.slice(F.filter("_found", lambda x: x["i"] != F.col(item)), 1, k)
    return found.select(item, others.alias("_x")).select(item, F.col("_x.i").alias("neighbours"), F.transform("_x.d", F.sqrt).alias("distances"))


#: Rows of a tile of a vector search, and tiles of queries that are broadcast: at most.
TILE, TILES_SENT = 1024, 32


def tiles(df: DataFrame, item: str, vector: str, size: int = TILE) -> DataFrame:
    """tile, ids and vectors packed as bytes (row by row); about size rows to a tile."""
    kind = df.schema[item].dataType.simpleString()
    rows = df.select(F.col(item).alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    n = max(1, -(-rows.count() // size))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tile": pdf["tile"].iloc[:1], "ids": [pdf["id"].to_numpy()], "data": [np.stack(pdf["v"].to_numpy()).astype(np.float64).tobytes()]})

    return cut(rows.withColumn("tile", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")).groupBy("tile").applyInPandas(pack, f"tile int, ids array<{kind}>, data binary"))


def knn_search(df: DataFrame, queries: DataFrame, item: str, vector: str, k: int) -> DataFrame:
    """query, neighbour, distance and rank of the k rows nearest to each query vector, itself left out; exact, ties by id; null vectors are left out.

    Tiles of queries meet tiles of rows. A matrix product gives squared distances up to rounding; rows that can be
    among the k nearest by them are measured again, coordinate by coordinate. A task keeps k rows for each query of
    a tile over all row tiles that it sees, and a window keeps the k nearest of all."""
    kind = df.schema[item].dataType.simpleString()
    asked, rows = tiles(queries, item, vector), tiles(df, item, vector)
    wanted = asked.withColumnsRenamed({"tile": "_tile", "ids": "_ids", "data": "_data"})
    if asked.count() <= TILES_SENT:
        met = rows.repartition(3 * df.sparkSession.sparkContext.defaultParallelism, "tile").crossJoin(F.broadcast(wanted))
    else:  # a task sees one tile of queries and about 16 of rows
        pairs = rows.crossJoin(wanted)
        met = pairs.repartition("_tile", F.floor(F.col("tile") / 16)).sortWithinPartitions("_tile")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict = {}

        def rows_of(tile: int) -> pd.DataFrame:
            names, d, i = best.pop(tile)
            return pd.DataFrame({"query": np.repeat(names, [len(x) for x in d]), "neighbour": np.concatenate(i), "distance": np.concatenate(d)})

        for pdf in batches:
            for row in pdf.to_dict("records"):
                names, ids = np.asarray(row["_ids"]), np.asarray(row["ids"])
                q, x = (np.frombuffer(row[c]).reshape(len(n), -1) for c, n in (("_data", names), ("data", ids)))
                if row["_tile"] not in best:
                    if len(best) >= TILES_SENT:
                        yield rows_of(next(iter(best)))
                    best[row["_tile"]] = (names, [np.zeros(0)] * len(names), [ids[:0]] * len(names))
                _, d, near = best[row["_tile"]]
                qq, xx = (q * q).sum(axis=1), (x * x).sum(axis=1)
                rough = qq[:, None] + xx[None, :] - 2 * (q @ x.T)
                slack = 1e-12 * x.shape[1] * (qq[:, None] + xx[None, :])
                top = min(k + 1, len(ids)) - 1  # itself may be among them
                last = np.partition(rough + slack, top, axis=1)[:, top]
                for j in range(len(names)):
                    can = np.flatnonzero((rough[j] - slack[j] <= last[j]) & (ids != names[j]))
                    exact = np.concatenate([d[j], np.sqrt(((x[can] - q[j]) ** 2).sum(axis=1))])
                    both = np.concatenate([near[j], ids[can]])
                    order = np.lexsort((both, exact))[:k]
                    d[j], near[j] = exact[order], both[order]
        for tile in list(best):
            yield rows_of(tile)

    found = met.mapInPandas(search, f"query {kind}, neighbour {kind}, distance double")
    ranked = Window.partitionBy("query").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def facility_access(queries: DataFrame, facilities: DataFrame, item: str, facility: str, xy: Sequence[str], thresholds: Sequence[float], scales: Sequence[float], max_radius: float, ks: Sequence[int] = (1, 3, 5), sizes: tuple[int, int] = (HOME, OTHERS)) -> DataFrame:
    """Of each query point: distance to its k-th facility for each of ks, the nearest one's id, counts within thresholds (max_radius at most), and sums of exp(-d / scale) within max_radius.

    Blocks of queries meet blocks of facilities in range and give counts, sums and the nearest few of each query, so no pair is a row."""
    q = queries.select(item, *[F.col(a).alias(f"_q{a}") for a in xy])
    f = facilities.select(facility, *xy)
    qa = [f"_q{a}" for a in xy]
    n = f.count()
    d = F.sqrt(squared([F.col(a) for a in qa], [F.col(a) for a in xy]))

    def ranked(found: DataFrame) -> DataFrame:
        """The first max(ks) facilities of each point as columns; a window keeps no more than that of a point."""
        k = F.row_number().over(Window.partitionBy(item).orderBy("d", facility))
        first = found.withColumn("_k", k).where(F.col("_k") <= max(ks))
        return first.groupBy(item).agg(F.count("*").alias("_n"), F.min(F.when(F.col("_k") == 1, F.col(facility))).alias("nearest_id"), *[F.min(F.when(F.col("_k") == i, F.col("d"))).alias(f"distance_{i}") for i in ks])

    reach, most = float(max_radius), max(ks)
    counted, summed = [f"n_within_{int(t)}" for t in thresholds], [f"access_{int(x)}" for x in scales]

    def within(h: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        o = o.sort_values(facility, ignore_index=True)  # so that the first of equal distances has the smallest id
        ids, rows = o[facility].to_numpy(), []
        for at, d2 in distances(h, o, qa):
            d = np.sqrt(d2)
            near = d <= reach
            one = {c: (near & (d <= t)).sum(axis=1) for c, t in zip(counted, thresholds, strict=True)}
            one |= {c: np.where(near, np.exp(-d / x), 0.0).sum(axis=1) for c, x in zip(summed, scales, strict=True)}
            d = np.where(near, d, np.inf)
            last = np.partition(d, most - 1, axis=1)[:, most - 1] if len(o) > most else np.full(len(d), np.inf)
            row, col = np.nonzero((d <= last[:, None]) & near)
            order = np.lexsort((col, d[row, col], row))
            row, col = row[order], col[order]
            col, dist = np.split(col, cuts := np.searchsorted(row, np.arange(1, len(d)))), np.split(d[row, col], cuts)
            rows.append(pd.DataFrame({item: h[item].to_numpy()[at]} | one | {"_d": [x[:most] for x in dist], "_f": [ids[x[:most]] for x in col]}))
        return pd.concat(rows) if rows else pd.DataFrame(columns=[item, *counted, *summed, "_d", "_f"])

    schema = ", ".join([f"`{item}` {q.schema[item].dataType.simpleString()}", *[f"{c} bigint" for c in counted], *[f"{c} double" for c in summed], "_d array<double>", f"_f array<{f.schema[facility].dataType.simpleString()}>"])
    places = f.withColumnsRenamed(dict(zip(xy, qa, strict=True)))
    met = meet(q, places, item, facility, qa, reach, width(q, qa, reach / 2), within, schema, sizes)
    both = F.zip_with("_d", "_f", lambda d, f: F.struct(d.alias("d"), f.alias("f")))
    first = F.slice(F.sort_array(F.flatten(F.collect_list(both))), 1, most).alias("_first")
    each = cut(met.groupBy(item).agg(*[F.sum(c).alias(c) for c in [*counted, *summed]], first))
    counts = each.select(item, *counted, *summed)
    near = each.select(item, F.size("_first").alias("_n"), F.get("_first", F.lit(0))["f"].alias("nearest_id"), *[F.get("_first", F.lit(i - 1))["d"].alias(f"distance_{i}") for i in ks])
    # points with fewer facilities in range than k look beyond it, in doubled radii if the facilities are many
    short, full = q.join(near.where(F.col("_n") == max(ks)).select(item), item, "left_anti"), near.where(F.col("_n") == max(ks))
    if n <= MAX_BROADCAST:
        far = ranked(short.crossJoin(F.broadcast(f)).select(item, facility, d.alias("d")))
    else:
        reach, far, short = 2.0 * max_radius, None, cut(short)
        wide = f.agg(*[(F.max(a) - F.min(a)).alias(a) for a in xy]).crossJoin(q.agg(*[F.max(F.abs(a)).alias(a) for a in qa])).first()
        end = 2 * float(sum(abs(x or 0) for x in wide)) + max_radius
        while not short.isEmpty():
            got = cut(ranked(within_radius(short, f, qa, xy, F.lit(reach), n_centres=n, cell=reach).select(item, facility, d.alias("d"))))
            done = got if reach >= end else got.where(F.col("_n") == max(ks))
            far = done if far is None else far.unionByName(done)
            short = cut(short.join(done.select(item), item, "left_anti")) if reach < end else short.limit(0)
            reach *= 2
        far = full.limit(0) if far is None else far
    out = q.select(item).join(full.unionByName(far), item, "left").join(counts, item, "left")
    return out.select(
        item,
        "nearest_id",
        *[f"distance_{k}" for k in ks],
        *[F.coalesce(f"n_within_{int(t)}", F.lit(0)).alias(f"n_within_{int(t)}") for t in thresholds],
        *[F.coalesce(f"access_{int(s)}", F.lit(0.0)).alias(f"access_{int(s)}") for s in scales],
    )


def nearest_distance(a: DataFrame, b: DataFrame, item: str, axes: Sequence[str], max_broadcast: int = MAX_BROADCAST, part: int = LEAF) -> DataFrame:
    """item and d, the distance of each row of a to its nearest row of b; rows with a null axis, or all if b is empty, are left out.

    Up to max_broadcast rows of b are broadcast. More are dealt into the leaves of a tree, of about `part` rows, as are the
    places of a, and a leaf of a meets those leaves of b whose boxes can hold a nearest row of any of its places."""
    others = [f"_{x}" for x in axes]
    left = a.select(item, *axes).dropna()
    q = b.select(*[F.col(x).alias(o) for x, o in zip(axes, others, strict=True)]).dropna().distinct()
    d = F.min(F.sqrt(squared([F.col(x) for x in axes], [F.col(o) for o in others]))).alias("d")
    n = q.count()
    if n <= max_broadcast:
        return left.crossJoin(F.broadcast(q)).groupBy(item).agg(d)
    places = left.select(*axes).distinct()
    n_places = places.count()

    def dealt(df: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
        """The rows of df packed by the leaves of a balanced tree, in parts of bounded size, and the boxes of the leaves."""
        share = df if n <= SAMPLE else df.where(F.pmod(F.xxhash64(*df.columns), F.lit(n)) < SAMPLE)
        cuts = tree(share.toPandas().to_numpy(float), min(LEAVES, -(-n // part)))

        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(_leaf=leaf_of(pdf.to_numpy(float), cuts))

        named = ", ".join(f"`{c}` double" for c in df.columns)
        rows = cut(df.select(*[F.col(c).cast("double").alias(c) for c in df.columns]).mapInPandas(deal, f"{named}, _leaf int"))
        boxes = cut(rows.groupBy("_leaf").agg(F.count("*").alias("_n"), *[f(c).alias(f"_{side}{i}") for i, c in enumerate(df.columns) for side, f in (("lo", F.min), ("hi", F.max))]))
        return rows, boxes

    (mine, ours), (theirs, far) = dealt(places, n_places), dealt(q, n)
    far = far.withColumnsRenamed({c: f"_{c}" for c in far.columns})
    least = most = F.lit(0.0)
    for i in range(len(axes)):
        lo, hi, lo2, hi2 = (F.col(c) for c in (f"_lo{i}", f"_hi{i}", f"__lo{i}", f"__hi{i}"))
        gap, span = F.greatest(lo - hi2, lo2 - hi, F.lit(0.0)), F.greatest(hi2 - lo, hi - lo2)
        least, most = least + gap * gap, most + span * span
    both = ours.crossJoin(F.broadcast(far)).select("_leaf", F.col("__leaf").alias("_to"), F.ceil(F.col("_n") / GROUP).cast("int").alias("_of"), F.ceil(F.col("__n") / GROUP).cast("int").alias("_by"), least.alias("_least"), most.alias("_most"))
    bound = both.groupBy("_leaf").agg(F.min("_most").alias("_bound"))  # no place of a leaf has its nearest one farther
    pairs = cut(both.join(F.broadcast(bound), "_leaf").where(F.col("_least") <= F.col("_bound") * (1 + 1e-9)).select("_leaf", "_to", "_of", "_by"))
    piece = lambda n, cs: F.pmod(F.xxhash64(*cs, F.lit("piece")), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = mine.join(pairs, "_leaf").withColumns({"_i": piece("_of", axes), "_j": each("_by")})
    theirs = theirs.withColumnRenamed("_leaf", "_to").join(pairs.toDF(*pairs.columns), "_to").withColumns({"_j": piece("_by", others), "_i": each("_of")})

    def nearest_of(h: pd.DataFrame, o: pd.DataFrame) -> pd.DataFrame:
        found = [np.sqrt(d2.min(axis=1)) for _, d2 in distances(h, o.rename(columns=dict(zip(others, axes, strict=True))), axes)] if len(o) else []
        return h[list(axes)].assign(d=np.concatenate(found)) if found else pd.DataFrame(columns=[*axes, "d"])

    keys = ["_leaf", "_to", "_i", "_j"]
    met = mine.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(nearest_of, ", ".join(f"`{c}` double" for c in axes) + ", d double")
    return left.join(met.groupBy(*axes).agg(F.min("d").alias("d")), list(axes)).select(item, "d")


def directed_hausdorff(a: DataFrame, b: DataFrame, item: str, axes: Sequence[str]) -> DataFrame:
    """One row: the largest distance of a point of a to its nearest point of b."""
    return nearest_distance(a, b, item, axes).agg(F.max("d").alias("hausdorff"))


def diameter(df: DataFrame, axes: Sequence[str], per_axis: int = 8) -> DataFrame:
    """One row, `diameter`: the largest distance of two rows, exact; rows with a null axis are left out, null for no rows, 0 for one.

    Boxes of a coarse grid on up to three axes (per_axis**3 at most) are collected with their
    bounds. Two sweeps to a farthest point give a distance that occurs; only pairs of boxes whose
    farthest corners reach it can hold the largest one, and only their points are compared."""
    points = df.select(*[F.col(a).cast("double").alias(a) for a in axes]).dropna().distinct()
    ends = points.agg(F.count("*").alias("n"), *[f(a).alias(f"{name}_{a}") for a in axes for name, f in (("lo", F.min), ("hi", F.max), ("mid", F.avg))]).first()
    if ends["n"] < 2:
        return df.sparkSession.range(1).select(F.lit(0.0 if ends["n"] else None).cast("double").alias("diameter"))
    at = [ends[f"mid_{a}"] for a in axes]
    for _ in range(2):
        d2 = squared([F.col(a) for a in axes], [F.lit(float(x)) for x in at])
        *at, known = points.agg(F.max_by(F.struct(*axes), d2).alias("p"), F.max(d2).alias("d")).select("p.*", "d").first()
    cell = F.lit(0)
    for a in list(axes)[:3]:
        width = (ends[f"hi_{a}"] - ends[f"lo_{a}"]) / per_axis or 1.0
        cell = cell * per_axis + F.least(F.floor((F.col(a) - ends[f"lo_{a}"]) / width), F.lit(per_axis - 1))
    dealt = points.withColumn("_box", cell)
    boxes = dealt.groupBy("_box").agg(*[f(a).alias(f"{name}_{a}") for a in axes for name, f in (("lo", F.min), ("hi", F.max))]).toPandas()
    lo, hi = boxes[[f"lo_{a}" for a in axes]].to_numpy(), boxes[[f"hi_{a}" for a in axes]].to_numpy()
    reach = sum(np.maximum(hi[:, None, i] - lo[None, :, i], hi[None, :, i] - lo[:, None, i]) ** 2 for i in range(len(axes)))
    x, y = np.nonzero(np.triu(reach >= known * (1 - 1e-9)))
    pairs = df.sparkSession.createDataFrame(pd.DataFrame({"_box": boxes["_box"].to_numpy()[x], "_other": boxes["_box"].to_numpy()[y]}), "_box bigint, _other bigint")
    far = dealt.withColumnsRenamed({a: f"_{a}" for a in axes} | {"_box": "_other"})
    met = dealt.join(F.broadcast(pairs), "_box").join(far, "_other")
    return met.agg(F.sqrt(F.max(squared([F.col(a) for a in axes], [F.col(f"_{a}") for a in axes]))).alias("diameter"))
