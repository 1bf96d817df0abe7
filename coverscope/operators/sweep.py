"""Covers of one table for many radii and orders at once, without a copy of the points for each.

Points are dealt into blocks of bounded size, each packed into one row; configurations into
chunks (one order and some radii). Every chunk meets every block, the work that the question
asks for. A round goes like this: the task of a chunk and a block names, for each open
configuration, the first `head` points of the block that no landmark covers yet; these meet by
configuration and are walked in order, as far as every block has named its own. A
configuration whose blocks have named all that they had is complete. `head` grows fourfold
with each round, so the number of rounds grows with the logarithm of the points left over.

What moves is blocks and landmarks, never a row for each point and configuration; no task
holds more than a block, the landmarks of a chunk, or the named points of one configuration.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coverscope.operators.bins import canonical_order
from coverscope.operators.scratch import cut

KEYS = ["radius", "replicate"]
#: Points of a block; radii of a chunk; points of a configuration that are walked in one round; blocks that are broadcast: each at most.
BLOCK, RADII, WALK, SENT = 4096, 16, 65_536, 64


def blocks(points: DataFrame, axes: Sequence[str], item: str, size: int = BLOCK) -> DataFrame:
    """block, ids and one array for each axis (_a0, _a1 ...), blocks of about size points."""
    n = max(1, -(-points.count() // size))
    dealt = points.select(F.col(item).alias("_id"), *[F.col(a).cast("double").alias(f"_a{i}") for i, a in enumerate(axes)])
    rows = dealt.groupBy(F.pmod(F.xxhash64("_id"), F.lit(n)).alias("block")).agg(F.collect_list("_id").alias("ids"), *[F.collect_list(f"_a{i}").alias(f"_a{i}") for i in range(len(axes))])
    return cut(rows if n <= SENT else rows.repartition(8 * points.sparkSession.sparkContext.defaultParallelism, "block"))


def chunks(spark, radii: Sequence[float], replicates: Sequence[int], size: int = RADII, n_blocks: int = 1) -> DataFrame:
    """chunk, replicate and radii (an array, size of them at most) of all configurations; chunks are smaller where they and the blocks would make few tasks."""
    radii = [float(r) for r in radii]
    size = max(1, min(size, n_blocks * len(radii) * len(replicates) // (4 * spark.sparkContext.defaultParallelism)))
    rows = [(int(k), radii[i : i + size]) for k in replicates for i in range(0, len(radii), size)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "chunk int, replicate int, radii array<double>")


def met_with(work: DataFrame, dealt: DataFrame) -> DataFrame:
    """Each chunk with each block, dealt out evenly. Up to SENT blocks are broadcast; many stay where they are, and the chunks with their landmarks go to them."""
    n = dealt.count()
    if n > SENT:
        return dealt.crossJoin(F.broadcast(work))
    return work.crossJoin(F.broadcast(dealt)).repartition(3 * work.sparkSession.sparkContext.defaultParallelism, "chunk", "block")


def near(x: Sequence[np.ndarray], y: Sequence[float], radius: float) -> np.ndarray:
    """Which of the points (a column for each axis) lie at most radius from y."""
    d2 = np.zeros(len(x[0]))
    for column, at in zip(x, y, strict=True):
        d2 += (column - at) ** 2
    return d2 <= radius * radius


def order_of(ids: Sequence, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """MD5 of 'id:seed' as two numbers that sort like it."""
    digests = b"".join(hashlib.md5(f"{i}:{seed}".encode()).digest() for i in ids)
    both = np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64) ^ np.uint64(1 << 63)
    return both[:, 0].view(np.int64).copy(), both[:, 1].view(np.int64).copy()


def packed(balls: DataFrame, d: int) -> DataFrame:
    """chunk and the landmarks of its configurations as arrays: which configuration, which ball, where."""
    return balls.groupBy("chunk").agg(F.collect_list("c").alias("_c"), F.collect_list("ball").alias("_ball"), F.collect_list("landmark").alias("_landmark"), *[F.collect_list(f"_a{i}").alias(f"_l{i}") for i in range(d)])


def landmarks(dealt: DataFrame, work: DataFrame, d: int, seed: int, step: int, head: int = 256) -> DataFrame:
    """chunk, c (place of the radius in the chunk), ball (from 1), landmark and its axes _a0, _a1 ... dealt: as blocks() gives it, work: as chunks()."""
    kind = dealt.schema["ids"].dataType.elementType.simpleString()
    columns = [f"_a{i}" for i in range(d)]
    at = ", ".join(f"{a} double" for a in columns)
    n_blocks = dealt.count()

    def name(first: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    ids = np.asarray(row["ids"])
                    hi, lo = order_of(ids, seed + step * row["replicate"])
                    order = np.lexsort((ids, lo, hi))
                    x = [np.asarray(row[a])[order] for a in columns]
                    for c in row["open"]:
                        radius, found, rest = row["radii"][c], np.arange(len(ids)), x
                        if row["_c"] is not None:
                            for i in np.flatnonzero(np.asarray(row["_c"]) == c):
                                if not len(found):
                                    break
                                far = ~near(rest, [row[f"_l{j}"][i] for j in range(d)], radius)
                                found, rest = found[far], [v[far] for v in rest]
                        own = order[found[:first]]
                        yield pd.DataFrame({"chunk": row["chunk"], "c": c, "block": row["block"], "radius": radius, "more": len(found) > first, "hi": hi[own], "lo": lo[own], "id": ids[own]} | {a: v[found[:first]] for a, v in zip(columns, x, strict=True)})

        return run

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["hi", "lo", "id"], ignore_index=True)
        more = pdf[pdf["more"]]
        end = int(more.reset_index().groupby("block")["index"].max().min()) + 1 if len(more) else len(pdf)
        x, radius = [pdf[a].to_numpy()[:end] for a in columns], pdf["radius"].iloc[0]
        free, own = np.ones(end, bool), []
        for i in range(end):
            if free[i]:
                own.append(i)
                free &= ~near(x, [v[i] for v in x], radius)
        out = pdf.iloc[own]
        return pd.DataFrame({"chunk": out["chunk"], "c": out["c"], "landmark": out["id"], "hi": out["hi"], "lo": out["lo"], "open": len(more) > 0} | {a: out[a] for a in columns})

    found, opened = None, work.withColumn("open", F.sequence(F.lit(0), F.size("radii") - 1))
    rank = "hi bigint, lo bigint"
    while True:
        if found is None:
            known = opened.select("*", F.lit(None).cast("array<int>").alias("_c"), *[F.lit(None).cast("array<double>").alias(f"_l{i}") for i in range(d)])
        else:
            known = opened.join(found.groupBy("chunk").agg(F.collect_list("c").alias("_c"), *[F.collect_list(a).alias(f"_l{i}") for i, a in enumerate(columns)]), "chunk", "left")
        first = max(64, min(head, WALK // n_blocks))
        named = met_with(known, dealt).mapInPandas(name(first), f"chunk int, c int, block bigint, radius double, more boolean, {rank}, id {kind}, {at}")
        new = cut(named.groupBy("chunk", "c").applyInPandas(walk, f"chunk int, c int, landmark {kind}, {rank}, open boolean, {at}"))
        found = new if found is None else found.unionByName(new)
        left = cut(new.where("open").groupBy("chunk").agg(F.sort_array(F.collect_set("c")).alias("open")))
        if left.isEmpty():
            break
        opened, head = work.join(left, "chunk"), head * 4
    return found.withColumn("ball", F.row_number().over(Window.partitionBy("chunk", "c").orderBy("hi", "lo", "landmark")).cast("bigint")).drop("hi", "lo", "open")


def met(row: dict, columns: Sequence[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each configuration of a chunk and block: its place, and the ball and point of each membership, sorted by point."""
    x = [np.asarray(row[a]) for a in columns]
    which, ball = np.asarray(row["_c"]), np.asarray(row["_ball"])
    for c in np.unique(which):
        units, balls = [], []
        for i in np.flatnonzero(which == c):
            inside = np.flatnonzero(near(x, [row[f"_l{j}"][i] for j in range(len(columns))], row["radii"][c]))
            units.append(inside)
            balls.append(np.full(len(inside), ball[i]))
        units, balls = np.concatenate(units), np.concatenate(balls)
        order = np.lexsort((balls, units))
        yield int(c), balls[order], units[order]


def members(dealt: DataFrame, work: DataFrame, balls: DataFrame, d: int) -> DataFrame:
    """radius, replicate, ball_id, landmark and unit of all memberships."""
    kind, columns = dealt.schema["ids"].dataType.elementType.simpleString(), [f"_a{i}" for i in range(d)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                ids, names = np.asarray(row["ids"]), {(c, b): i for c, b, i in zip(row["_c"], row["_ball"], row["_landmark"], strict=True)}
                for c, ball, unit in met(row, columns):
                    yield pd.DataFrame({"radius": row["radii"][c], "replicate": row["replicate"], "ball_id": ball, "landmark": [names[c, b] for b in ball], "unit": ids[unit]})

    return met_with(work.join(packed(balls, d), "chunk"), dealt).mapInPandas(run, f"radius double, replicate int, ball_id bigint, landmark {kind}, unit {kind}")


def counted(dealt: DataFrame, work: DataFrame, balls: DataFrame, d: int, sizes: bool = False) -> DataFrame:
    """Sizes of balls alone, or all of: radius, replicate, kind, a, b and n, added up by each task before the shuffle: the size of ball a ('ball'), the units that a and b share ('edge'), the units in a balls ('units')."""
    columns = [f"_a{i}" for i in range(d)]

    def table(c: int, kind: str, codes: np.ndarray, width: int, row: dict) -> pd.DataFrame:
        value, n = np.unique(codes, return_counts=True)
        return pd.DataFrame({"radius": row["radii"][c], "replicate": row["replicate"], "kind": kind, "a": value // width, "b": value % width, "n": n})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                width = int(max(row["_ball"])) + 1
                for c, ball, unit in met(row, columns):
                    yield table(c, "ball", ball * width, width, row)
                    if sizes:
                        continue
                    own = np.bincount(unit, minlength=len(row["ids"]))
                    yield table(c, "units", own * width, width, row)
                    pairs = []
                    for apart in range(1, int(own.max(initial=0))):  # a point's balls stand side by side
                        same = unit[apart:] == unit[:-apart]
                        pairs.append(ball[:-apart][same] * width + ball[apart:][same])
                    if pairs:
                        yield table(c, "edge", np.concatenate(pairs), width, row)

    rows = met_with(work.join(packed(balls, d), "chunk"), dealt).mapInPandas(run, "radius double, replicate int, kind string, a bigint, b bigint, n bigint")
    return rows.groupBy(*KEYS, "kind", "a", "b").agg(F.sum("n").alias("n"))


def pair_bits(dealt: DataFrame, work: DataFrame, balls: DataFrame, d: int) -> DataFrame:
    """radius, replicate, bucket (0) and bitmap: a bit for each pair of the points of one block, set if the two share a ball."""
    columns = [f"_a{i}" for i in range(d)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                upper = np.triu_indices(len(row["ids"]), 1)
                for c, ball, unit in met(row, columns):
                    inside = np.zeros((int(ball.max(initial=0)) + 1, len(row["ids"])), np.float32)
                    inside[ball, unit] = 1
                    rows.append((row["radii"][c], row["replicate"], 0, np.packbits((inside.T @ inside)[upper] > 0).tobytes()))
            yield pd.DataFrame(rows, columns=["radius", "replicate", "bucket", "bitmap"])

    return met_with(work.join(packed(balls, d), "chunk"), dealt).mapInPandas(run, "radius double, replicate int, bucket bigint, bitmap binary")


def element_bits(sets: DataFrame, element: str) -> DataFrame:
    """radius, replicate, bucket and bitmap of sets of elements (a row each); elements are numbered by rank, 32,768 to a bucket."""
    numbered = canonical_order(sets.select(element).distinct(), element, "_place")
    rows = sets.select(*KEYS, element).join(numbered, element)
    return rows.groupBy(*KEYS, F.bitmap_bucket_number("_place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("bitmap"))


def common_bits(bits: DataFrame, tile: int = 64) -> DataFrame:
    """radius, ra < rb and common: the bits that two replicates both have.

    Bitmaps are packed into tiles of replicates; two tiles meet by radius and bucket, and a matrix
    product counts all their pairs at once. A row is made for each pair of replicates, none for a shared element."""
    tiles = bits.groupBy("radius", "bucket", F.floor(F.col("replicate") / tile).alias("tile")).agg(F.collect_list("replicate").alias("names"), F.collect_list("bitmap").alias("maps"))
    other = tiles.withColumnsRenamed({"tile": "_tile", "names": "_names", "maps": "_maps"})

    def matrix(maps: Sequence[bytes], width: int) -> np.ndarray:
        return np.unpackbits(np.stack([np.frombuffer(m.ljust(width, b"\0"), np.uint8) for m in maps]), axis=1).astype(np.float32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                width = max(len(m) for m in (*row["maps"], *row["_maps"]))
                n = (matrix(row["maps"], width) @ matrix(row["_maps"], width).T).astype(np.int64)
                a, b = np.meshgrid(row["names"], row["_names"], indexing="ij")
                yield pd.DataFrame({"radius": row["radius"], "ra": np.minimum(a, b)[a != b], "rb": np.maximum(a, b)[a != b], "common": n[a != b]}).drop_duplicates()

    met_ = tiles.join(other, ["radius", "bucket"]).where(F.col("tile") <= F.col("_tile")).select("radius", "names", "maps", "_names", "_maps")
    return met_.mapInPandas(run, "radius double, ra int, rb int, common bigint").groupBy("radius", "ra", "rb").agg(F.sum("common").alias("common"))


class Sweep:
    """The covers of all radii and replicates of a table: balls, members() and diagnostics() share the blocks and the landmarks."""

    def __init__(self, points: DataFrame, axes: Sequence[str], radii: Sequence[float], replicates: Sequence[int], item: str = "id", seed: int = 20260807, step: int = 1009, block: int = BLOCK, chunk: int = RADII, head: int = 256) -> None:
        self.axes, self.seed, self.step = list(axes), seed, step
        self.blocks = blocks(points, axes, item, block)
        self.work = chunks(points.sparkSession, radii, replicates, chunk, self.blocks.count())
        self.found = cut(landmarks(self.blocks, self.work, len(self.axes), seed, step, head))

    def balls(self) -> DataFrame:
        """radius, replicate, ball_id, landmark, eps and the landmark's axes as c_<axis>."""
        radius = F.get(F.col("radii"), F.col("c"))
        named = self.found.join(self.work, "chunk")
        return named.select(radius.alias("radius"), "replicate", F.col("ball").alias("ball_id"), "landmark", radius.alias("eps"), *[F.col(f"_a{i}").alias(f"c_{a}") for i, a in enumerate(self.axes)])

    def members(self) -> DataFrame:
        return members(self.blocks, self.work, self.found, len(self.axes))

    def counts(self) -> DataFrame:
        return counted(self.blocks, self.work, self.found, len(self.axes))

    def sizes(self) -> DataFrame:
        """radius, replicate, ball_id and n, without a row for each membership."""
        return counted(self.blocks, self.work, self.found, len(self.axes), True).select(*KEYS, F.col("a").alias("ball_id"), "n")

    def pair_bits(self, sample: DataFrame, item: str = "id") -> DataFrame:
        """Bits of the pairs of a bounded sample of the points (BLOCK at most)."""
        one = blocks(sample, self.axes, item, max(BLOCK, 1))
        if one.count() > 1:
            raise ValueError(f"the sample has more than {BLOCK} points")
        return pair_bits(one, self.work, self.found, len(self.axes))
