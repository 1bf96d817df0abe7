"""New units against a frozen cover, as they come in.

Each unit gets its balls without any state, so late or repeated rows do no harm."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverscope.functions.columns import squared
from coverscope.operators.near import MAX_BROADCAST


def assign_stream(units: DataFrame, balls: DataFrame, axes: Sequence[str]) -> DataFrame:
    """units (a stream or a table) with ball_id for each ball at most its eps away, null for none. balls: as cover.landmarks() gives them."""
    if balls.count() > MAX_BROADCAST:
        raise ValueError("too many balls to broadcast")
    near = squared([F.col(a) for a in axes], [F.col(f"c_{a}") for a in axes]) <= F.col("eps") * F.col("eps")
    return units.join(F.broadcast(balls.select("ball_id", "eps", *[f"c_{a}" for a in axes])), near, "left").drop("eps", *[f"c_{a}" for a in axes])
