"""Names, keys, provenance and row profiles of a table."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coverscope.functions.columns import level, mentions_id


def normalise_names(df: DataFrame) -> DataFrame:
    """Lower-case names of letters, digits and single underscores, accents taken off; repeated ones get a number."""
    seen: dict[str, int] = {}
    names = []
    for c in df.columns:
        plain = "".join(x for x in unicodedata.normalize("NFKD", c.lower().replace("ß", "ss")) if not unicodedata.combining(x))
        n = re.sub(r"[^0-9a-z]+", "_", plain).strip("_") or "x"
        seen[n] = seen.get(n, 0) + 1
        names.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return df.toDF(*names)


def find_key_column(df: DataFrame, pattern: str, share: float) -> DataFrame:
    """key_column and share of the columns of which more than a share of the values match; one pass over df."""
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    one = df.agg(*[F.avg(F.when(F.col(c).rlike(pattern), 1.0).otherwise(0.0)).alias(c) for c in text])
    return one.unpivot([], text, "key_column", "share").where(F.col("share") > share)


def with_provenance(df: DataFrame, **facts) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in facts.items()})


def profile_signature(df: DataFrame, axes: list[str]) -> DataFrame:
    """df with mean, sd, norm, highest, lowest and largest (by absolute value) axis, its direction, and a text of levels; the first axis wins ties."""
    values = F.array(*axes)
    size = F.transform(values, F.abs)
    name = lambda at: F.element_at(F.array(*[F.lit(a) for a in axes]), at.cast("int"))
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / len(axes)
    out = df.withColumns(
        {
            "mean": mean,
            "norm": F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)),
            "highest": name(F.array_position(values, F.array_max(values))),
            "lowest": name(F.array_position(values, F.array_min(values))),
            "largest": name(F.array_position(size, F.array_max(size))),
            "signature": F.concat_ws("|", *[level(F.col(a)) for a in axes]),
        }
    )
    spread = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean")))
    top = F.element_at(values, F.array_position(size, F.array_max(size)).cast("int"))
    return out.withColumns({"sd": F.sqrt(spread / (len(axes) - 1)), "direction": F.when(top > 0, "above").when(top < 0, "below").otherwise("at")})


def mentioned_ids(df: DataFrame, text: str, ids: DataFrame, item: str) -> DataFrame:
    """A row of df for each id that its text names. The ids are words of the text, so that this is an equi join, checked exactly."""
    word = F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)))).alias("_word")
    named = df.select("*", word).join(ids, F.col("_word") == F.col(item).cast("string"))
    return named.where(mentions_id(F.col(text), F.col(item))).drop("_word")
