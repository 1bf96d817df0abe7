"""How filters overlap, for every order of applying them: path counts over the lattice of filter sets.

A state is the set of filters applied so far, and a document is still there if it fails none
of them. One pass gives each document the set of filters it fails; counts by (part, set) are
all that is needed then. An edge adds one filter to a state and removes what is there before
and not after. Orders reaching a state are counted forward, orders leaving it backward; an
edge lies on (orders reaching its start) x (orders leaving its end) orders. So a filter's
removals over all orders (its Shapley value times the number of orders) are its edges'
removals weighted by that product, and the steps of any one order are edges read off.

What travels: a row for each document without its text, then counts. Lattice and orders grow
with the filters (`max_filters`), never with the data.

Nulls: a null text is the empty text, a null part the part '', a null condition is no failure.
A null id has no smaller one and is nobody's original. A document with several label rows is
good (or toxic) if one of them says so. Repeated rows are documents of their own, no copies of
each other (no smaller id). An empty table gives an empty result. Only the named columns are
used, so other columns can't clash.
"""

from __future__ import annotations

import json
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverscope.llm.shared import let, words, written


def text_filters(text: Column, min_words: int = 100, min_distinct: int = 80, max_capitals: int = 10, symbols: str = "[#$%&*|]") -> Column:
    """Bits of the failures: 1 too few words, 2 too few distinct words (percent), 4 too many capitals (percent of code points), 8 a symbol."""
    t = F.coalesce(text, F.lit(""))
    capitals = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))
    return let(
        words(t),
        lambda w: F.when(F.size(w) < min_words, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct(w)) < min_distinct * F.size(w), 2).otherwise(0)
        + F.when(100 * capitals > max_capitals * F.length(t), 4).otherwise(0)
        + F.when(t.rlike(symbols), 8).otherwise(0),
    )


def later_copies(docs: DataFrame, doc_id: str = "doc_id", digest: str = "digest", new: str = "copy") -> DataFrame:
    """docs with a flag: a row of a smaller id has the same digest.

    Only digests of two or more ids are joined; both sides are shuffled as they are, so Spark can split a digest that many rows have."""
    first = docs.groupBy(F.col(digest).alias("_d")).agg(F.min(doc_id).alias("_first"), F.max(doc_id).alias("_last")).where("_first < _last").select("_d", "_first")
    return docs.join(written(first, "audit-first"), F.col(digest) == F.col("_d"), "left").withColumn(new, F.coalesce(F.col(doc_id) > F.col("_first"), F.lit(False))).drop("_d", "_first")


def lattice(n: int) -> tuple[list[dict], list[dict]]:
    """(edges, steps): each edge with its start, filter and number of orders through it; each order's steps with the edge they take."""
    full = (1 << n) - 1
    reaching, leaving = [1] + [0] * full, [0] * full + [1]
    edges = [{"start": s, "end": s | 1 << f, "filter": f} for s in range(full) for f in range(n) if not s >> f & 1]
    for e in edges:  # starts ascend
        reaching[e["end"]] += reaching[e["start"]]
    for e in reversed(edges):
        leaving[e["start"]] += leaving[e["end"]]
    at = {}
    for i, e in enumerate(edges):
        e["orders"] = reaching[e["start"]] * leaving[e["end"]]
        at[e["start"], e["filter"]] = i
    steps = []
    for order in permutations(range(n)):
        state = 0
        for k, f in enumerate(order):
            steps.append({"order": list(order), "step": k + 1, "edge": at[state, f], "alone": at[0, f], "last": at[full ^ 1 << f, f], "filter": f})
            state |= 1 << f
    return edges, steps


def constant(rows: list[dict], kind: str) -> Column:
    """Rows as one constant array."""
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")


def interactions(failures: DataFrame, names: str, max_filters: int = 6) -> DataFrame:
    """failures (part, mask, good, toxic: a row for each document; bit i of mask: it fails names[i]) to part, filter_order, step and their counts."""
    n = len(names)
    if n > max_filters:
        raise ValueError(f"{n} filters have too many orders to list; max_filters is {max_filters}")
    edges, steps = lattice(n)
    sets = failures.groupBy("part", "mask").agg(F.count("*").alias("kept"), F.sum(F.col("good").cast("bigint")).alias("good"), F.sum(F.col("toxic").cast("bigint")).alias("toxic"))
    there = lambda s, c: F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(c)).otherwise(0))
    states = sets.groupBy("part").agg(*[F.array(*[there(s, c) for s in range(1 << n)]).alias(c) for c in ("kept", "good", "toxic")])
    lost = lambda c, e: F.get(F.col(c), e["start"]) - F.get(F.col(c), e["end"])
    walked = F.transform(
        constant(edges, "start int, end int, filter int, orders bigint"),
        lambda e: F.struct(
            e["filter"].alias("filter"),
            e["orders"].alias("orders"),
            F.get(F.col("kept"), e["end"]).alias("kept"),
            *[lost(c, e).alias(f"{c}_lost") for c in ("kept", "good", "toxic")],
        ),
    )
    total = F.aggregate(F.filter("edges", lambda e: e["filter"] == F.col("s.filter")), F.lit(0).cast("bigint"), lambda a, e: a + e["orders"] * e["kept_lost"])
    edge = lambda which: F.get(F.col("edges"), F.col(f"s.{which}"))
    order = F.array_join(F.transform("s.order", lambda f: F.substring(F.lit(names), f + 1, F.lit(1))), "")
    return (
        states.select("part", walked.alias("edges"))
        .select("part", "edges", F.explode(constant(steps, "order array<int>, step int, edge int, alone int, last int, filter int")).alias("s"))
        .select(
            "part",
            order.alias("filter_order"),
            F.col("s.step").alias("step"),
            edge("edge")["kept"].alias("kept"),
            edge("edge")["kept_lost"].alias("removed"),
            (edge("alone")["kept_lost"] - edge("edge")["kept_lost"]).alias("redundant"),
            edge("last")["kept_lost"].alias("unique_fails"),
            edge("edge")["good_lost"].alias("good_lost"),
            edge("edge")["toxic_lost"].alias("toxic_lost"),
            total.alias("shapley"),
        )
    )


def audit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Filters A to D (text_filters) and E (a smaller id has the same text) over docs, by part, with what good and toxic documents each step loses."""
    t = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(t.cast("binary"), 256)).alias("digest"), text_filters(t).alias("mask"))
    marked = later_copies(written(slim, "audit-slim"))
    said = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    joined = marked.join(said, F.col("doc_id") == F.col("_id"), "left")
    failures = joined.select("part", F.col("mask").bitwiseOR(F.when(F.col("copy"), 16).otherwise(0)).alias("mask"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    return interactions(failures, "ABCDE")
