"""Connected components of a graph whose edges are rows: smallest neighbour, pointer jumps, contraction, until no edge is left."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.shared import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """``v, label`` of every end of an edge ``a, b``; the label is the component's smallest end.

    Each round a vertex points to the smallest of its neighbours and itself, and then to where that one points. The
    edges are contracted to the ends that are pointed to, without loops and repeats, and the next round works on what
    is left. At the end the rounds' pointers are followed from the last round back to the first. A round is a table in
    the shared folder. Self-loops are allowed, repeated edges cost nothing.
    """
    ends = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    left = materialize(edges.select(*ends).distinct(), "edges")
    rounds = []
    while True:
        both = left.select(F.explode(F.array(F.struct(F.col("a").alias("v"), "b"), F.struct(F.col("b").alias("v"), F.col("a").alias("b")))).alias("e")).select("e.*")
        near = materialize(both.groupBy("v").agg(F.least(F.min("b"), F.first("v")).alias("near")), "near")
        far = near.select(F.col("v").alias("near"), F.col("near").alias("far"))
        pointer = materialize(near.join(far, "near").select("v", F.col("far").alias("label")), "pointers")
        rounds.append(pointer)
        moved = left.join(pointer.select(F.col("v").alias("a"), F.col("label").alias("to_a")), "a").join(pointer.select(F.col("v").alias("b"), F.col("label").alias("to_b")), "b")
        moved = moved.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        after = materialize(moved, "edges")
        discard(left, near)
        left = after
        if left.isEmpty():
            break

    def followed(later: DataFrame, earlier: DataFrame) -> DataFrame:
        on = later.select(F.col("v").alias("label"), F.col("label").alias("last"))
        # Where a round's pointers lead may have no edge left, and so no pointer in the next round.
        return materialize(earlier.join(on, "label", "left").select("v", F.coalesce("last", "label").alias("label")), "labels")

    return reduce(followed, reversed(rounds))
