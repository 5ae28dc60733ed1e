"""Connected components by contraction, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root of every node in ``links`` (a, b): one root for each component.

    Each round every component hooks onto the smallest neighbouring component if that is smaller, chains are
    shortened by pointer jumping, and links are contracted to the new components; a round leaves only components
    that were smallest among their neighbours. Aggregates are combined before shuffles and joins are plain
    equi-joins, so a node with very many links is split like any skewed join key.
    """
    kind = links.schema["a"].dataType
    schema = f"a {kind.simpleString()}, b {kind.simpleString()}"
    both = links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct()
    live = scratch.read(scratch.write(both, "links"), schema)
    roots = None
    while True:
        hooks = live.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("root"))
        hooks = scratch.table(hooks, "hooks")
        while True:  # pointer jumping
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = scratch.table(hooks.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.coalesce("next", "root") != F.col("root")).alias("moved")), "jumped")
            moved = jumped.filter("moved").limit(1).count()
            hooks = jumped.select("node", "root")
            if not moved:
                break
        if roots is None:
            roots = hooks
        else:
            top = hooks.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = scratch.table(roots.join(top, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "roots")
        a, b = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra")), hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        contracted = live.join(a, "a").join(b, "b").filter("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        live = scratch.read(scratch.write(contracted, "links"), schema)
        if not live.limit(1).count():
            return roots
