"""Connected components of a graph of ids, by contraction.

In each round every node hooks to its smallest neighbour if that is smaller than
itself. Following the hooks a few steps mostly leads to a node that hooks
nowhere; the edges are rewritten between the nodes so reached, and loops and
repeated edges go. "Smaller" means the id in the first two rounds, which resolves
stars around a small id at once and any other star in the second. Later pairs of
rounds draw a number for each node by hashing its id: falling runs of random
numbers are short, so long paths shrink by a constant factor. When no edge is
left, the hooks of all rounds, followed in order, lead all nodes of a component
to one of them, and the smallest id that leads there names the component.

All of it is joins and aggregations with partial sums, so a node with very many
edges costs one row per task. The graph never leaves the executors; the driver
only sees whether edges are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed

JUMPS = 2


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): for every id that occurs in an edge with another one, the smallest id it reaches.

    Edges may repeat, point either way and join an id with itself; edges with a
    null end are ignored. Ids without an edge to another id are left out.
    """
    both = F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    ends = F.least(a, b).alias("x"), F.greatest(a, b).alias("y")
    left = checkpointed(edges.filter(both).select(*ends).distinct())
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        hooks = _hooks(left, len(rounds))
        rounds.append(hooks)
        to = lambda end: hooks.select(F.col("node").alias(end), F.col("parent").alias(f"{end}_parent"))
        moved = left.join(to("x"), "x", "left").join(to("y"), "y", "left")
        x, y = F.coalesce("x_parent", "x"), F.coalesce("y_parent", "y")
        moved = moved.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).filter("x != y")
        left = checkpointed(moved.distinct())
    if not rounds:
        return left.select(F.col("x").alias("id"), F.col("y").alias("component"))
    # Back to front: a node's parent leads to what the later rounds made of it.
    found = rounds[-1]
    for hooks in reversed(rounds[:-1]):
        found = checkpointed(_followed(hooks, found).unionByName(found.join(hooks.select("node"), "node", "left_anti")))
    # A component's own end does not hook and is named by the others.
    smallest = found.groupBy("parent").agg(F.least(F.min("node"), F.col("parent")).alias("component"))
    smallest = checkpointed(smallest)
    members = found.join(smallest, "parent").select(F.col("node").alias("id"), "component")
    return members.unionByName(smallest.select(F.col("parent").alias("id"), "component"))


def _hooks(edges: DataFrame, number: int) -> DataFrame:
    """(node, parent): where each node of the edges that has a smaller neighbour leads to."""
    seed = number // 2
    draw = lambda end: F.xxhash64(F.lit(seed), end) if seed else F.col(end).cast("bigint")
    drawn = lambda end: F.struct(draw(end).alias("draw"), F.col(end).alias("id"))
    ranked = edges.select(drawn("x").alias("x"), drawn("y").alias("y"))
    ranked = ranked.select(F.greatest("x", "y").getField("id").alias("node"), F.least("x", "y").alias("parent"))
    hooks = ranked.groupBy("node").agg(F.min("parent").getField("id").alias("parent"))
    for _ in range(JUMPS):
        hooks = checkpointed(hooks)
        hooks = _followed(hooks, hooks)
    return checkpointed(hooks)


def _followed(hooks: DataFrame, further: DataFrame) -> DataFrame:
    """``hooks`` with each parent replaced by its own parent in ``further``, if it has one there."""
    later = further.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
    return hooks.join(later, "parent", "left").select("node", F.coalesce("root", "parent").alias("parent"))
