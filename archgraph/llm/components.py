"""Connected components of links between long ids, as rounds over written tables."""

from pyspark.sql import functions as F

from archgraph.session import materialize


def connected_components(links):
    """``node``, ``component`` (the smallest node) for all nodes of ``links`` (``a``, ``b``).

    Every node points to its smallest neighbour or itself; pointers are
    followed to their ends, and links between ends are the next round's. A
    round at least halves the nodes. Minima combine before the shuffle, and
    the tables joined by a popular node are plain written tables, which
    adaptive execution can split.
    """
    ordered = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a != b").distinct()
    links = materialize(ordered, "links")
    found = None
    while not links.isEmpty():
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = _ends(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
        if found is None:
            found = ends
        else:
            later = ends.select(F.col("node").alias("component"), F.col("component").alias("end"))
            found = found.join(later, "component", "left").select("node", F.coalesce("end", "component").alias("component"))
            found = materialize(found, "components")
        left = ends.select(F.col("node").alias("a"), F.col("component").alias("x"))
        right = ends.select(F.col("node").alias("b"), F.col("component").alias("y"))
        moved = links.join(left, "a").join(right, "b").where("x != y")
        links = materialize(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found


def _ends(pointers):
    pointers = materialize(pointers, "pointers")
    while True:
        onward = pointers.select(F.col("node").alias("component"), F.col("component").alias("onward"))
        moved = pointers.join(onward, "component").select("node", F.col("onward").alias("component"), (F.col("onward") != F.col("component")).alias("moved"))
        moved = materialize(moved, "pointers")
        pointers = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return pointers
