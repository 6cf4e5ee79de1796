"""Small-graph operators on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siftpool.sources.state import materialize


def directed(edges: DataFrame) -> DataFrame:
    """Every edge in both directions; the reverse of edge (src, dst) is (dst, src)."""
    return edges.select("graph_id", "src", "dst").unionByName(edges.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degree(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Each vertex's number of neighbours, 0 for isolated ones."""
    n = directed(edges).groupBy("graph_id", F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("degree"))
    return vertices.join(n, ["graph_id", "v"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("long"))


def neighbour_sum(edges: DataFrame, values: DataFrame) -> DataFrame:
    """For each vertex the sum of its neighbours' x; null-free, 0 for isolated ones."""
    around = directed(edges).join(values.select("graph_id", F.col("v").alias("dst"), "x"), ["graph_id", "dst"])
    sums = around.groupBy("graph_id", F.col("src").alias("v")).agg(F.sum("x").alias("total"))
    return values.select("graph_id", "v").join(sums, ["graph_id", "v"], "left").withColumn("total", F.coalesce("total", F.lit(0.0)))


def shortest_paths(edges: DataFrame, vertices: DataFrame, most: int | None = None) -> DataFrame:
    """(graph_id, src, dst, hops) of all reachable pairs, or of those within `most` hops, by extending the frontier once a step.

    Only pairs that are new in a step are extended in the next one; each step is
    written, and the last one finds nothing new.
    """
    both = materialize(directed(edges), "arcs")
    known = [vertices.select("graph_id", F.col("v").alias("src"), F.col("v").alias("dst"), F.lit(0).alias("hops"))]
    frontier = known[0]
    while most is None or len(known) <= most:
        reached = frontier.select("graph_id", "src", F.col("dst").alias("via")).join(both.select("graph_id", F.col("src").alias("via"), "dst"), ["graph_id", "via"]).select("graph_id", "src", "dst").distinct()
        # A walk of one more edge ends at the frontier, one step behind it, or at a new vertex.
        for seen in known[-2:]:
            reached = reached.join(seen.select("graph_id", "src", "dst"), ["graph_id", "src", "dst"], "left_anti")
        frontier = materialize(reached.withColumn("hops", F.lit(len(known))), "frontier")
        if frontier.isEmpty():
            break
        known.append(frontier)
    out = known[0]
    for part in known[1:]:
        out = out.unionByName(part)
    return out


def reverse_arcs(edges: DataFrame) -> DataFrame:
    """(graph_id, arc, src, dst, reverse): arcs numbered from 0 in each graph by (src, dst), and the number of the arc the other way."""
    arcs = directed(edges)
    numbered = arcs.withColumn("arc", F.row_number().over(Window.partitionBy("graph_id").orderBy("src", "dst")) - 1)
    back = numbered.select("graph_id", F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("arc").alias("reverse"))
    return numbered.join(back, ["graph_id", "src", "dst"])


def pair_types(vertices: DataFrame, edges: DataFrame, kind: str, kinds: int) -> DataFrame:
    """(graph_id, src, dst, pair_type, bias): all pairs of a graph's vertices, its type from both ends' kinds; the bias is 0 for itself and neighbours, else -1.

    Graphs are small: what is paired is one graph's vertices.
    """
    a = vertices.select("graph_id", F.col("v").alias("src"), F.col(kind).alias("_a"))
    b = vertices.select("graph_id", F.col("v").alias("dst"), F.col(kind).alias("_b"))
    arcs = directed(edges).withColumn("_near", F.lit(True))
    both = a.join(b, "graph_id").join(arcs, ["graph_id", "src", "dst"], "left")
    near = F.col("_near").isNotNull() | (F.col("src") == F.col("dst"))
    return both.select("graph_id", "src", "dst", (F.col("_a") * kinds + F.col("_b")).alias("pair_type"), F.when(near, 0.0).otherwise(-1.0).alias("bias"))


def readout(values: DataFrame, x: str, norm: float = 100.0) -> DataFrame:
    """For each graph the mean and the sum of its vertices' x, and the sum over a fixed norm."""
    return values.groupBy("graph_id").agg(F.avg(x).alias("mean"), F.sum(x).alias("sum"), (F.sum(x) / norm).alias("norm"))
