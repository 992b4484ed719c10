"""Dependency graphs as edge tables (src, dst)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, shared_dir


def edges_of(rows: DataFrame, source: str = "path", targets: str = "imports") -> DataFrame:
    """Distinct edges of rows that hold a list of targets each."""
    return rows.select(F.col(source).alias("src"), F.explode(targets).alias("dst")).distinct()


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree), one shuffle: both ends of an edge are counted at once."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy(F.col("e.node").alias("node")).agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def roots(edges: DataFrame) -> DataFrame:
    """Nodes that nothing depends on."""
    return degrees(edges).filter("in_degree = 0").select("node")


def leaves(edges: DataFrame) -> DataFrame:
    return degrees(edges).filter("out_degree = 0").select("node")


def adjacency(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """(node, neighbours): dependencies, or dependents, sorted."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    return edges.groupBy(F.col(a).alias("node")).agg(F.array_sort(F.collect_set(b)).alias("neighbours"))


def mutual(edges: DataFrame) -> DataFrame:
    """Pairs that depend on each other, smaller first; a self-loop is a pair with itself."""
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    return edges.join(back, ["src", "dst"], "left_semi").filter("src <= dst").select("src", "dst").distinct()


def reachability(edges: DataFrame) -> DataFrame:
    """(src, dst) for every path of one edge or more.

    The paths double in length each round, and each round is a reliable checkpoint, so the depth of the graph costs its
    logarithm. The result itself may have a row for every two nodes; ``strong_components`` and ``cyclic`` don't need it.
    """
    shared_dir(edges.sparkSession)
    found = cut(edges.select("src", "dst").distinct())
    before = found.count()
    while True:
        longer = found.alias("a").join(found.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        found = cut(found.union(longer).distinct())
        now = found.count()
        if now == before:
            return found
        before = now


def _spread(colours: DataFrame, edges: DataFrame) -> DataFrame:
    """colours(node, colour) with each node's least colour of those that reach it along ``edges``; one checkpoint a step."""
    while True:
        reached = edges.join(colours, edges.src == colours.node).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("new"))
        now = cut(colours.join(reached, "node", "left").select("node", F.least("colour", "new").alias("colour"), (F.col("new") < F.col("colour")).alias("changed")))
        colours = now.select("node", "colour")
        if not now.filter("changed").take(1):
            return colours


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges between nodes that have edges both ways, again and again until none goes."""
    edges, before = cut(edges), None
    while True:
        now = edges.count()
        if now == before:
            return edges
        before = now
        edges = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components, named by their least node, without the closure.

    Nodes off all cycles are trimmed. The least node that reaches a node is its colour; going back from each colour's own node
    within the colour gives one component a colour. These leave, and the rest is coloured again.
    """
    left = _trimmed(edges.filter("src <> dst").select("src", "dst").distinct())
    found = None
    while left.take(1):
        colours = _spread(nodes(left).select("node", F.col("node").alias("colour")), left)
        a, b = colours.toDF("src", "colour"), colours.toDF("dst", "colour_to")
        same = cut(left.join(a, "src").join(b, "dst").filter("colour = colour_to").select("src", "dst", "colour"))
        seen = cut(same.select(F.col("colour").alias("node"), "colour").distinct())
        front = seen
        while front.take(1):
            back = same.join(front.withColumnRenamed("node", "dst"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            front = cut(back.join(seen, ["node", "colour"], "left_anti"))
            seen = seen.unionByName(front)
        part = cut(seen.union(colours.filter("node = colour")).distinct().select("node", F.col("colour").alias("component")))
        found = part if found is None else found.unionByName(part)
        gone = part.select("node")
        left = _trimmed(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    each = nodes(edges)
    if found is None:
        return each.select("node", F.col("node").alias("component"))
    return each.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cyclic(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes on a cycle: those of components of several nodes, and those with an edge to themselves."""
    inside = strong_components(edges)
    several = inside.groupBy("component").count().filter("count > 1").select("component")
    loops = edges.filter("src = dst").select(F.col("src").alias("node")).distinct()
    return inside.join(several, "component", "left_semi").unionByName(inside.join(loops, "node", "left_semi")).distinct()


def at_most(edges: DataFrame, most: int) -> bool:
    return edges.limit(most + 1).count() <= most


def on_cycle(closure: DataFrame) -> DataFrame:
    return closure.filter("src = dst").select(F.col("src").alias("node"))


def components(edges: DataFrame, closure: DataFrame) -> DataFrame:
    """(node, component): strongly connected components, named by their least node."""
    both = closure.join(closure.select(F.col("src").alias("dst"), F.col("dst").alias("src")), ["src", "dst"], "left_semi")
    least = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least"))
    return nodes(edges).join(least, "node", "left").select("node", F.least(F.col("node"), F.coalesce("least", "node")).alias("component"))


def back_edges(edges: DataFrame, most: int = 2_000_000) -> DataFrame:
    """(cycle_id, path): the back edges that one depth-first walk, over sorted nodes and sorted neighbours, meets.

    The walk's order is the result, so it runs on the driver; larger graphs than ``most`` edges are refused, for which
    ``cyclic`` finds the cycles in a distributed way.
    """
    spark = edges.sparkSession
    if not at_most(edges, most):
        raise ValueError(f"over {most} edges: too many for a sequential walk; use cyclic()")
    graph = {r[0]: list(r[1]) for r in adjacency(edges).collect()}
    everything = sorted({n for n in graph} | {d for ds in graph.values() for d in ds})
    done: set = set()
    cycles: list[tuple[int, list[str]]] = []
    for start in everything:
        if start in done:
            continue
        path, place, work = [start], {start: 0}, [iter(graph.get(start, ()))]
        done.add(start)
        while work:
            nxt = next(work[-1], None)
            if nxt is None:
                work.pop()
                place.pop(path.pop())
            elif nxt in place:
                cycles.append((len(cycles), path[place[nxt] :]))
            elif nxt not in done:
                done.add(nxt)
                place[nxt] = len(path)
                path.append(nxt)
                work.append(iter(graph.get(nxt, ())))
    return spark.createDataFrame(cycles, "cycle_id int, path array<string>")


def resolve(edges: DataFrame, index: DataFrame) -> DataFrame:
    """Edges with import tokens replaced by the file that ``index(src, token, file)`` names for the importing file, or
    ``index(token, file)`` for all; tokens without one stay."""
    on = ["src", "token"] if "src" in index.columns else ["token"]
    return edges.withColumnRenamed("dst", "token").join(index, on, "left").select("src", F.coalesce("file", "token").alias("dst")).distinct()
