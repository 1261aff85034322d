"""Parent-child links to full hierarchies, by splitters and a reduced pointer graph."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from factloom.scratch import cut, release

CYCLE = "CYCLE"


def _left() -> Column:
    """How many pointers have not stopped."""
    return F.count_if(~F.col("stop"))



def _jump(state: DataFrame) -> list[DataFrame]:
    """Tables whose rows with ``stop`` are the pointers that stop, each followed to where it does; those that only circle are in none.

    state, from ``cut`` with ``left`` measured: (node, cur, dist, path, stop); ``cur`` is ``dist`` steps above ``node``; ``path``
    names the nodes from ``node`` to just below ``cur``; ``stop`` tells that ``cur`` is where the walk ends. A pointer that has
    not stopped is replaced by that of its ``cur``, so a walk of n steps takes log2 n rounds, each one join and one write.
    Where a round stops no pointer, the rest only circles: on a walk of more than 2 ** (r + 1) steps some node needs between
    2 ** r and 2 ** (r + 1) and would have stopped.
    """
    tables, last, left, hops = [state], state, state.measured["left"], state
    while left:
        a, b = last.where("NOT stop").alias("a"), hops.alias("b")
        moved = a.join(b, F.col("a.cur") == F.col("b.node")).select(
            "a.node", "b.cur", (F.col("a.dist") + F.col("b.dist")).alias("dist"), F.concat("a.path", "b.path").alias("path"), "b.stop"
        )
        last, before = cut(moved, left=_left()), left
        tables.append(last)
        # Pointers that have stopped stay; the others were all replaced.
        hops = hops.where("stop").unionByName(last)
        left = last.measured["left"]
        if left == before:
            break
    return tables


def _stopped(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [t.where("stop") for t in tables]).drop("stop")


def hierarchy(nodes: DataFrame, edges: DataFrame, *, every: int = 8) -> DataFrame:
    """(node, root, depth, path) of every node of a forest of unknown depth.

    nodes(node): ids, repeated or not; edges(node, parent): at most one parent a node (of several the least counts).
    Edges with an end that is null or no known node are ignored. A root has depth 0. A node on or below a circle, a node
    naming itself included, has root CYCLE, depth -1 and an empty path. path: ids from the root to the node.

    About one node in ``every`` is a splitter, chosen by a hash of its id, and so is every root. Each node walks to its
    next splitter above; the pointers among splitters form a reduced graph, which is solved alone; then each node's path
    is its walk joined to its splitter's path. A walk that reaches no splitter ends in a splitterless circle.
    Both walks double their pointers, so joins grow with the logarithm of the depth, and a node with very many children
    is a skewed join key, never a group. The result is one kept table; those made on the way are deleted.
    """
    known = nodes.where(F.col("node").isNotNull()).select("node").distinct()
    links = edges.where(F.col("node").isNotNull() & F.col("parent").isNotNull()).groupBy("node").agg(F.min("parent").alias("parent"))
    links = links.join(known.withColumnRenamed("node", "parent"), "parent", "left_semi")
    up = cut(known.join(links, "node", "left").select("node", "parent", F.col("parent").isNull().alias("top"), (F.col("parent").isNull() | (F.pmod(F.xxhash64("node"), F.lit(every)) == 0)).alias("split")))
    c, p = up.where("NOT top").alias("c"), up.alias("p")
    first = c.join(p, F.col("c.parent") == F.col("p.node")).select(
        F.col("c.node").alias("node"), F.col("p.node").alias("cur"), F.lit(1).alias("dist"), F.array("c.node").alias("path"), F.col("p.split").alias("stop"), F.col("c.split").alias("split"), F.col("p.top").alias("top")
    )
    first = cut(first, left=_left())
    start = first.drop("split", "top")
    start.measured = first.measured
    walked = _jump(start)
    # Whether a node splits is known by its hash, whether a splitter is a root by the roots.
    splits = F.pmod(F.xxhash64("node"), F.lit(every)) == 0
    walks, roots = _stopped(walked), up.where("top").select("node")
    tops = roots.select(F.col("node").alias("cur"), F.lit(True).alias("top"))
    solved = _jump(cut(walks.where(splits).join(tops, "cur", "left").select("node", "cur", "dist", "path", F.coalesce("top", F.lit(False)).alias("stop")), left=_left()))
    above = _stopped(solved).withColumnRenamed("cur", "root").unionByName(
        roots.select("node", F.col("node").alias("root"), F.lit(0).alias("dist"), F.array().cast("array<string>").alias("path"))
    )
    w, s = walks.where(~splits).alias("w"), above.alias("s")
    below = w.join(s, F.col("w.cur") == F.col("s.node")).select("w.node", "s.root", (F.col("w.dist") + F.col("s.dist")).alias("dist"), F.concat("w.path", "s.path").alias("path"))
    inside = F.col("root").isNotNull()
    full = known.join(above.unionByName(below), "node", "left").select(
        "node",
        F.coalesce("root", F.lit(CYCLE)).alias("root"),
        F.when(inside, F.col("dist")).otherwise(-1).cast("int").alias("depth"),
        F.coalesce(F.when(inside, F.reverse(F.concat("path", F.array("root")))), F.array().cast("array<string>")).alias("path"),
    )
    kept = cut(full)
    release(up, first, *walked[1:], *solved)
    return kept


def descendants(tree: DataFrame) -> DataFrame:
    """(node, descendant, distance) for every pair of a node and a node below it, from the paths of ``hierarchy``."""
    return tree.select(F.posexplode("path").alias("at", "above"), F.col("node").alias("descendant"), "depth").where(F.col("at") < F.col("depth")).select(
        F.col("above").alias("node"), "descendant", (F.col("depth") - F.col("at")).alias("distance")
    )
