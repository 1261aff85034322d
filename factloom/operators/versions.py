"""Version graphs: edges, circles, and which version covers a date."""

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from factloom.functions.scalars import candidate_status
from factloom.operators.intervals import ancestors_of_day, dyadic_blocks
from factloom.scratch import cut, release

# Fixed value: kinds of edges that must close no circle.
ACYCLIC = ("AMENDS", "CORRECTS", "REPEALS", "SUPERSEDES")
#: Graphs of up to so many distinct edges are gathered, one to a group.
MAX_EDGES = 1000


def edge_findings(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(graph, source, target, code): ends that are no node of the graph, edges to themselves, and repeated edges.

    edges(graph, source, target), and kind where edges have one; nodes(graph, node). Edges of another kind are no repetition,
    and the result then has the kind, and how many rows each finding stands for: all of an edge, of a repeated one the later.
    """
    known = nodes.select("graph", "node").distinct()
    kind = ["kind"] if "kind" in edges.columns else []
    counted = edges.groupBy("graph", "source", "target", *kind).agg(F.count(F.lit(1)).alias("n"))
    s, t = known.select("graph", F.col("node").alias("source"), F.lit(True).alias("has_source")), known.select("graph", F.col("node").alias("target"), F.lit(True).alias("has_target"))
    both = counted.join(s, ["graph", "source"], "left").join(t, ["graph", "target"], "left")
    codes = F.array_compact(
        F.array(
            F.when(F.col("has_source").isNull() | F.col("has_target").isNull(), "LEGAL_RELATIONSHIP_VERSION_UNKNOWN"),
            F.when(F.col("source") == F.col("target"), "LEGAL_RELATIONSHIP_SELF_REFERENCE"),
            F.when(F.col("n") > 1, "LEGAL_RELATIONSHIP_DUPLICATE_EDGE"),
        )
    )
    found = both.select("graph", "source", "target", *kind, "n", F.explode(codes).alias("code"))
    rows = F.when(F.col("code") == "LEGAL_RELATIONSHIP_DUPLICATE_EDGE", F.col("n") - 1).otherwise(F.col("n"))
    return found.withColumn("rows", rows).drop("n") if kind else found.drop("n")


def _circular(sources: list, targets: list) -> bool:
    """Whether the edges close a circle: nodes without an edge into them go, with their edges, until none is left."""
    into: dict = {}
    out: dict = {}
    for s, t in zip(sources, targets):
        into[t] = into.get(t, 0) + 1
        into.setdefault(s, 0)
        out.setdefault(s, []).append(t)
    free = [n for n, k in into.items() if not k]
    gone = 0
    while free:
        gone += 1
        for t in out.get(free.pop(), ()):
            into[t] -= 1
            if not into[t]:
                free.append(t)
    return gone < len(into)


def graph_circles(edges: DataFrame, *, max_edges: int | None = None, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(graph, edges, circular) of each graph of edges(graph, source, target); null ends are no edge. Where ``kinds`` are
    given, edges have a kind and only those may close no circle; a graph without such edges has none.

    Graphs of any size are solved: up to MAX_EDGES distinct edges one by one, larger ones by ``_shrunk`` without ever being
    gathered. Only where ``max_edges`` is given as a contract a larger graph is refused, circular null.
    """
    if kinds is not None:
        graphs = edges.where(F.col("graph").isNotNull()).select("graph").distinct()
        found = graph_circles(edges.where(F.col("kind").isin(*kinds)).drop("kind"), max_edges=max_edges)
        return graphs.join(found, "graph", "left").select("graph", F.coalesce("edges", F.lit(0)).alias("edges"), F.when(F.col("edges").isNull(), False).otherwise(F.col("circular")).alias("circular"))
    distinct = edges.dropna(subset=["graph", "source", "target"]).select("graph", "source", "target").distinct()
    if max_edges is None:
        distinct = cut(distinct)
    sizes = distinct.groupBy("graph").agg(F.count(F.lit(1)).alias("edges"))
    small = distinct.join(sizes.where(F.col("edges") <= (MAX_EDGES if max_edges is None else max_edges)).select("graph"), "graph")
    solved = None
    if max_edges is None:
        solved, rest, tables = _shrunk(distinct.join(sizes.where(F.col("edges") > MAX_EDGES).select("graph"), "graph"))
        small = small.unionByName(rest)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"graph": [pdf["graph"].iloc[0]], "circular": [_circular(pdf["source"].tolist(), pdf["target"].tolist())]})

    found = small.groupBy("graph").applyInPandas(run, "graph string, circular boolean")
    if solved is None:
        return sizes.join(found, "graph", "left").select("graph", "edges", "circular")
    kept = cut(sizes.join(found.unionByName(solved), "graph", "left").select("graph", "edges", "circular"))
    release(distinct, *tables)
    return kept


def _shrunk(edges: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(graph, circular) of the graphs solved, the edges that are left of the others, at most MAX_EDGES a graph, and the tables that
    both are read from.

    Each round drops the edges from nodes that none leads into and those to nodes that none leaves. A graph without such
    edges has a circle, as has one with an edge from a node to itself; one without other edges has none. Of the nodes with one
    edge in and one out some, none next to another, are bridged, which keeps every circle. So a forest or chain takes
    rounds by the logarithm of its size; other graphs at most half their longest path.
    """
    spark = edges.sparkSession
    solved, rest = spark.createDataFrame([], "graph string, circular boolean"), spark.createDataFrame([], edges.schema)
    state, turn, tables = cut(edges), 0, []
    while not state.isEmpty():
        ends = state.select("graph", F.col("source").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
            state.select("graph", F.col("target").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
        )
        coin = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
        nodes = ends.groupBy("graph", "node").agg(F.sum("i").alias("i"), F.sum("o").alias("o")).select("graph", "node", "i", "o", ((F.col("i") == 1) & (F.col("o") == 1) & coin).alias("mid"))
        s = nodes.select("graph", F.col("node").alias("source"), (F.col("i") == 0).alias("first"), F.col("mid").alias("from_mid"))
        t = nodes.select("graph", F.col("node").alias("target"), (F.col("o") == 0).alias("last"), F.col("mid").alias("to_mid"))
        marked = cut(state.join(s, ["graph", "source"]).join(t, ["graph", "target"]).select("graph", "source", "target", (~F.col("first") & ~F.col("last")).alias("stays"), "from_mid", "to_mid"))
        n, stay = F.count(F.lit(1)), F.count_if("stays")
        circular = F.when((stay == n) | F.bool_or(F.col("source") == F.col("target")), True).when(stay == 0, False)
        shape = cut(marked.groupBy("graph").agg(circular.alias("circular"), stay.alias("left")))
        solved = solved.unionByName(shape.where(F.col("circular").isNotNull()).select("graph", "circular"))
        open_ = shape.where(F.col("circular").isNull())
        kept = marked.where("stays")
        left = cut(kept.join(open_.where(F.col("left") <= MAX_EDGES).select("graph"), "graph").select("graph", "source", "target"))
        tables += [shape, left]
        rest = rest.unionByName(left)
        on = kept.join(open_.where(F.col("left") > MAX_EDGES).select("graph"), "graph")
        bridged = F.col("to_mid") & ~F.col("from_mid")
        over = on.where(bridged).select("graph", F.col("target").alias("source"), F.col("source").alias("before"))
        moved = on.where(~bridged).join(over, ["graph", "source"], "left").select("graph", F.coalesce("before", "source").alias("source"), "target").distinct()
        last, state, turn = state, cut(moved), turn + 1
        release(last, marked)
    release(state)
    return solved, rest, tables


def versions_on(events: DataFrame, versions: DataFrame) -> DataFrame:
    """(event_id, candidates, status): how many of its entity's versions hold each event's day, as now known.

    events(event_id, entity, day); versions(entity, version_id, valid struct<first, last>). An event without a day has no
    candidate. Versions are indexed by dyadic blocks of their interval, so an event meets only versions that hold its day.
    """
    v = versions.where(F.col("valid").isNotNull()).select("entity", F.explode(dyadic_blocks(F.col("valid.first"), F.col("valid.last"))).alias("block"))
    counted = v.groupBy("entity", "block").agg(F.count(F.lit(1)).alias("n"))
    asked = events.select("event_id", "entity", F.explode_outer(ancestors_of_day(F.col("day"))).alias("block"))
    met = asked.join(counted, ["entity", "block"], "left").groupBy("event_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"))
    return met.select("event_id", "candidates", candidate_status(F.col("candidates")).alias("status"))
