import random

import pytest
from factloom import scratch
from factloom.operators.hierarchy import descendants, hierarchy


def brute(nodes, edges):
    up = {}
    for n, p in edges:
        if n is not None and p in nodes and n in nodes:
            up[n] = min(p, up.get(n, p))
    out = {}
    for n in nodes - {None}:
        path, x = [n], n
        while x in up and len(path) <= len(nodes):
            x = up[x]
            path.append(x)
        out[n] = ("CYCLE", -1, []) if len(path) > len(nodes) else (x, len(path) - 1, path[::-1])
    return out


def run(spark, nodes, edges, **k):
    tree = hierarchy(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(list(edges), "node string, parent string"), **k)
    return tree, {r.node: (r.root, r.depth, list(r.path)) for r in tree.collect()}


@pytest.mark.parametrize("every", [2, 8, 10**6])
def test_forest_long_chain_hot_parent_and_circles(spark, every):
    rnd = random.Random(1)
    nodes = [f"n{i}" for i in range(160)]
    edges = [(f"n{i}", f"n{rnd.randrange(i)}") for i in range(1, 60)] + [(f"n{i}", f"n{i - 1}") for i in range(61, 120)]
    edges += [("n120", "n121"), ("n121", "n122"), ("n122", "n120"), ("n123", "n122"), ("n124", "n123"), ("n125", "n125"), ("n126", "n125")]
    edges += [(f"n{i}", "n127") for i in range(128, 158)] + [("n158", "unknown"), (None, "n1"), ("n159", None), ("ghost", "n1")]
    tree, got = run(spark, nodes + nodes[:5] + [None], edges + edges[:9], every=every)
    want = brute(set(nodes), edges)
    assert got == want
    pairs = {(r.node, r.descendant, r.distance) for r in descendants(tree).collect()}
    assert pairs == {(a, n, len(p) - 1 - i) for n, (_, _, p) in want.items() for i, a in enumerate(p[:-1])}


def test_empty_and_tables_on_the_way(spark):
    assert run(spark, [], [])[1] == {}
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(scratch.folder(spark)[0].getParent().toString())
    before = {str(f.getPath()) for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)}
    tree, got = run(spark, ["a", "b"], [("b", "a")])
    after = {str(f.getPath()) for f in folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(folder)}
    assert got == {"a": ("a", 0, ["a"]), "b": ("a", 1, ["a", "b"])} and len(after - before) == 1
