import itertools
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import graph as G


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


@pytest.mark.parametrize("small", [0, 1000], ids=["joins", "driver"])
def test_paths(spark, small):
    chain = edges(spark, [("a", "b"), ("b", "c")])
    path = lambda e, s, t, d: [r.node for r in G.shortest_path(e, nodes(spark, s), nodes(spark, t), d, small).orderBy("step").collect()]
    assert path(chain, "a", "c", 12) == ["a", "b", "c"]
    assert path(chain, "a", "c", 1) == [] and path(chain, "a", "a", 3) == ["a"]
    assert G.path_outcome(chain, nodes(spark, "a"), nodes(spark, "c"), 1) == "cut"
    loop = edges(spark, [("a", "b"), ("b", "a")])
    assert G.path_outcome(loop, nodes(spark, "a"), nodes(spark, "z"), 1) == "none"


def test_joins_and_driver_agree(spark):
    rnd = random.Random(4)
    pairs = sorted({(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(50)})
    e, s = edges(spark, pairs), nodes(spark, "n0", "n7")
    for depth in (1, 3):
        assert sorted(G.bfs(e, s, depth, 0).collect()) == sorted(G.bfs(e, s, depth).collect())
    a, b = (sorted(tuple(r) for r in G.strong_components(e, x).collect()) for x in (0, 1000))
    groups = lambda rows: sorted(sorted(n for n, _ in g) for _, g in itertools.groupby(sorted(rows, key=lambda r: r[1]), key=lambda r: r[1]))
    assert groups(a) == groups(b)
    for t in ("n3", "n11", "n20"):
        one, two = (G.shortest_path(e, s, nodes(spark, t), 12, x).count() for x in (0, 1000))
        assert one == two


def test_rejected_edges_are_walked(spark):
    e = edges(spark, [("c1", "t"), ("c2", "c1"), ("c3", "c2")]).withColumn("target_kind", F.lit("resolved"))
    got = {r.node: r.depth for r in G.callers(e, nodes(spark, "t"), 3, keep=F.col("src") != "c1").collect()}
    assert got == {"c2": 2, "c3": 3}
    reached = G.bfs(G.reversed_edges(e), nodes(spark, "t"), 2)
    assert G.frontier_cut(G.reversed_edges(e), nodes(spark, "t"), reached, 2)
    assert not G.frontier_cut(G.reversed_edges(e), nodes(spark, "t"), G.bfs(G.reversed_edges(e), nodes(spark, "t"), 3), 3)


def test_callees_give_externals_once(spark):
    rows = [("a", "b", "resolved"), ("a", "os.x", "external"), ("b", "os.x", "external"), ("b", "c", "resolved")]
    e = spark.createDataFrame(rows, "src string, dst string, target_kind string")
    got = {(r.target, r.depth) for r in G.callees(e, nodes(spark, "a"), 2).collect()}
    assert got == {("b", 1), ("c", 2), ("os.x", 1)}
    assert {r.target for r in G.callees(e, nodes(spark, "a"), 2, hide_external=True).collect()} == {"b", "c"}


@pytest.mark.parametrize("small", [0, 1000])
def test_cycles(spark, small):
    rows = [("C", "D", "import"), ("D", "C", "import"), ("A", "B", "ref"), ("B", "A", "ref"), ("S", "S", "import"), ("x", "C", "import")]
    e = spark.createDataFrame(rows, "src string, dst string, kind string")
    assert [r.members for r in G.cycles(e, small=small).collect()] == [["C", "D"], ["S"]]
    assert [r.members for r in G.cycles(e, include_refs=True, small=small).collect()] == [["A", "B"], ["C", "D"], ["S"]]


def test_implementors(spark, monkeypatch):
    rows = [("f", 1, "Base", []), ("f", 2, "One", ["m::Base<T>"]), ("g", 3, "Two", ["One"]), ("g", 4, "Both", ["One", "Base"])]
    types = spark.createDataFrame(rows, "path string, line int, name string, bases array<string>")
    for small in (0, 1000):
        monkeypatch.setattr(G.D, "SMALL_GRAPH", small)
        got = {r.name: r.via for r in G.implementors(types, "Base").collect()}
        assert got == {"One": [], "Both": [], "Two": ["One"]}
        assert {r.name for r in G.implementors(types, "Base", direct=True).collect()} == {"One", "Both"}
    assert {(r.name, r.depth, r.resolved) for r in G.ancestors(types, "Two", 3).collect()} == {("One", 1, True), ("Base", 2, True)}


def test_dedup_and_stats(spark):
    e = spark.createDataFrame([("a", "b", 5), ("a", "b", 2), ("b", "b", 1)], "src string, dst string, line int")
    assert sorted(tuple(r) for r in G.dedup_edges(e, "line").collect()) == [("a", "b", 2), ("b", "b", 1)]


def rounds(monkeypatch):
    """Counts the tables that walks write."""
    written, put = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: written.append(1) or put(df))
    return written


def test_cycles_take_few_rounds_on_long_rings_and_chains(spark, monkeypatch):
    ring = [(f"r{i:03}", f"r{(i + 1) % 300:03}") for i in range(300)]
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(300)]
    hung = [("r007", "x1"), ("x1", "x2"), ("x2", "c000"), ("c299", "y1"), ("y1", "y2"), ("y2", "c299"), ("y2", "z")]
    written = rounds(monkeypatch)
    got = sorted(tuple(r) for r in G.strong_components(edges(spark, ring + chain + hung), 0).collect())
    assert got == sorted([(a, "r000") for a, _ in ring] + [(n, "c299") for n in ("c299", "y1", "y2")])
    assert len(written) < 100


def test_components_of_chains_and_branches_agree(spark):
    rnd = random.Random(8)
    pairs = {(f"n{rnd.randrange(14)}", f"n{rnd.randrange(14)}") for _ in range(16)}
    for k, (s, t) in enumerate(sorted(pairs)):
        if k % 2:
            pairs = pairs - {(s, t)} | {(s, f"m{k}"), (f"m{k}", f"l{k}"), (f"l{k}", t)}
    e = edges(spark, sorted(pairs))
    assert sorted(G.strong_components(e, 0).collect()) == sorted(G.strong_components(e).collect())


def test_implementors_of_deep_hierarchies(spark, monkeypatch):
    rows = [("f", i, f"T{i}", [f"m::T{i - 1}<X>"] if i else []) for i in range(300)] + [("g", 1, "Side", ["T150"]), ("g", 2, "Both", ["T299", "Side"])]
    types = spark.createDataFrame(rows, "path string, line int, name string, bases array<string>")
    written = rounds(monkeypatch)
    for small in (0, 1000):
        got = {r.name: r.depth for r in G.implementor_depths(types, "T0", small).collect()}
        assert got == {f"T{i}": i - 1 for i in range(1, 300)} | {"Side": 150, "Both": 151}
    assert len(written) < 60


def test_large_graphs_stay_off_the_driver(spark, monkeypatch):
    e, s = edges(spark, [(f"n{i}", f"n{(7 * i + k) % 400}") for i in range(400) for k in (1, 5)]), nodes(spark, "n0")
    sent, frame = [], type(e)
    take = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: [rows := take(self), sent.append(len(rows))][0])
    seen = G.bfs(e, s, 2, 10)
    back = G.bfs(e, s, 2, 10, both=True)
    assert max(sent) <= 10
    assert sorted(map(tuple, take(seen))) == sorted(map(tuple, take(G.bfs(e, s, 2)))) and sorted(map(tuple, take(back))) == sorted(map(tuple, take(G.bfs(G.undirected(e), s, 2))))
