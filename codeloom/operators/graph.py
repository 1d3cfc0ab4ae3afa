"""Graph operators over edge tables (src, dst).

Walks are driver loops over frontiers: the edges are written once, each round joins them
with the frontier, drops what was seen and writes its result, so lineage stays short.
Walks without a bound on their depth first draw chains of nodes together, so rounds
follow the branchings on a path and not its length. Graphs of up to SMALL_GRAPH edges,
which are counted first, are walked on the driver instead; both ways give the same rows.
"""

from __future__ import annotations

from collections import defaultdict, deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom import defaults as D
from codeloom.plans.tables import cut


def dedup_edges(edges: DataFrame, line: str | None = None) -> DataFrame:
    """One edge for each (src, dst): that of the least line, where lines are given."""
    if line is None:
        return edges.dropDuplicates(["src", "dst"])
    rest = [c for c in edges.columns if c not in ("src", "dst", line)]
    least = edges.groupBy("src", "dst").agg(F.min(F.struct(line, *rest)).alias("_m"))
    return least.select("src", "dst", "_m.*").select(*edges.columns)


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def undirected(edges: DataFrame) -> DataFrame:
    both = edges.select("src", "dst")
    return both.unionByName(reversed_edges(both)).distinct()


def _small(edges: DataFrame, limit: int) -> list | None:
    """The edges, which are cheap to read again, if there are no more than limit; else they are counted only."""
    return edges.collect() if limit and edges.count() <= limit else None


def _side(df: DataFrame) -> DataFrame:
    """df, which is cheap to read again, for a join: a few rows go to all tasks of the other side, more are sorted with it. The other side is never broadcast."""
    return F.broadcast(df) if df.limit(D.SIDE_ROWS + 1).count() <= D.SIDE_ROWS else df.hint("merge")


def _walk(step: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, depth) of start (node, depth) and what it reaches over step within depth, each node once at its least depth; both tables are written ones."""
    bases = [r[0] for r in start.select("depth").distinct().collect()]
    seen, front = start.limit(0), None
    for d in range(min(bases, default=0), depth + 1):
        own = start.filter(F.col("depth") == d).select("node")
        now = own if front is None else front.unionByName(own).distinct()
        now = cut(now.join(_side(seen.select("node")), "node", "left_anti").withColumn("depth", F.lit(d)))
        seen = seen.unionByName(now)
        if d == depth or (d >= max(bases, default=0) and now.isEmpty()):
            break
        front = step.join(_side(now.select("node")), F.col("src") == F.col("node")).select(F.col("dst").alias("node"))
    return seen


def _walk_on_driver(rows: list, first: dict, depth: float) -> dict:
    """_walk over edges in memory, as node: depth."""
    after, best, levels = defaultdict(list), dict(first), defaultdict(list)
    for r in rows:
        after[r["src"]].append(r["dst"])
    for node, d in first.items():
        levels[d].append(node)
    d = min(levels, default=0)
    while d < depth and d <= max(levels, default=0):
        for node in levels[d]:
            if best[node] == d:
                for other in after[node]:
                    if best.get(other, depth + 1) > d + 1:
                        best[other] = d + 1
                        levels[d + 1].append(other)
        d += 1
    return best


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, small: int = D.SMALL_GRAPH, both: bool = False) -> DataFrame:
    """(node, depth): what the seeds (node, or node with base) reach within depth, at its least depth, seeds not included.

    A seed's base counts as its depth, so seeds may start deeper; a node's depth is the least total over all seeds.
    With both, edges lead either way.
    """
    base = "base" if "base" in seeds.columns else None
    start = cut(seeds.select("node", (F.col(base) if base else F.lit(0)).cast("int").alias("depth")).groupBy("node").agg(F.min("depth").alias("depth")))
    step = cut(edges.select("src", "dst"))
    rows = _small(step, small // 2 if both else small)
    step = step.unionByName(reversed_edges(step)) if both else step
    if rows is not None:
        first, kind = {r["node"]: r["depth"] for r in start.collect()}, seeds.schema["node"].dataType.simpleString()
        best = _walk_on_driver(rows + [{"src": r["dst"], "dst": r["src"]} for r in rows if both], first, depth)
        return edges.sparkSession.createDataFrame([(n, d) for n, d in best.items() if n not in first], f"node {kind}, depth int")
    return _walk(step, start, depth).join(_side(start.select("node")), "node", "left_anti")


def _chains(edges: DataFrame, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A graph with its chains drawn together: links are nodes with one edge in and one out that keep (node) doesn't name.

    edges (src, dst, w), each pair once, none to itself. Gives the graph of the other nodes (src, dst, w), in which an edge
    of the chain's length stands for a chain; the links (node, chain, at), at being the way from the chain's head; the chains
    (chain, head, tail), whose ends aren't links; and links of closed chains (node, scc), named by their least. Pointers
    double each round, so rounds grow with the logarithm of the longest chain.
    """
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("_i"), F.min("src").alias("before"), F.min("w").alias("wb")).filter("_i = 1")
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("_o"), F.min("dst").alias("after"), F.min("w").alias("wa")).filter("_o = 1")
    links = into.join(out.hint("merge"), "node").select("node", "before", "wb", "after", "wa")
    links = cut(links if keep is None else links.join(_side(keep.select("node")), "node", "left_anti"))
    linked = links.select(F.col("node").alias("before"), F.lit(True).alias("_l"))
    # each link knows the way at from the link to, in the end the first of its chain (then from its head), and the least of the links between
    state = cut(links.join(linked.hint("merge"), "before", "left").select("node", F.when(F.col("_l"), F.col("before")).otherwise(F.col("node")).alias("to"), F.col("wb").alias("at"), F.col("_l").isNull().alias("done"), F.col("node").alias("least")))
    going = not state.filter("NOT done").isEmpty()
    while going:
        by = state.select(F.col("node").alias("to"), F.col("to").alias("_to"), F.col("at").alias("_at"), F.col("done").alias("_done"), F.col("least").alias("_least"))
        moved = state.filter("NOT done").join(by.hint("merge"), "to").select("node", F.col("_to").alias("to"), (F.col("at") + F.col("_at")).alias("at"), F.col("_done").alias("done"), F.least("least", "_least").alias("least"), (F.col("_done") | (F.col("_least") < F.col("least"))).alias("moved"))
        new = cut(state.filter("done").withColumn("moved", F.lit(False)).unionByName(moved))
        going = not new.filter("moved").isEmpty()  # else only closed chains are left, and each knows its least link
        state = new.drop("moved")
    inner = state.filter("done").select("node", F.col("to").alias("chain"), "at")
    chains = cut(inner.join(links.hint("merge"), "node").groupBy("chain").agg(F.min_by("before", "at").alias("head"), F.max_by("after", "at").alias("tail"), F.max(F.col("at") + F.col("wa")).alias("w")))
    bare = edges.join(links.select(F.col("node").alias("src")).hint("merge"), "src", "left_anti").join(links.select(F.col("node").alias("dst")).hint("merge"), "dst", "left_anti").select("src", "dst", "w")
    drawn = chains.filter("head <> tail").select(F.col("head").alias("src"), F.col("tail").alias("dst"), "w")
    rest = cut(bare.unionByName(drawn).groupBy("src", "dst").agg(F.min("w").alias("w")))
    return rest, inner, chains.select("chain", "head", "tail"), state.filter("NOT done").select("node", F.col("least").alias("scc"))


def distances(edges: DataFrame, seeds: DataFrame, small: int = D.SMALL_GRAPH) -> DataFrame:
    """(node, depth) of the seeds, at 0, and all that they reach, however far. Rounds follow the branchings on a path, since chains are drawn together."""
    start, step = cut(seeds.select("node").distinct()), cut(edges.select("src", "dst").filter("src <> dst").distinct())
    if (rows := _small(step, small)) is not None:
        best = _walk_on_driver(rows, {r["node"]: 0 for r in start.collect()}, float("inf"))
        return edges.sparkSession.createDataFrame(list(best.items()), f"node {seeds.schema['node'].dataType.simpleString()}, depth long")
    rest, inner, chains, _ = _chains(step.withColumn("w", F.lit(1).cast("long")), start)
    known = front = cut(start.withColumn("depth", F.lit(0).cast("long")))
    while not front.isEmpty():
        sent = rest.join(_side(front), F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("depth") + F.col("w")).alias("depth"))
        front = cut(sent.join(known.withColumnRenamed("depth", "_d").hint("merge"), "node", "left").filter("_d IS NULL OR depth < _d").select("node", "depth"))
        known = cut(known.unionByName(front).groupBy("node").agg(F.min("depth").alias("depth")))
    met = chains.join(known.hint("merge"), F.col("head") == F.col("node")).select("chain", "depth")
    return known.unionByName(inner.join(met.hint("merge"), "chain").select("node", (F.col("depth") + F.col("at")).alias("depth")))


def frontier_cut(edges: DataFrame, seeds: DataFrame, reached: DataFrame, depth: int) -> bool:
    """Whether the depth cut the walk: a node at the last depth has an edge to one that wasn't seen."""
    last = reached.filter(F.col("depth") == depth).select("node")
    if depth == 0:
        last = seeds.select("node")
    seen = cut(reached.select("node").unionByName(seeds.select("node")))
    return not edges.join(_side(cut(last)), F.col("src") == F.col("node")).select(F.col("dst").alias("node")).join(_side(seen), "node", "left_anti").isEmpty()


def callees(edges: DataFrame, seeds: DataFrame, depth: int = D.CALL_DEPTH, hide_external: bool = False) -> DataFrame:
    """(target, target_kind, depth): what call edges (src, dst, kind of target) lead to; externals come out once and are not walked."""
    inner = edges.filter("target_kind = 'resolved'")
    near = bfs(inner, seeds, depth).select(F.col("node").alias("target"), F.lit("resolved").alias("target_kind"), "depth")
    if hide_external:
        return near
    walked = cut(near.filter(F.col("depth") < depth).select(F.col("target").alias("node"), "depth").unionByName(seeds.select("node", F.lit(0).alias("depth"))))
    outer = edges.filter("target_kind <> 'resolved'").join(_side(walked), F.col("src") == F.col("node")).groupBy(F.col("dst").alias("target"), "target_kind").agg((F.min("depth") + 1).alias("depth"))
    return near.unionByName(outer)


def callers(edges: DataFrame, seeds: DataFrame, depth: int = D.CALL_DEPTH, keep: Column | None = None) -> DataFrame:
    """(node, depth) of callers. An edge that keep rejects isn't reported but is walked on; a caller comes out at the least depth of an edge kept."""
    back = edges.filter("target_kind = 'resolved'") if "target_kind" in edges.columns else edges
    seen = bfs(reversed_edges(back.select("src", "dst")), seeds, depth)
    if keep is None:
        return seen
    first = cut(seeds.select("node", F.lit(0).alias("depth")))
    at = cut(seen.unionByName(first).filter(F.col("depth") < depth))
    kept = back.filter(keep).join(_side(at), F.col("dst") == F.col("node"))
    return kept.groupBy(F.col("src").alias("node")).agg((F.min("depth") + 1).alias("depth")).join(_side(first.select("node")), "node", "left_anti")


def shortest_path(edges: DataFrame, start: DataFrame, goal: DataFrame, depth: int = D.PATH_DEPTH, small: int = D.SMALL_GRAPH) -> DataFrame:
    """(step, node) of a shortest path from any start to any goal; no rows if there is none. Of equal ones the first in (src, dst) order of discovery."""
    spark, kind = edges.sparkSession, start.schema["node"].dataType.simpleString()
    schema = f"step int, node {kind}"
    both = start.join(goal, "node").orderBy("node").limit(1).collect()
    if both:
        return spark.createDataFrame([(0, both[0]["node"])], schema)
    edges = cut(edges.select("src", "dst").distinct())
    if (rows := _small(edges, small)) is not None:
        after = defaultdict(list)
        for s, t in sorted((r["src"], r["dst"]) for r in rows):
            after[s].append(t)
        ends, queue = {r["node"] for r in goal.collect()}, deque(sorted(r["node"] for r in start.collect()))
        before, far = dict.fromkeys(queue), dict.fromkeys(queue, 0)
        while queue:
            node = queue.popleft()
            if far[node] < depth:
                for other in after[node]:
                    if other not in before:
                        before[other], far[other] = node, far[node] + 1
                        if other in ends:
                            path = [other]
                            while before[path[-1]] is not None:
                                path.append(before[path[-1]])
                            return spark.createDataFrame(list(enumerate(reversed(path))), schema)
                        queue.append(other)
        return spark.createDataFrame([], schema)
    # rank: the place in the order of discovery, which the parent's rank and then the node decide
    known = cut(start.select("node", F.lit(0).alias("depth"), F.lit(None).cast(kind).alias("parent"), F.row_number().over(Window.orderBy("node")).cast("long").alias("rank")))
    for d in range(depth):
        front = known.filter(F.col("depth") == d)
        found = front.join(edges.select("src", "dst"), front["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("rank", F.col("src").alias("parent"))).alias("m"))
        fresh = found.join(known, "node", "left_anti").select("node", F.lit(d + 1).alias("depth"), "m.parent", F.col("m.rank").alias("above"))
        # nodes of one parent keep their order, so (parent's rank, node) is the order of discovery
        ranked = fresh.withColumn("rank", F.row_number().over(Window.orderBy("above", "node")).cast("long")).drop("above")
        known = cut(known.unionByName(ranked))
        hit = known.filter(F.col("depth") == d + 1).join(goal, "node").orderBy("rank").limit(1).collect()
        if hit:
            path, at = [hit[0]["node"]], hit[0]["parent"]
            while at is not None:
                path.append(at)
                at = known.filter(F.col("node") == F.lit(at)).first()["parent"]
            return spark.createDataFrame(list(enumerate(reversed(path))), schema)
        if known.filter(F.col("depth") == d + 1).isEmpty():
            break
    return spark.createDataFrame([], schema)


def path_outcome(edges: DataFrame, start: DataFrame, goal: DataFrame, depth: int = D.PATH_DEPTH) -> str:
    """found, cut (the depth ended the search) or none (all that can be reached was searched)."""
    if not shortest_path(edges, start, goal, depth).isEmpty():
        return "found"
    return "cut" if frontier_cut(edges, start, bfs(edges, start, depth), depth) else "none"


def closure(edges: DataFrame, origins: DataFrame, depth: int = D.CLOSURE_DEPTH) -> DataFrame:
    """(origin, node, depth): what each origin reaches within depth, in rounds over all origins at once."""
    known = fresh = cut(origins.select(F.col("node").alias("origin"), "node", F.lit(0).alias("depth")).distinct())
    step = cut(edges.select("src", "dst"))
    for d in range(depth):
        met = step.join(_side(fresh.select("origin", "node")), F.col("src") == F.col("node")).select("origin", F.col("dst").alias("node")).distinct()
        fresh = cut(met.join(_side(known.select("origin", "node")), ["origin", "node"], "left_anti").withColumn("depth", F.lit(d + 1)))
        if fresh.isEmpty():
            break
        known = known.unionByName(fresh)
    return known.filter("depth > 0")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    return bfs(edges, seeds, depth, both=True)


def _least_reaching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, color): the least node with a path to each."""
    colors = cut(nodes.select("node", F.col("node").alias("color")))
    while True:
        sent = edges.join(colors.hint("merge"), F.col("src") == F.col("node")).groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("sent"))
        new = cut(colors.join(sent.hint("merge"), "node", "left").select("node", F.least("color", F.coalesce("sent", "color")).alias("color")))
        same = new.join(colors.hint("merge"), ["node", "color"], "left_anti").isEmpty()
        colors = new
        if same:
            return colors


def _scc_by_joins(edges: DataFrame) -> DataFrame:
    """Chains are drawn together and nodes without an edge in or out fall off, in turns; then those that the least node reaches and that reach it back, within one color, are a component; the rest goes on.

    A chain's links are of its ends' component if both ends are of one. Coloring takes rounds by the width of what is left,
    in which each node branches or joins.
    """
    edges = cut(edges.select("src", "dst").filter("src <> dst").distinct().withColumn("w", F.lit(1).cast("long")))
    done, drawn = edges.select(F.col("src").alias("node"), F.col("src").alias("scc")).limit(0), []
    while not edges.isEmpty():
        before, after = -1, edges.count()
        while after not in (0, before):
            before = after
            edges, inner, chains, rings = _chains(edges)
            done = done.unionByName(rings)
            drawn.append((inner, chains))
            edges = cut(edges.join(edges.select(F.col("dst").alias("src")).distinct().hint("merge"), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct().hint("merge"), "dst", "left_semi").select("src", "dst", "w"))
            after = edges.count()
        if not after:
            break
        nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
        colors = _least_reaching(edges, nodes)
        a, b = colors.select(F.col("node").alias("src"), F.col("color").alias("ca")), colors.select(F.col("node").alias("dst"), F.col("color").alias("cb"))
        inside = cut(edges.join(a.hint("merge"), "src").join(b.hint("merge"), "dst").filter("ca = cb").select("src", "dst", F.col("ca").alias("color")))
        found = cut(colors.filter("node = color").select("node", F.col("color").alias("scc")))
        while True:
            back = inside.join(_side(found.select(F.col("node").alias("dst"), "scc")), "dst").filter("scc = color").select(F.col("src").alias("node"), "scc").distinct()
            more = cut(back.join(_side(found), ["node", "scc"], "left_anti"))
            if more.isEmpty():
                break
            found = cut(found.unionByName(more))
        done = done.unionByName(found)
        gone = _side(found.select("node"))
        edges = cut(edges.join(gone, F.col("src") == F.col("node"), "left_anti").join(gone, F.col("dst") == F.col("node"), "left_anti"))
    for inner, chains in reversed(drawn):
        done = cut(done)
        at = lambda end: done.select(F.col("node").alias(end), F.col("scc").alias(f"_{end}")).hint("merge")  # noqa: E731, B023
        ends = chains.join(at("head"), "head", "left").join(at("tail"), "tail", "left").select("chain", "head", F.coalesce("_head", "head").alias("scc"), F.coalesce("_tail", "tail").alias("_t"))
        closed = cut(ends.filter("scc = _t"))
        links = inner.join(closed.select("chain", "scc").hint("merge"), "chain").select("node", "scc")
        done = done.unionByName(links).unionByName(closed.filter("scc = head").select(F.col("head").alias("node"), "scc")).distinct()
    return done


def _scc_on_driver(rows: list) -> list[tuple]:
    """Tarjan's algorithm without recursion; each component is named by its least node."""
    after, nodes = defaultdict(list), {}
    for s, t in sorted((r["src"], r["dst"]) for r in rows):
        after[s].append(t)
        nodes[s] = nodes[t] = True
    index, low, on, stack, out = {}, {}, set(), [], []
    for root in nodes:
        if root in index:
            continue
        work = [(root, iter(after[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for other in rest:
                if other not in index:
                    index[other] = low[other] = len(index)
                    stack.append(other)
                    on.add(other)
                    work.append((other, iter(after[other])))
                    break
                if other in on:
                    low[node] = min(low[node], index[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while True:
                        part.append(stack.pop())
                        on.discard(part[-1])
                        if part[-1] == node:
                            break
                    out += [(x, min(part)) for x in part]
    return out


def strong_components(edges: DataFrame, small: int = D.SMALL_GRAPH) -> DataFrame:
    """(node, scc) of nodes in components of two at least, named by their least node."""
    edges = cut(edges.select("src", "dst").distinct())
    if (rows := _small(edges, small)) is not None:
        kind = edges.schema["src"].dataType.simpleString()
        found = edges.sparkSession.createDataFrame(_scc_on_driver(rows), f"node {kind}, scc {kind}")
    else:
        found = cut(_scc_by_joins(edges))
    large = found.groupBy("scc").agg(F.count("*").alias("_n"), F.min("node").alias("_least")).filter("_n > 1").select("scc", "_least")
    return found.join(large.hint("merge"), "scc").select("node", F.col("_least").alias("scc"))


def cycles(edges: DataFrame, min_size: int = D.CYCLE_SIZE, include_refs: bool = False, small: int = D.SMALL_GRAPH) -> DataFrame:
    """(size, members): strongly connected components of min_size at least, and self-edges; largest first, then by members."""
    used = edges if include_refs or "kind" not in edges.columns else edges.filter("kind IS NULL OR kind <> 'ref'")
    parts = cut(strong_components(used, small))
    grouped = parts.groupBy("scc").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members")).filter(F.col("size") >= min_size).select("size", "members")
    own = used.filter("src = dst").select(F.col("src").alias("node")).distinct().join(_side(parts.select("node")), "node", "left_anti").select(F.lit(1).cast("long").alias("size"), F.array("node").alias("members"))
    return grouped.unionByName(own).orderBy(F.col("size").desc(), "members")


def implementors(types: DataFrame, name: str, direct: bool = False) -> DataFrame:
    """(path, line, name, via): types whose bases name the given one, and, unless direct, those that name these in turn. types: path, line, name, bases. The lists grow with the square of a chain's length; implementor_depths gives their sizes alone."""
    from codeloom.functions.text import type_key

    known = types.select("path", "line", "name", type_key(F.col("name")).alias("key"), F.explode("bases").alias("base")).withColumn("base", type_key(F.col("base"))).distinct()
    known = cut(known)
    if (rows := _small(known, D.SMALL_GRAPH)) is not None:
        return _implementors_on_driver(types, rows, known.sparkSession.range(1).select(type_key(F.lit(name))).first()[0], direct)
    key = type_key(F.lit(name))
    front = known.filter(F.col("base") == key).select("path", "line", "name", "key", F.expr("CAST(array() AS ARRAY<STRING>)").alias("via")).dropDuplicates(["path", "line"])
    found = cut(front)
    front = found
    while not direct:
        step = known.join(_side(front.select(F.col("key").alias("base"), "via", F.col("name").alias("parent"))), "base").select("path", "line", "name", "key", F.concat("via", F.array("parent")).alias("via"))
        one = step.groupBy("path", "line", "name", "key").agg(F.min("via").alias("via"))
        front = cut(one.join(_side(found.select("path", "line")), ["path", "line"], "left_anti"))
        if front.isEmpty():
            break
        found = cut(found.unionByName(front))
    return found.select("path", "line", "name", "via")


def implementor_depths(types: DataFrame, name: str, small: int = D.SMALL_GRAPH) -> DataFrame:
    """(path, line, name, depth): implementors() with the number of types between in place of their list, for hierarchies of any depth."""
    from codeloom.functions.text import type_key

    known = cut(types.select("path", "line", "name", type_key(F.col("name")).alias("dst"), F.explode("bases").alias("base")).withColumn("src", type_key(F.col("base"))).drop("base").distinct())
    root = known.sparkSession.range(1).select(type_key(F.lit(name)).alias("node"))
    far = cut(distances(known, root, small))
    return known.join(far.hint("merge"), F.col("src") == F.col("node")).groupBy("path", "line", "name").agg(F.min("depth").cast("int").alias("depth"))


def _implementors_on_driver(types: DataFrame, rows: list, key: str, direct: bool) -> DataFrame:
    by_base = defaultdict(list)
    for r in rows:
        by_base[r["base"]].append(r)
    found, front = {}, [(key, ())]
    while front:
        fresh = {}
        for base, via in front:
            for r in by_base[base]:
                place = (r["path"], r["line"])
                if place not in found and (place not in fresh or via < fresh[place][1]):
                    fresh[place] = (r, via)
        found |= fresh
        front = [] if direct else [(r["key"], (*via, r["name"])) for r, via in fresh.values()]
    kind = types.schema["line"].dataType.simpleString()
    return types.sparkSession.createDataFrame([(p, n, r["name"], list(via)) for (p, n), (r, via) in found.items()], f"path string, line {kind}, name string, via array<string>")


def ancestors(types: DataFrame, name: str, depth: int) -> DataFrame:
    """(name, depth, resolved): the bases of a type and theirs, each once; names without a type are given at depth 1 only."""
    from codeloom.functions.text import type_key

    bases = types.select(type_key(F.col("name")).alias("src"), F.explode("bases").alias("b")).select("src", type_key(F.col("b")).alias("dst"))
    reached = bfs(bases, types.sparkSession.createDataFrame([(name,)], "node string"), depth)
    reached = cut(reached)
    names = types.select(type_key(F.col("name")).alias("node"), F.lit(True).alias("resolved")).join(_side(reached.select("node")), "node", "left_semi").distinct()
    return reached.join(names, "node", "left").filter("resolved OR depth = 1").select(F.col("node").alias("name"), "depth", F.coalesce("resolved", F.lit(False)).alias("resolved"))


def graph_stats(edges: DataFrame) -> DataFrame:
    """Edges by kind of target, and distinct sources."""
    return edges.agg(F.countDistinct("src").alias("functions"), *[F.count_if(F.col("target_kind") == k).alias(k) for k in ("resolved", "external", "bare")])
