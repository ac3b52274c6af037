"""Parent-child rows to hierarchies: cycles, paths, depth, root and descendants.

Rows with a null or blank end are dropped, repeated rows count once. Entities on a cycle (a self-loop included) are reported,
and the edges inside a cycle are not followed; an entity on a cycle that nothing outside contains is thus a root. An entity
with several parents has one path for each way from a root. Empty input gives empty results."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..tables import norm_enum, norm_id

#: Components of up to so many edges are co-located in one task (about 100 bytes an edge); larger ones are worked on by joins.
MAX_COLOCATED_EDGES = 1_000_000


def contains_edges(relationships: DataFrame, kind: str = "CONTAINS") -> DataFrame:
    """Distinct (src, dst) of one relationship type, ids in normal form."""
    return relationships.where(norm_enum("relationship_type") == kind).select(norm_id("source_entity_id").alias("src"), norm_id("target_entity_id").alias("dst")).where("src is not null and dst is not null").distinct()


def peel(edges: DataFrame, shrink: float = 0.7, max_rounds: int | None = 30) -> DataFrame:
    """Takes away edges that can be on no cycle: into nodes that nothing leaves, or out of nodes that nothing enters. Goes
    on while a round leaves less than ``shrink`` of the edges."""
    edges = cut(edges)
    n = edges.count()
    for _ in count() if max_rounds is None else range(max_rounds):
        if n == 0:
            break
        inner = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
        edges = cut(inner.select("src", "dst"))
        before, n = n, edges.count()
        if n > shrink * before:
            break
    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, component): connected components of the undirected edges, named by their smallest node.

    Alternates large-star and small-star steps until nothing changes, which needs about log(n) rounds; partial aggregation
    keeps hubs from gathering in one task, and the joins by node are inner joins that adaptive execution splits at a hub.
    Every round is written to the shared folder."""
    e = cut(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).where("a <> b").distinct())
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    mark = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b")))
        e = cut(small.where("a <> b").distinct())
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
        if now == mark:
            break
        mark = now
    return nodes.join(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def colour_walk(targets: list[list[int]]) -> tuple[list[int], list[tuple[int, int]]]:
    """Strongly connected components of a small graph by an iterative depth-first walk with node colours.

    targets: for each node its successors. Returns for each node the component's number, and the back edges: edges to a
    node that is still on the walk's path (grey)."""
    n, white, grey, black = len(targets), 0, 1, 2
    colour, low, order, comp, stack, backs, clock, made = [white] * n, [0] * n, [0] * n, [-1] * n, [], [], 0, 0
    for start in range(n):
        if colour[start] != white:
            continue
        walk: list[tuple[int, Iterator[int]]] = []

        def enter(v: int) -> None:
            nonlocal clock
            colour[v] = grey
            order[v] = low[v] = clock
            clock += 1
            stack.append(v)
            walk.append((v, iter(targets[v])))

        enter(start)
        while walk:
            v, rest = walk[-1]
            for w in rest:
                if colour[w] == white:
                    enter(w)
                    break
                if colour[w] == grey:
                    backs.append((v, w))
                if comp[w] < 0:
                    low[v] = min(low[v], order[w])
            else:
                walk.pop()
                colour[v] = black
                if walk:
                    low[walk[-1][0]] = min(low[walk[-1][0]], low[v])
                if low[v] == order[v]:
                    while True:
                        w = stack.pop()
                        comp[w] = made
                        if w == v:
                            break
                    made += 1
    return comp, backs


def _component_cycles(rows: pa.Table) -> pa.Table:
    src, dst, kind = rows["src"].to_pylist(), rows["dst"].to_pylist(), rows["src"].type
    ids = sorted({*src, *dst})
    at = {x: i for i, x in enumerate(ids)}
    targets: list[list[int]] = [[] for _ in ids]
    for s, d in sorted(zip(src, dst)):
        targets[at[s]].append(at[d])
    comp, backs = colour_walk(targets)
    size: dict[int, int] = {}
    first: dict[int, str | int] = {}
    for i, c in enumerate(comp):
        size[c] = size.get(c, 0) + 1
        first.setdefault(c, ids[i])
    selfs = {v for v, w in backs if v == w}
    back_to: dict[int, list[str | int]] = {}
    for v, w in backs:
        back_to.setdefault(v, []).append(ids[w])
    on = [i for i, c in enumerate(comp) if size[c] > 1 or i in selfs]
    return pa.table({"node": [ids[i] for i in on], "cycle": [first[comp[i]] for i in on], "back_to": [back_to.get(i, []) for i in on]}, pa.schema([("node", kind), ("cycle", kind), ("back_to", pa.list_(kind))]))


def _contract(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """One round of shortening: about a quarter of the nodes that have one way out are merged into the node it leads to, so a
    ring or chain of n nodes is gone after about log(n) rounds. Returns the edges left (with loops where a ring closed) and,
    for undoing, the edges into and out of the merged nodes (before, node, into) and which of these had a loop. None if no
    node has one way out."""
    single = edges.where("src <> dst").groupBy("src").agg(F.min("dst").alias("into"), F.count(F.lit(1)).alias("n")).where("n = 1").select(F.col("src").alias("node"), "into")
    # a node merges if its coin is heads and its target's is tails, so no two merges touch; the coin changes by round
    single = cut(single)
    if single.isEmpty():
        return None
    for salt in count():
        heads = lambda c: F.xxhash64(c, F.lit(salt)).bitwiseAND(1) == 0  # noqa: E731, B023
        merged = cut(single.where(heads("node") & ~heads("into")))
        if not merged.isEmpty():
            break
    undo = cut(merged.join(edges.where("src <> dst").select(F.col("src").alias("before"), F.col("dst").alias("node")), "node"))
    looped = cut(merged.select("node").join(edges.where("src = dst").select(F.col("src").alias("node")), "node", "left_semi"))
    kept = edges.join(merged.select(F.col("node").alias("src")), "src", "left_anti").join(merged.select(F.col("node").alias("dst"), "into"), "dst", "left")
    return cut(kept.select("src", F.coalesce("into", "dst").alias("dst")).distinct()), undo, looped


def _spread_cycles(left: DataFrame) -> DataFrame:
    """(node, cycle) by joins. In turns: peel; spread the largest name along the edges to a fixpoint (forward colour); walk
    back from each colour's origin within its colour. What is reached is that origin's cycle; the rest goes to the next turn."""
    found = None
    left = peel(left, shrink=0.999, max_rounds=None)
    while not left.isEmpty():
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        colour = cut(nodes.select("node", F.col("node").alias("colour")))
        while True:
            got = left.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("colour").alias("came"))
            step = cut(colour.join(got, "node", "left").select("node", F.greatest("colour", "came").alias("colour"), (F.col("came") > F.col("colour")).alias("moved")))
            colour = step.select("node", "colour")
            if step.where("moved").isEmpty():
                break
        same = cut(left.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c")), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("d")), "dst").where("c = d").select("src", "dst", F.col("c").alias("colour")))
        reach = cut(colour.where("node = colour"))
        frontier = reach
        while not frontier.isEmpty():
            frontier = cut(same.join(frontier.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct().join(reach, ["node", "colour"], "left_anti"))
            reach = reach.unionByName(frontier)
        reach = cut(reach)
        cycles = reach.join(reach.groupBy("colour").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "colour").select("node", F.col("colour").alias("cycle"))
        found = cycles if found is None else found.unionByName(cycles)
        gone = reach.select("node")
        left = peel(left.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti"), shrink=0.999, max_rounds=None)
    return left.select(F.col("src").alias("node"), F.col("src").alias("cycle")) if found is None else found


def _large_cycles(edges: DataFrame) -> DataFrame:
    """(node, cycle, back_to) for components too large for one task, by joins only: chains and rings are shortened, cycles
    found among what is left, and the merged nodes brought back in turn. A merged node is on the cycle of the node it was
    merged into if an edge from that cycle led to it."""
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("cycle"))
    plain = cut(edges.where("src <> dst"))
    left, undone, size = plain, [], plain.count()
    while (step := _contract(left)) is not None:
        left = step[0]
        undone.append(step[1:])
        before, size = size, left.count()
        if size > 0.9 * before:  # no long chains are left
            break
    label = _spread_cycles(left.where("src <> dst"))
    rings = left.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("cycle")).join(label.select("node"), "node", "left_anti")
    label = cut(label.unionByName(rings))
    for undo, looped in reversed(undone):
        of = undo.join(label.select(F.col("node").alias("into"), "cycle"), "into")
        back = of.join(label.select(F.col("node").alias("before"), F.col("cycle").alias("theirs")), "before").where("cycle = theirs").select("node", "cycle").distinct()
        alone = looped.join(back, "node", "left_anti").select("node", F.col("node").alias("cycle"))
        label = cut(label.unionByName(back).unionByName(alone))
    label = label.join(label.groupBy("cycle").agg(F.min("node").alias("least")), "cycle").select("node", F.col("least").alias("cycle"))
    label = cut(label.unionByName(loops.join(label.select("node"), "node", "left_anti")))
    # steps from each cycle's smallest node; an edge that leads no further from it closes a way round
    inner = cut(edges.join(label.withColumnRenamed("node", "src"), "src").join(label.select(F.col("node").alias("dst"), F.col("cycle").alias("c")), "dst").where("cycle = c").select("src", "dst"))
    far = frontier = cut(label.where("node = cycle").select("node", F.lit(0).alias("depth")))
    for depth in count(1):
        frontier = cut(inner.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(far, "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        far = far.unionByName(frontier)
    closing = inner.join(far.select(F.col("node").alias("src"), F.col("depth").alias("d0")), "src").join(far.select(F.col("node").alias("dst"), F.col("depth").alias("d1")), "dst").where("d1 <= d0")
    backs = closing.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("back_to"))
    return label.join(backs, "node", "left").select("node", "cycle", F.coalesce("back_to", F.array().cast(backs.schema["back_to"].dataType)).alias("back_to"))


def find_cycles(edges: DataFrame, max_colocated_edges: int = MAX_COLOCATED_EDGES) -> DataFrame:
    """(node, cycle, back_to), ids or numbers as in edges: the nodes that lie on a cycle, the smallest node of their strongly connected component, and
    where back edges lead from them: edges without which no cycle is left.

    Peels off what cannot be on a cycle, finds the connected components of the rest, and co-locates each for a depth-first
    walk with node colouring; back edges lead to a node on the walk's path. A component of more than max_colocated_edges is
    never gathered in one task: it is worked on by joins, with the same nodes and cycles, and its back edges are those
    that lead no further from the cycle's smallest node."""
    core, kind = peel(edges), edges.schema["src"].dataType.simpleString()
    if core.isEmpty():
        return core.select(F.col("src").alias("node"), F.col("src").alias("cycle"), F.array().cast(f"array<{kind}>").alias("back_to"))
    comp = components(core)
    tagged = cut(core.join(comp.withColumnRenamed("node", "src"), "src"))
    large = cut(tagged.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_colocated_edges).select("component"))
    out = tagged.join(large, "component", "left_anti").groupBy("component").applyInArrow(_component_cycles, f"node {kind}, cycle {kind}, back_to array<{kind}>")
    return out if large.isEmpty() else out.unionByName(_large_cycles(tagged.join(large, "component", "left_semi").select("src", "dst")))


def hierarchy_paths(edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """(node, root, depth, path): for each node each way from a root, path = the nodes from the root to it.

    Pointer doubling: in each round the ways of a node to an ancestor are joined with the ways of that ancestor, so a
    hierarchy of depth d takes log2(d) rounds of one join, each written to the shared folder."""
    inside = cycles.select(F.col("node").alias("src"), F.col("cycle").alias("c1"))
    onto = cycles.select(F.col("node").alias("dst"), F.col("cycle").alias("c2"))
    dag = edges.join(inside, "src", "left").join(onto, "dst", "left").where("c1 is null or c2 is null or c1 <> c2").select("src", "dst")
    dag = cut(dag)
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    roots = nodes.join(dag.select(F.col("dst").alias("node")), "node", "left_anti").select("node", F.col("node").alias("root"), F.array("node").alias("path"))
    state = cut(dag.select(F.col("dst").alias("node"), F.col("src").alias("top"), F.array("src", "dst").alias("path"), F.lit(False).alias("done")))
    while not state.where("not done").isEmpty():
        up = state.select(F.col("node").alias("top"), F.col("top").alias("next"), F.col("path").alias("above"), F.col("done").alias("ended"))
        step = (
            state.where("not done")
            .join(up, "top", "left")
            .select(
                "node",
                F.coalesce("next", "top").alias("top"),
                F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("above", F.slice("path", F.lit(2), F.size("path")))).alias("path"),
                F.coalesce("ended", F.lit(True)).alias("done"),
            )
        )
        state = cut(state.where("done").unionByName(step))
    return roots.unionByName(state.select("node", F.col("top").alias("root"), "path")).select("node", "root", (F.size("path") - 1).alias("depth"), "path")


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance): each pair once with its shortest distance."""
    return paths.select(F.posexplode("path").alias("at", "ancestor"), F.col("node").alias("descendant"), "depth").where("ancestor <> descendant").groupBy("ancestor", "descendant").agg(F.min(F.col("depth") - F.col("at")).alias("distance"))
