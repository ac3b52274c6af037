"""Operators on the property graph: endpoints, neighbours, paths, call graph and measures.

Entities come as (id, repository_id, entity_type, name, ...), relationships as (id, repository_id, src, dst, type, strength,
frequency, line_number, context), both in normal form and one row per id (see entities(), relationships()). Loops over levels
write each level to the shared folder."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..session import cut
from ..tables import norm_enum, norm_id
from . import hierarchy
from .skew import few, hot_list, lookup_join

ENTITY_COLUMNS = ["repository_id", "entity_type", "name", "qualified_name", "file_path", "start_line", "end_line", "start_column", "end_column", "language", "signature", "docstring", "complexity_score"]


def _newest(df: DataFrame, at: str, columns: list[str]) -> DataFrame:
    best = F.max(F.struct(F.col(at), *[F.col(c) for c in columns])).alias("x")
    return df.groupBy("id").agg(best).select("id", *[F.col(f"x.{c}").alias(c) for c in columns])


def entities(code_entities: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per entity in normal form: of repeated deliveries the one updated last. Rows without id or type are no entities."""
    columns = columns or ENTITY_COLUMNS
    form = {"entity_type": norm_enum("entity_type"), "language": C.normal_language("language")}
    rows = code_entities.select(norm_id("id").alias("id"), F.col("updated_at").alias("_at"), *[form.get(c, F.col(c)).alias(c) for c in columns])
    return _newest(rows.where("id is not null"), "_at", columns)


def relationships(table: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per relationship in normal form: of repeated deliveries the one ingested last. columns: only these."""
    columns = columns or ["repository_id", "src", "dst", "type", "strength", "frequency", "line_number", "context", "created_at"]
    rows = table.select(norm_id("id").alias("id"), F.col("ingested_at").alias("_at"), "repository_id", norm_id("source_entity_id").alias("src"), norm_id("target_entity_id").alias("dst"), norm_enum("relationship_type").alias("type"), "strength", "frequency", "line_number", "context", "created_at")
    return _newest(rows.where("id is not null"), "_at", columns)


def relationships_near(table: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A function from a frontier (id) to the relationships (id, src, dst, type) at it, as relationships() has them, without
    merging the deliveries of the whole table: two scans, the first for the ids of relationships of which any delivery touches
    the frontier, the second for all deliveries of these. A frontier or ids too many to broadcast are met by shuffling."""
    columns = ["src", "dst", "type"]
    raw = table.select(norm_id("id").alias("id"), F.col("ingested_at").alias("_at"), norm_id("source_entity_id").alias("src"), norm_id("target_entity_id").alias("dst"), norm_enum("relationship_type").alias("type")).where("id is not null")

    def near(frontier: DataFrame) -> DataFrame:
        if not few(frontier):
            return _newest(raw, "_at", columns)
        ends = [F.broadcast(frontier.select(F.col("id").alias(c), F.lit(True).alias(f"_{c}"))) for c in ("src", "dst")]
        ids = cut(raw.join(ends[0], "src", "left").join(ends[1], "dst", "left").where("_src or _dst").select("id").distinct())
        return _newest(raw.join(F.broadcast(ids) if few(ids) else ids, "id", "left_semi"), "_at", columns)

    return near


def resolvable(rels: DataFrame, ents: DataFrame) -> DataFrame:
    """Relationships both of whose ends are known entities."""
    ids = ents.select("id")
    return lookup_join(lookup_join(rels, ids.withColumnRenamed("id", "src"), "src", "left_semi"), ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def dangling(rels: DataFrame, ents: DataFrame) -> DataFrame:
    """(id, missing): relationships with an end that is no known entity; missing is source, target or both."""
    known = ents.select("id", F.lit(True).alias("_known"))
    two = lookup_join(lookup_join(rels.select("id", "src", "dst"), known.select(F.col("id").alias("src"), F.col("_known").alias("_s")), "src"), known.select(F.col("id").alias("dst"), F.col("_known").alias("_d")), "dst")
    return two.where("_s is null or _d is null").select("id", F.when(F.col("_s").isNull() & F.col("_d").isNull(), "both").when(F.col("_s").isNull(), "source").otherwise("target").alias("missing"))


def neighbours(rels: DataFrame, ids: DataFrame, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """(id, entity_id, other_id, direction, type, strength, frequency): relationships of the entities in ids(id).
    direction: outgoing, incoming or both; with both a self-relationship comes once each way."""
    some = rels.where(F.col("type").isin(types)) if types else rels
    wanted = cut(ids.select("id").distinct())
    out = some.select("id", F.col("src").alias("entity_id"), F.col("dst").alias("other_id"), F.lit("outgoing").alias("direction"), "type", "strength", "frequency")
    into = some.select("id", F.col("dst").alias("entity_id"), F.col("src").alias("other_id"), F.lit("incoming").alias("direction"), "type", "strength", "frequency")
    both = {"outgoing": out, "incoming": into}.get(direction, out.unionByName(into))
    wanted = wanted.withColumnRenamed("id", "entity_id")
    return both.join(F.broadcast(wanted), "entity_id", "left_semi") if few(wanted) else lookup_join(both, wanted, "entity_id", "left_semi")


def entity_context(rels: DataFrame, ents: DataFrame, ids: DataFrame, depth: int = 1, types: list[str] | None = None) -> DataFrame:
    """The neighbours of some entities with what is known of the other end; depth 0 gives the relationships alone."""
    near = neighbours(rels, ids, "both", types)
    if depth <= 0:
        return near
    other = ents.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"), F.col("entity_type").alias("other_type"), F.col("file_path").alias("other_path"))
    return lookup_join(near.where("other_id is not null"), other, "other_id", "inner")


def adjacency(edges: DataFrame, directed: bool) -> DataFrame:
    e = edges.select("src", "dst").where("src is not null and dst is not null")
    return (e if directed else e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))).distinct()


def distances(edges: DataFrame, starts: DataFrame, max_depth: int | None, directed: bool = True) -> DataFrame:
    """(start, node, depth, via): every node within max_depth of the starts (id), with its least depth and, of the nodes one
    step nearer, the smallest. Level by level: frontier joined with the edges, less what was seen. Without max_depth until
    nothing new is reached."""
    adj = cut(adjacency(edges, directed))
    seen = cut(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via")).distinct())
    frontier = seen
    for level in count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.select("start", F.col("node").alias("src")).join(adj, "src").groupBy("start", F.col("dst").alias("node")).agg(F.min("src").alias("via"))
        frontier = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").select("start", "node", F.lit(level).alias("depth"), "via"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, source: str, target: str, max_depth: int = 5, directed: bool = False) -> list[str] | None:
    """The nodes of a shortest path between two entities; of several the one through the smallest ids, seen from the target."""
    spark = edges.sparkSession
    seen = distances(edges, spark.createDataFrame([(source,)], "id string"), max_depth, directed)
    path, node = [target], target
    for _ in range(max_depth + 1):
        row = seen.where(F.col("node") == node).select("depth", "via").first()
        if row is None:
            return None
        if row.depth == 0:
            return path[::-1]
        node = row.via
        path.append(node)
    return None


def hop_expansion(rels: DataFrame | Callable[[DataFrame], DataFrame], relevance: DataFrame, seeds: DataFrame, hops: int = 2, threshold: float = K.HOP_THRESHOLD, max_nodes: int | None = None) -> DataFrame:
    """(id, hop, score, via, type): multi-hop context of the seeds (id, score). rels: the relationships, or a function that
    gives those at a frontier (see relationships_near).

    relevance: (id, relevance) of all entities. An edge's score is relevance * weight of its type * 0.8^hop; a node enters at
    the first hop at which an edge reaches the threshold, by its best edge (ties: smallest type, then smallest origin).
    max_nodes stops further hops once so many nodes are in. Each hop filters the edges by the frontier at either end, which is
    broadcast if its count allows it; edges are not doubled, written or made distinct as a whole."""

    def beyond(frontier: DataFrame) -> DataFrame:
        ids = frontier.select("id")
        edges = (rels(ids) if callable(rels) else rels).where("src is not null and dst is not null and src <> dst").select("src", "dst", "type")
        if few(ids):
            ends = [F.broadcast(ids.select(F.col("id").alias(c), F.lit(True).alias(f"_{c}"))) for c in ("src", "dst")]
            met = edges.join(ends[0], "src", "left").join(ends[1], "dst", "left").where("_src or _dst")
            out = F.when(F.col("_src"), F.struct("src", "dst", "type"))
            into = F.when(F.col("_dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "type"))
            return met.select(F.explode(F.array_compact(F.array(out, into))).alias("e")).select("e.*").distinct()
        back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type")
        starts = ids.withColumnRenamed("id", "src")
        return lookup_join(edges, starts, "src", "left_semi").unionByName(lookup_join(back, starts, "src", "left_semi")).distinct()

    seen = cut(seeds.select("id", F.lit(0).alias("hop"), "score", F.lit(None).cast("string").alias("via"), F.lit(None).cast("string").alias("type")))
    frontier = seen
    for hop in range(1, hops + 1):
        if max_nodes is not None and seen.count() >= max_nodes:
            break
        reached = beyond(frontier).join(relevance.withColumnRenamed("id", "dst"), "dst")
        scored = reached.withColumn("score", C.hop_score(F.col("relevance"), "type", hop)).where(F.col("score") >= threshold)
        best = scored.groupBy(F.col("dst").alias("id")).agg(F.min(F.struct((-F.col("score")).alias("s"), "type", "src")).alias("x"))
        frontier = cut(best.join(seen.select("id"), "id", "left_anti").select("id", F.lit(hop).alias("hop"), (-F.col("x.s")).alias("score"), F.col("x.src").alias("via"), F.col("x.type").alias("type")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


# call graph


def call_nodes(ents: DataFrame, rels: DataFrame) -> DataFrame:
    """(id, name, callees, callers, call_count, is_recursive) of functions and methods; counts of calls keep repeats, callees
    and callers count different entities."""
    funcs = ents.where(F.col("entity_type").isin("FUNCTION", "METHOD")).select("id", "name")
    calls = resolvable(rels.where("type = 'CALLS'"), funcs)
    out = calls.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("callees"), F.count(F.lit(1)).alias("made"), F.max((F.col("src") == F.col("dst")).cast("int")).alias("rec"))
    into = calls.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("callers"), F.count(F.lit(1)).alias("call_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return funcs.join(out, "id", "left").join(into, "id", "left").select("id", "name", zero("callees"), zero("callers"), zero("call_count"), (F.coalesce("rec", F.lit(0)) == 1).alias("is_recursive"))


def entry_points(nodes: DataFrame) -> DataFrame:
    return nodes.where("callers = 0 and callees > 0")


def call_depths(ents: DataFrame, rels: DataFrame) -> DataFrame:
    """(node, depth, reached): of all functions and methods the least number of calls from an entry point, however deep;
    those that no entry point reaches keep depth 0 and are told apart by reached."""
    funcs = ents.where(F.col("entity_type").isin("FUNCTION", "METHOD")).select("id")
    calls = cut(adjacency(resolvable(rels.where("type = 'CALLS'"), funcs), True))
    seen = cut(calls.select(F.col("src").alias("node")).distinct().join(calls.select(F.col("dst").alias("node")), "node", "left_anti").withColumn("depth", F.lit(0)))
    frontier = seen
    for level in count(1):
        step = calls.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return funcs.withColumnRenamed("id", "node").join(seen, "node", "left").select("node", F.coalesce("depth", F.lit(0)).alias("depth"), F.col("depth").isNotNull().alias("reached"))


def hotspots(nodes: DataFrame) -> DataFrame:
    return nodes.where("call_count > 5 or callers > 5")


_COUNTS = "node long, callers long"

#: Bits that are held at once to count callers in one task (128 MB).
BITS_AT_ONCE = 1 << 30


def _count_callers(rows: pa.Table) -> pa.Table:
    """(node, callers) of a graph (src, dst, size): the sizes of all nodes that lead to each node, its own among them where it
    lies on a cycle. A row from a node to itself tells the size of what the node stands for; over one it is a cycle. Without
    such a row the size is 1.

    Strongly connected components are walked in the order of calls, and sets of callers are numbers of one bit a component;
    where components are many, callers are taken in blocks, so that no more than BITS_AT_ONCE bits are held."""
    ends = [rows[c].to_numpy() for c in ("src", "dst")]
    ids, at = np.unique(np.concatenate(ends), return_inverse=True)
    src, dst = at[: len(ends[0])], at[len(ends[0]) :]
    told = src == dst
    weight = np.ones(len(ids), np.int64)
    weight[src[told]] = rows["size"].to_numpy(zero_copy_only=False)[told].astype(np.int64)

    def lists(keys: np.ndarray, values: np.ndarray, n: int) -> list[list[int]]:
        order = np.argsort(keys, kind="stable")
        flat, cuts = values[order].tolist(), np.searchsorted(keys[order], np.arange(n + 1)).tolist()
        return [flat[i:j] for i, j in zip(cuts, cuts[1:])]

    comp = np.array(hierarchy.colour_walk(lists(src[~told], dst[~told], len(ids)))[0], np.int64)
    n = int(comp.max()) + 1
    comp = n - 1 - comp  # callers before what they call
    size = np.zeros(n, np.int64)
    np.add.at(size, comp, weight)
    pairs = np.unique(comp[src] * n + comp[dst])
    a, b = pairs // n, pairs % n
    parents, sizes = lists(b[a != b], a[a != b], n), size.tolist()
    callers = [x if x > 1 else 0 for x in sizes]
    width = max(64, BITS_AT_ONCE // n)
    for low in range(0, n, width):
        high, bits = min(n, low + width), [0] * n
        digits = [(k, mask) for k in range(max(sizes[low:high]).bit_length()) if (mask := int("".join("1" if x >> k & 1 else "0" for x in reversed(sizes[low:high])), 2))]
        for v in range(low, n):
            m = 0
            for p in parents[v]:
                if p >= low:
                    m |= bits[p] | 1 << p - low if p < high else bits[p]
            if m:
                bits[v] = m
                callers[v] += sum((m & mask).bit_count() << k for k, mask in digits)
    return pa.table({"node": ids, "callers": np.array(callers, np.int64)[comp]})


def _counted_at_once(edges: DataFrame, part: Column) -> DataFrame:
    """(node, callers) of the parts of a graph (src, dst, size), each in one task."""
    return edges.select("src", "dst", "size", part.alias("part")).groupBy("part").applyInArrow(_count_callers, _COUNTS)


def _counted_by_joins(adj: DataFrame, limit: int) -> DataFrame:
    """(node, callers) of a graph too large for one task. Nodes on common cycles have the same callers, so each strongly
    connected component becomes one node; if the edges left are still too many for one task, pairs are made between
    components. What lies below the largest has all that lies above it as callers: that share is counted once, without pairs."""
    rings = cut(hierarchy.find_cycles(adj, limit).select("node", "cycle"))
    sizes = cut(rings.groupBy("cycle").agg(F.count(F.lit(1)).alias("size")))
    dag = adj
    for end in ("src", "dst"):
        dag = lookup_join(dag, rings.select(F.col("node").alias(end), "cycle"), end).withColumn(end, F.coalesce("cycle", end)).drop("cycle")
    dag = cut(dag.where("src <> dst").select("src", "dst").distinct())
    placed = adj.select(F.col("dst").alias("node")).distinct().join(rings, "node", "left").select("node", F.coalesce("cycle", "node").alias("part"))
    if dag.count() <= limit:
        own = sizes.select(F.col("cycle").alias("src"), F.col("cycle").alias("dst"), "size")
        total = _counted_at_once(dag.withColumn("size", F.lit(1).cast("long")).unionByName(own), F.lit(0)).withColumnRenamed("node", "part")
        return lookup_join(placed, total, "part", "inner").select("node", "callers")
    largest = sizes.orderBy(F.desc("size"), "cycle").select(F.col("cycle").alias("id")).limit(1)
    above = cut(distances(dag.select(F.col("dst").alias("src"), F.col("src").alias("dst")), largest, None).select(F.col("node").alias("caller"), F.lit(True).alias("above")))
    below = cut(distances(dag, largest, None).where("depth > 0").select(F.col("node").alias("id"), F.lit(True).alias("below")))

    def apart(pairs: DataFrame) -> DataFrame:
        return pairs.join(above, "caller", "left").join(below, "id", "left").where("above is null or below is null").select("id", "caller")

    up = dag.select(F.col("dst").alias("caller"), F.col("src").alias("next"))
    reach = frontier = cut(apart(dag.select(F.col("dst").alias("id"), F.col("src").alias("caller"))))
    while not frontier.isEmpty():
        step = frontier.join(up, "caller").select("id", F.col("next").alias("caller")).distinct()
        frontier = cut(apart(step).join(reach, ["id", "caller"], "left_anti"))
        reach = reach.unionByName(frontier)

    weight = sizes.withColumnRenamed("cycle", "caller")
    size = F.coalesce("size", F.lit(1))
    single = lookup_join(reach, weight, "caller").groupBy("id").agg(F.sum(size).alias("n"))
    shared = below.select("id").crossJoin(F.broadcast(above.join(weight, "caller", "left").agg(F.coalesce(F.sum(size), F.lit(0)).alias("n"))))
    own = sizes.select(F.col("cycle").alias("id"), F.col("size").alias("n"))
    total = single.unionByName(shared).unionByName(own).groupBy(F.col("id").alias("part")).agg(F.sum("n").alias("callers"))
    return lookup_join(placed, total, "part", "inner").select("node", "callers")


def impact(edges: DataFrame, nodes: DataFrame | None = None, max_colocated_edges: int = hierarchy.MAX_COLOCATED_EDGES) -> DataFrame:
    """(id, direct, transitive, score): of each called node its callers, all that call it through others (less one, as the
    number has always been reported), and direct + transitive/2. Chains of calls may have any length. nodes (id, each once):
    only edges between these count; without, all do.

    Nodes are numbered and edges carry numbers. Up to max_colocated_edges are counted in one task; of more, each connected
    component in a task of its own, and components of more edges than that by joins. No pairs of nodes leave a task."""
    plain = cut(edges.select("src", "dst").where("src <> dst"))
    nodes = plain.select(F.explode(F.array("src", "dst")).alias("id")).distinct() if nodes is None else nodes
    names = cut(nodes.select("id", F.monotonically_increasing_id().alias("node")))
    hot = {end: hot_list(plain, end) for end in ("src", "dst")}
    adj = plain
    for end in ("src", "dst"):
        adj = lookup_join(adj, names.select(F.col("id").alias(end), "node"), end, "inner", hot[end]).drop(end).withColumnRenamed("node", end)
    adj = cut(adj.select("src", "dst").distinct())
    sized = adj.withColumn("size", F.lit(1).cast("long"))
    if adj.count() <= max_colocated_edges:
        callers = _counted_at_once(sized, F.lit(0))
    else:
        tagged = cut(sized.join(hierarchy.components(adj).withColumnRenamed("node", "src"), "src"))
        large = cut(tagged.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max_colocated_edges).select("component"))
        callers = _counted_at_once(tagged.join(large, "component", "left_anti"), F.col("component"))
        if not large.isEmpty():
            callers = callers.unionByName(_counted_by_joins(cut(tagged.join(large, "component", "left_semi").select("src", "dst")), max_colocated_edges))
    direct = adj.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("direct"))
    both = direct.join(callers, "node").join(names, "node").select("id", "direct", (F.col("callers") - 1).alias("transitive"))
    return both.select("id", "direct", "transitive", (F.col("direct") + 0.5 * F.col("transitive")).alias("score"))


def impact_top(impacts: DataFrame, n: int = 20) -> DataFrame:
    """The n functions of most impact with their rank; ties by id."""
    return impacts.orderBy(F.desc("score"), "id").limit(n).select("id", "score", F.row_number().over(W.orderBy(F.desc("score"), "id")).alias("rank"))


def critical(impacts: DataFrame) -> DataFrame:
    return impacts.where("direct > 3 or transitive > 10")


def with_content_calls(nodes: DataFrame, calls: DataFrame, found: DataFrame) -> DataFrame:
    """Call nodes whose callees and callers also count the calls (source_id, target_id) found in contents."""
    every = adjacency(calls.select("src", "dst").unionByName(found.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"))), True)
    out = every.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("_out"))
    into = every.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("_in"))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return nodes.drop("callees", "callers").join(out, "id", "left").join(into, "id", "left").select("*", zero("_out", "callees"), zero("_in", "callers")).drop("_out", "_in")


def update_strengths(rels: DataFrame, changes: DataFrame) -> DataFrame:
    """Relationships with new strengths (id, new_strength, reason) and an audit struct of the old and new strength and the
    reason; a new strength outside of 0 to 1 changes nothing."""
    both = rels.join(changes.where("new_strength between 0 and 1"), "id", "left")
    audit = F.when(F.col("new_strength").isNotNull(), F.struct(F.col("strength").alias("old_strength"), "new_strength", "reason"))
    return both.withColumn("audit", audit).withColumn("strength", F.coalesce("new_strength", "strength")).drop("new_strength", "reason")


def detach_delete(ents: DataFrame, rels: DataFrame, repository: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) without a repository, its entities, and all relationships of these."""
    gone = ents.where(F.col("repository_id") == repository).select("id")
    left = rels.where(~F.col("repository_id").eqNullSafe(F.lit(repository)))
    for end in ("src", "dst"):
        left = lookup_join(left, gone.withColumnRenamed("id", end), end, "left_anti")
    return ents.where(~F.col("repository_id").eqNullSafe(F.lit(repository))), left


def simple_paths(edges: DataFrame, starts: DataFrame, max_nodes: int = 10) -> DataFrame:
    """(start, path): all paths without a repeat from the starts to nodes nothing leaves, or to max_nodes nodes."""
    adj = cut(adjacency(edges, True).where("src <> dst"))
    open_ = cut(starts.select(F.col("id").alias("start"), F.array("id").alias("path")))
    leaves = adj.select(F.col("dst").alias("last")).distinct().join(adj.select(F.col("src").alias("last")).distinct(), "last", "left_anti")
    done = None
    for _ in range(max_nodes - 1):
        step = open_.withColumn("last", F.element_at("path", -1)).join(adj.withColumnRenamed("src", "last"), "last").where(~F.array_contains("path", F.col("dst")))
        open_ = cut(step.select("start", F.concat("path", F.array("dst")).alias("path")))
        ended = open_.join(leaves, F.element_at("path", -1) == F.col("last"), "left_semi")
        done = ended if done is None else done.unionByName(ended)
        if open_.isEmpty():
            break
    full = open_.where(F.size("path") == max_nodes).join(leaves, F.element_at("path", -1) == F.col("last"), "left_anti")
    return (full if done is None else done.unionByName(full)).select("start", "path")


def path_complexity(paths: DataFrame, weights: DataFrame) -> DataFrame:
    """(start, path, complexity): the sum of the nodes' weights (id, weight; 1 where unknown) and half the length."""
    keyed = paths.withColumn("_p", F.array_join("path", ">"))
    each = keyed.select("_p", F.explode("path").alias("id")).join(weights, "id", "left").groupBy("_p").agg(F.sum(F.coalesce("weight", F.lit(1.0))).alias("w"))
    return keyed.join(each, "_p").select("start", "path", (F.col("w") + 0.5 * F.size("path")).alias("complexity"))


def overall_complexity(calls: Column, functions: Column, cycles: Column, depth: Column) -> Column:
    return F.when(functions > 0, calls / functions).otherwise(0.0) + 2 * cycles + 1.5 * depth


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree) of all nodes (id), over different neighbours."""
    e = adjacency(edges, True)
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return nodes.select("id").join(e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree")), "id", "left").join(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree")), "id", "left").select("id", zero("in_degree"), zero("out_degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """(id, triangles, degree, clustering) of the nodes of the undirected graph. Each edge is directed from its end of lower
    degree, so hubs start no more than about sqrt(2m) wedges."""
    und = cut(adjacency(edges, False).where("src < dst"))
    deg = und.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    ranked = und.join(deg.select(F.col("id").alias("src"), F.col("degree").alias("ds")), "src").join(deg.select(F.col("id").alias("dst"), F.col("degree").alias("dd")), "dst")
    up = (F.col("ds") < F.col("dd")) | ((F.col("ds") == F.col("dd")) & (F.col("src") < F.col("dst")))
    low = cut(ranked.select(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("b")))
    wedges = low.join(low.select("a", F.col("b").alias("c")), "a").where("b < c")
    closed = wedges.join(und.select(F.col("src").alias("b"), F.col("dst").alias("c")), ["b", "c"])
    n = closed.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))
    return deg.join(n, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).alias("triangles"), "degree", F.when(F.col("degree") > 1, 2.0 * F.coalesce("triangles", F.lit(0)) / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0).alias("clustering"))


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(id, rank): ranks that sum to about 1; what nodes without outgoing edges hold is shared by all."""
    e = adjacency(edges, True)
    out = e.groupBy("src").agg(F.count(F.lit(1)).alias("n"))
    flow = cut(e.join(out, "src"))
    total = nodes.select("id").distinct().count()
    if not total:
        return nodes.select("id", F.lit(0.0).alias("rank"))
    ranks = cut(nodes.select("id").distinct().withColumn("rank", F.lit(1.0 / total)))
    for _ in range(rounds):
        got = flow.join(ranks.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("n")).alias("got"))
        lost = ranks.join(out.select(F.col("src").alias("id")), "id", "left_anti").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        ranks = cut(ranks.select("id").join(got, "id", "left").crossJoin(F.broadcast(lost)).select("id", ((1 - damping) / total + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / total)).alias("rank")))
    return ranks


def resolve_calls(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(source_id, called, target_id): called names (source_id, called) matched with functions (id, name, qualified_name): by
    equal name, or because a qualified name ends with .called. Two equi-joins over the endings of qualified names, in place of
    a join on "ends with"; of several matches the smallest id counts."""
    parts = F.split("qualified_name", r"\.")
    endings = functions.select("id", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("called"))
    keys = endings.where("called <> ''").unionByName(functions.select("id", F.col("name").alias("called"))).groupBy("called").agg(F.min("id").alias("target_id"))
    return lookup_join(calls.select("source_id", "called").distinct(), keys, "called", "inner").select("source_id", "called", "target_id")


def resolve_imports(imports: DataFrame, ents: DataFrame) -> DataFrame:
    """(file_id, module, symbol, target_id, target_type): import rows (file_id, statement) resolved: ``from m import a, b`` to the
    functions and classes named a and b, ``import m`` to the file named m.py."""
    stmt = F.btrim("statement")
    frm = imports.where(stmt.rlike(r"^from\s+\S+\s+import\s+")).select("file_id", F.regexp_extract(stmt, r"^from\s+(\S+)\s+import", 1).alias("module"), F.explode(F.split(F.regexp_replace(F.regexp_extract(stmt, r"\simport\s+(.*)$", 1), r"[()]", ""), r"\s*,\s*")).alias("symbol"))
    frm = frm.withColumn("symbol", F.regexp_extract(F.btrim("symbol"), r"^(\w+)", 1)).where("symbol <> ''")
    named = ents.where(F.col("entity_type").isin("FUNCTION", "CLASS")).select(F.col("id").alias("target_id"), F.col("name").alias("symbol"), F.col("entity_type").alias("target_type"))
    plain = imports.where(stmt.rlike(r"^import\s+")).select("file_id", F.explode(F.split(F.regexp_extract(stmt, r"^import\s+(.*)$", 1), r"\s*,\s*")).alias("module"))
    plain = plain.withColumn("module", F.regexp_extract(F.btrim("module"), r"^([\w.]+)", 1)).where("module <> ''")
    files = ents.where("entity_type = 'FILE'").select(F.col("id").alias("target_id"), F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.py$", "").alias("module"), F.lit("FILE").alias("target_type"))
    return frm.join(named, "symbol").select("file_id", "module", "symbol", "target_id", "target_type").unionByName(plain.join(files, "module").select("file_id", "module", F.lit(None).cast("string").alias("symbol"), "target_id", "target_type"))


def frequencies(rels: DataFrame) -> DataFrame:
    """(src, dst, type, frequency, strength): repeated relationships between two entities as one, frequencies added up."""
    return rels.where("src is not null and dst is not null").groupBy("src", "dst", "type").agg(F.sum(F.coalesce("frequency", F.lit(1))).alias("frequency"), F.max("strength").alias("strength"))


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
