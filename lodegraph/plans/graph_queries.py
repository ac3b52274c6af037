"""Queries of the operators on the property graph and of retrieval, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..operators import chunking, embed, extract, flow, graph, hierarchy, retrieval, stats
from ..session import spread
from ..sources import files as source_files
from ..sources.filters import glob_regex, source_only
from ..streaming import events as ev
from ..tables import norm_enum, norm_id, table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        REGISTRY[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)"


def nid(c: str) -> str:
    return f"nullif(lower(trim({c}, {BLANKS})), '')"


def enum(c: str) -> str:
    return f"nullif(upper(trim({c}, {BLANKS})), '')"


LANG = "case lower(trim(language)) " + " ".join(f"when '{k}' then '{v}'" for k, v in K.LANGUAGE_ALIASES.items()) + " else lower(trim(language)) end"
ENT = f"""ent as (select * exclude (rn) from (select {nid('id')} as id, repository_id, {enum('entity_type')} as entity_type, name, qualified_name, file_path, start_line, end_line, start_column,
    end_column, {LANG} as language, signature, docstring, complexity_score, content, embedding_vector, row_number() over (partition by {nid('id')} order by updated_at desc nulls last) as rn from code_entities) where rn = 1 and id is not null)"""
REL = f"""rel as (select * exclude (rn) from (select {nid('id')} as id, repository_id, {nid('source_entity_id')} as src, {nid('target_entity_id')} as dst, {enum('relationship_type')} as type, strength,
    frequency, line_number, context, created_at, row_number() over (partition by {nid('id')} order by ingested_at desc nulls last) as rn from relationships) where rn = 1 and id is not null)"""
WITH = f"with {ENT}, {REL} "


def ents(s: SparkSession, d: str, *more: str) -> DataFrame:
    return graph.entities(table(s, d, "code_entities"), graph.ENTITY_COLUMNS + list(more))


def rels(s: SparkSession, d: str, *columns: str) -> DataFrame:
    return graph.relationships(table(s, d, "relationships"), list(columns) or None)


# counts and measures


@query(WITH + "select repository_id, entity_type, count(*) as n from ent group by all")
def entity_counts(s, d):
    return stats.type_counts(ents(s, d))


@query(WITH + "select repository_id, type, count(*) as n from rel group by all")
def rel_counts(s, d):
    return stats.relationship_counts(rels(s, d))


@query(WITH + ", both_ends as (select r.* from rel r join ent a on a.id = r.src join ent b on b.id = r.dst where a.repository_id = b.repository_id) select repository_id, type, count(*) * 2 as n from both_ends group by all")
def rel_counts_undirected(s, d):
    e = ents(s, d).select("id", "repository_id")
    r = graph.lookup_join(rels(s, d), e.select(F.col("id").alias("src"), F.col("repository_id").alias("ra")), "src", "inner")
    r = graph.lookup_join(r, e.select(F.col("id").alias("dst"), F.col("repository_id").alias("rb")), "dst", "inner")
    return stats.relationship_counts(r.where("ra = rb"), undirected=True)


@query(
    WITH
    + """, k as (select repository_id, entity_type, count(*) as n from ent group by all), l as (select repository_id, language, count(*) as n from ent where language is not null group by all),
    kt as (select repository_id, entity_type as dominant_type from k qualify row_number() over (partition by repository_id order by n desc, entity_type nulls first) = 1),
    lt as (select repository_id, language as dominant_language from l qualify row_number() over (partition by repository_id order by n desc, language) = 1),
    e as (select repository_id, count(*) as entities, count(*) filter (where entity_type = 'FILE') as files from ent group by all), r as (select repository_id, count(*) as relationships from rel group by all)
    select e.repository_id, entities, coalesce(relationships, 0) as relationships, files, dominant_type, dominant_language, round(2.0::double * coalesce(relationships, 0) / entities, 6) as average_degree,
    round(case when entities <= 1 then 0 else least(1.0::double, 2.0::double * coalesce(relationships, 0) / (entities * (entities - 1))) end, 9) as density
    from e left join r on e.repository_id = r.repository_id left join kt on kt.repository_id = e.repository_id left join lt on lt.repository_id = e.repository_id"""
)
def graph_metrics(s, d):
    return stats.graph_metrics(ents(s, d), rels(s, d))


@query(WITH + "select language, count(*) as n from ent group by all")
def lang_distribution(s, d):
    return ents(s, d).groupBy("language").agg(F.count(F.lit(1)).alias("n"))


REPOS = f"repo as (select * from (select {nid('id')} as id, path, name, size_bytes, file_count, language_stats, last_indexed, last_modified, git_hash, status, row_number() over (partition by {nid('id')} order by last_indexed desc nulls last) as rn from repositories) where rn = 1)"


def repos(s: SparkSession, d: str) -> DataFrame:
    cols = ["path", "name", "size_bytes", "file_count", "last_modified", "git_hash", "status"]
    r = table(s, d, "repositories").withColumn("id", norm_id("id")).where("id is not null")
    first = r.groupBy("id").agg(F.max(F.struct(F.coalesce("last_indexed", F.lit("1900-01-01").cast("timestamp")).alias("_at"), "last_indexed", *cols)).alias("x"), F.max_by("language_stats", F.struct(F.coalesce("last_indexed", F.lit("1900-01-01").cast("timestamp")))).alias("language_stats"))
    return first.select("id", "x.last_indexed", *[f"x.{c}" for c in cols], "language_stats")


@query(
    WITH
    + f""", {REPOS}, e as (select repository_id, count(*) as entities from ent group by all), r as (select repository_id, count(*) as relationships from rel group by all)
    select repo.id, last_indexed, coalesce(entities, 0) as entities, coalesce(relationships, 0) as relationships from repo left join e on e.repository_id = repo.id left join r on r.repository_id = repo.id"""
)
def repo_listing(s, d):
    return stats.repository_listing(repos(s, d), ents(s, d), rels(s, d)).drop("name")


@query(f"with {REPOS} select id, list_sum(map_values(language_stats))::bigint as total_lines from repo")
def repo_total_lines(s, d):
    return repos(s, d).select("id", F.when(F.size("language_stats") > 0, F.aggregate(F.map_values("language_stats"), F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x, F.lit(0)))).alias("total_lines"))


@query(f"with {REPOS} select id, (last_indexed is null or last_modified is null or last_modified > last_indexed) as stale from repo")
def repo_stale(s, d):
    return repos(s, d).select("id", C.is_stale("last_indexed", "last_modified").alias("stale"))


@query(
    WITH
    + ", e as (select repository_id, count(*) as n, count(distinct file_path) as f, count(*) filter (where complexity_score is null or isnan(complexity_score)) as bad from ent group by all), r as (select repository_id, count(*) as m from rel group by all) select e.repository_id, round(0.4 * least(1.0::double, n / 10000.0::double) + 0.3 * 1.0::double + 0.3 * (case when n <= 1 then 0 else least(1.0::double, 2.0::double * coalesce(m, 0) / (n * (n - 1))) end), 6) as complexity, round(0.4 * 1.0::double + 0.4 * 1.0::double + 0.2 * greatest(0.0::double, 1 - bad::double / greatest(1, f)), 6) as health, least(100.0::double, f::double / n * 100) as coverage from e left join r on e.repository_id = r.repository_id"
)
def repo_scores(s, d):
    e = ents(s, d).groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_path").alias("f"), F.count_if(F.col("complexity_score").isNull() | F.isnan("complexity_score")).alias("bad"))
    both = e.join(rels(s, d).groupBy("repository_id").agg(F.count(F.lit(1)).alias("m")), "repository_id", "left").withColumn("m", F.coalesce("m", F.lit(0)))
    return both.select("repository_id", F.round(C.complexity("n", F.lit(20), C.density("n", "m")), 6).alias("complexity"), F.round(C.health(F.lit(1.0), F.lit(1.0), "bad", "f"), 6).alias("health"), C.coverage("f", "n").alias("coverage"))


# endpoints and neighbours


@query(WITH + "select r.id from rel r where src in (select id from ent) and dst in (select id from ent)")
def edge_insert_semijoin(s, d):
    return graph.resolvable(rels(s, d), ents(s, d)).select("id")


@query(WITH + "select r.id, case when a.id is null and b.id is null then 'both' when a.id is null then 'source' else 'target' end as missing from rel r left join ent a on a.id = r.src left join ent b on b.id = r.dst where a.id is null or b.id is null")
def dangling_edges(s, d):
    return graph.dangling(rels(s, d), ents(s, d))


HUB = ", hub as (select dst as id from rel where dst is not null group by dst order by count(*) desc, dst limit 1) "


def hub(s, d):
    """The most referenced entity."""
    return rels(s, d, "dst").where("dst is not null").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id")


@query(WITH + HUB + "select id, src as entity_id, dst as other_id, 'outgoing' as direction, type, strength, frequency from rel where src in (select id from hub)")
def neighbors_out(s, d):
    return graph.neighbours(rels(s, d), hub(s, d), "outgoing")


@query(WITH + HUB + "select id, dst as entity_id, src as other_id, 'incoming' as direction, type, strength, frequency from rel where dst in (select id from hub)")
def neighbors_in(s, d):
    return graph.neighbours(rels(s, d), hub(s, d), "incoming")


@query(WITH + HUB + "select id, src as entity_id, dst as other_id, 'outgoing' as direction, type, strength, frequency from rel where src in (select id from hub) and type in ('CALLS', 'IMPORTS') union all select id, dst, src, 'incoming', type, strength, frequency from rel where dst in (select id from hub) and type in ('CALLS', 'IMPORTS')")
def neighbors_both(s, d):
    return graph.neighbours(rels(s, d), hub(s, d), "both", ["CALLS", "IMPORTS"])


@query(WITH + HUB + ", n as (select id, src as entity_id, dst as other_id, 'outgoing' as direction, type, strength, frequency from rel where src in (select id from hub) union all select id, dst, src, 'incoming', type, strength, frequency from rel where dst in (select id from hub)) select n.*, e.name as other_name, e.entity_type as other_type, e.file_path as other_path from n join ent e on e.id = n.other_id")
def entity_context(s, d):
    return graph.entity_context(rels(s, d), ents(s, d), hub(s, d))


@query(WITH + "select id, entity_type, name from ent where entity_type in ('FUNCTION', 'CLASS')")
def entities_by_type(s, d):
    return retrieval.matching(ents(s, d), types=["FUNCTION", "CLASS"]).select("id", "entity_type", "name")


@query(WITH + "select id, name from ent where lower(name) = (select min(lower(name)) from ent where entity_type = 'FUNCTION')")
def name_search_exact(s, d):
    e = ents(s, d)
    least = e.where("entity_type = 'FUNCTION'").agg(F.min(F.lower("name")).alias("least"))
    return e.join(F.broadcast(least), F.lower("name") == F.col("least")).select("id", "name")


@query(WITH + "select id, name from ent where contains(lower(name), 'merge') and entity_type in ('FUNCTION', 'METHOD')")
def name_search_contains(s, d):
    return ents(s, d).where(F.lower("name").contains("merge") & F.col("entity_type").isin("FUNCTION", "METHOD")).select("id", "name")


@query(WITH + "select type, count(*) as n, sum((type in ('INHERITS', 'IMPLEMENTS', 'CONTAINS', 'EXTENDS'))::int)::bigint as structural, sum((type in ('CALLS', 'ACCESSES', 'INSTANTIATES'))::int)::bigint as behavioral, sum((type in ('IMPORTS', 'DEPENDS_ON', 'REFERENCES', 'CALLS'))::int)::bigint as dependency from rel group by type")
def relationship_classes(s, d):
    has = lambda n: F.count_if(F.array_contains("classes", n)).alias(n)
    return rels(s, d).withColumn("classes", C.relationship_class("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"), has("structural"), has("behavioral"), has("dependency"))


@query(WITH + "select distinct type, case type when 'INHERITS' then 'EXTENDS' when 'EXTENDS' then 'INHERITS' end as reverse, case type " + " ".join(f"when '{k}' then '{v}'" for k, v in K.DESCRIPTIONS.items()) + " else lower(type) end as text from rel where type is not null")
def relationship_texts(s, d):
    return rels(s, d).where("type is not null").select("type", C.reverse_type("type").alias("reverse"), C.relationship_text("type").alias("text")).distinct()


@query(WITH + "select id, round(strength * 0.5 + least(frequency / 10.0::double, 1.0::double) * 0.1, 6) as score from rel where strength is not null and frequency is not null and not isnan(strength)")
def composite_edge_score(s, d):
    return rels(s, d).where("strength is not null and frequency is not null and not isnan(strength)").select("id", F.round(C.composite_score("strength", F.lit(0.5), "frequency"), 6).alias("score"))


@query(WITH + "select src, dst, type, sum(coalesce(frequency, 1))::bigint as frequency from rel where src is not null and dst is not null group by all")
def edge_frequencies(s, d):
    return graph.frequencies(rels(s, d)).drop("strength")


def _weights(w: dict[str, float]) -> str:
    return "case type " + " ".join(f"when '{k}' then {v}" for k, v in w.items()) + " else 0.5 end"


@query(WITH + f"select id, round(0.8 * strength * ({_weights(K.GRAPH_WEIGHTS)})::double * 0.7, 6) as score from rel where strength is not null and not isnan(strength)")
def graph_relevance(s, d):
    return rels(s, d).where("strength is not null and not isnan(strength)").select("id", F.round(C.graph_score(F.lit(0.8), "strength", "type", ), 6).alias("score"))


# paths


@query(
    WITH
    + HUB
    + f""", adj as (select src, dst, type from rel where src is not null and dst is not null and src <> dst union select dst, src, type from rel where src is not null and dst is not null and src <> dst),
    h1 as (select dst as id, 1 as hop, max(round(0.9 * ({_weights(K.HOP_WEIGHTS)})::double * 0.8, 6)) as score from adj where src in (select id from hub) and dst in (select id from ent) and 0.9 * ({_weights(K.HOP_WEIGHTS)})::double * 0.8 >= 0.3 and dst not in (select id from hub) group by dst),
    h2 as (select a.dst as id, 2 as hop, max(round(0.9 * ({_weights(K.HOP_WEIGHTS)})::double * 0.64, 6)) as score from adj a join h1 on a.src = h1.id where a.dst in (select id from ent) and 0.9 * ({_weights(K.HOP_WEIGHTS)})::double * 0.64 >= 0.3 and a.dst not in (select id from hub) and a.dst not in (select id from h1) group by a.dst)
    select id, 0 as hop, 1.0::double as score from hub union all select * from h1 union all select * from h2"""
)
def two_hop_scored(s, d):
    seeds = hub(s, d).select("id", F.lit(1.0).alias("score"))
    found = graph.hop_expansion(graph.relationships_near(table(s, d, "relationships")), ents(s, d).select("id", F.lit(0.9).alias("relevance")), seeds, hops=2)
    return found.select("id", "hop", F.round("score", 6).alias("score"))


@query(
    WITH
    + HUB
    + """, adj as (select src, dst from rel where src is not null and dst is not null union select dst, src from rel where src is not null and dst is not null),
    d0 as (select id as node from hub), d1 as (select distinct dst as node from adj where src in (select node from d0) and dst not in (select node from d0)),
    d2 as (select distinct dst as node from adj where src in (select node from d1) and dst not in (select node from d0) and dst not in (select node from d1)),
    d3 as (select distinct dst as node from adj where src in (select node from d2) and dst not in (select node from d0) and dst not in (select node from d1) and dst not in (select node from d2))
    select node, 0 as depth from d0 union all select node, 1 from d1 union all select node, 2 from d2 union all select node, 3 from d3"""
)
def distances_from_hub(s, d):
    return graph.distances(rels(s, d), hub(s, d), 3, directed=False).select("node", "depth")


CALLS = ", f as (select id, name from ent where entity_type in ('FUNCTION', 'METHOD')), c as (select src, dst from rel where type = 'CALLS' and src in (select id from f) and dst in (select id from f)) "


def calls(s, d):
    e = ents(s, d)
    return graph.resolvable(rels(s, d).where("type = 'CALLS'"), e.where(F.col("entity_type").isin("FUNCTION", "METHOD")))


def call_impacts(s, d):
    """Impact of functions over the call graph. The ends of calls are looked up among the functions as they are numbered."""
    return graph.impact(rels(s, d).where("type = 'CALLS'"), ents(s, d).where(F.col("entity_type").isin("FUNCTION", "METHOD")).select("id"))


@query(WITH + CALLS + "select f.id, f.name, coalesce(o.n, 0) as callees, coalesce(i.n, 0) as callers, coalesce(i.m, 0) as call_count, coalesce(o.rec, 0) = 1 as is_recursive from f left join (select src, count(distinct dst) as n, max((src = dst)::int) as rec from c group by src) o on o.src = f.id left join (select dst, count(distinct src) as n, count(*) as m from c group by dst) i on i.dst = f.id")
def call_nodes(s, d):
    return graph.call_nodes(ents(s, d), rels(s, d))


@query(WITH + CALLS + "select distinct src as id from c where src not in (select dst from c)")
def entry_points(s, d):
    return graph.entry_points(graph.call_nodes(ents(s, d), rels(s, d))).select("id")


@query(WITH + CALLS + "select dst as id, count(distinct src) as callers, count(*) as call_count from c group by dst having count(*) > 5 or count(distinct src) > 5")
def hotspots(s, d):
    return graph.hotspots(graph.call_nodes(ents(s, d), rels(s, d))).select("id", "callers", "call_count")


@query(WITH + CALLS + "select dst as id, count(*) as call_count from c group by dst order by call_count desc, id limit 10")
def most_called(s, d):
    return graph.call_nodes(ents(s, d), rels(s, d)).where("call_count > 0").orderBy(F.desc("call_count"), "id").limit(10).select("id", "call_count")


@query(
    WITH.replace("with ", "with recursive ", 1)
    + CALLS
    + """, g as (select distinct src, dst from c),
    w(node, depth) using key (node) as (select distinct src, 0 from g where src not in (select dst from g)
        union select distinct g.dst, w.depth + 1 from w join g on g.src = w.node where g.dst not in (select node from recurring.w))
    select f.id as node, coalesce(w.depth, 0) as depth, w.node is not null as reached from f left join w on w.node = f.id"""
)
def call_depth_full(s, d):
    """All depths below entry points; functions that no entry point reaches have depth 0 and are not marked as reached."""
    return graph.call_depths(ents(s, d), rels(s, d))


@query(
    WITH.replace("with ", "with recursive ", 1)
    + CALLS
    + """, g as (select distinct src, dst from c),
    w(node, depth) using key (node) as (select distinct src, 0 from g where src not in (select dst from g)
        union select distinct g.dst, w.depth + 1 from w join g on g.src = w.node where g.dst not in (select node from recurring.w))
    select node, depth from w"""
)
def call_depth(s, d):
    """Depths, however great, of the functions that entry points reach."""
    return graph.call_depths(ents(s, d), rels(s, d)).where("reached").select("node", "depth")


INHERIT = ", g as (select distinct src, dst from rel where type in ('INHERITS', 'EXTENDS', 'IMPLEMENTS') and src is not null and dst is not null and src <> dst) "


def inherits(s, d):
    return rels(s, d).where(F.col("type").isin("INHERITS", "EXTENDS", "IMPLEMENTS")).select("src", "dst")


@query("with recursive " + ENT + ", " + REL + INHERIT + ", w as (select dst as id, src as caller from g union select w.id, g.src from w join g on g.dst = w.caller) select w.id, (select count(*) from g where g.dst = w.id) as direct, count(*) - 1 as transitive, (select count(*) from g where g.dst = w.id) + 0.5::double * (count(*) - 1) as score from w group by w.id")
def impact_scores(s, d):
    """Impact along inheritance, as the SQL has it; call_impact is the impact of functions over the call graph."""
    return graph.impact(inherits(s, d))


@query("with recursive " + ENT + ", " + REL + INHERIT + ", w as (select src as start, [src] as path, src as last from g where src not in (select dst from g) union all select w.start, list_append(w.path, g.dst), g.dst from w join g on g.src = w.last where len(w.path) < 10 and not list_contains(w.path, g.dst)) select distinct start, array_to_string(path, '>') as path, len(path) + 0.5::double * len(path) as complexity from w where len(path) > 1 and (last not in (select src from g) or len(path) = 10)")
def inheritance_paths(s, d):
    g = inherits(s, d).where("src is not null and dst is not null and src <> dst")
    start = g.select(F.col("src").alias("id")).distinct().join(g.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    paths = graph.simple_paths(g, start)
    weighted = graph.path_complexity(paths, s.createDataFrame([], "id string, weight double"))
    return weighted.select("start", F.array_join("path", ">").alias("path"), "complexity")


TRANSITIONS = "with t as (select event_type as src, lead(event_type) over (partition by user_id order by ts, event_id) as dst from events), e as (select src, dst, count(*) as frequency from t where dst is not null group by all) "


def transitions(s, d):
    t = table(s, d, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("dst"))
    return t.where("dst is not null").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("frequency"))


@query(TRANSITIONS + "select * from e")
def event_transitions(s, d):
    return transitions(s, d)


@query(TRANSITIONS.replace("with t", "with recursive t") + ", w as (select src as start, dst as node, [src] as path from e where dst > src union all select w.start, e.dst, list_append(w.path, w.node) from w join e on e.src = w.node where w.node <> w.start and e.dst >= w.start and (e.dst = w.start or not list_contains(w.path, e.dst)) and e.dst <> w.node) select distinct array_to_string(path, '>') as cycle from w where node = start")
def cycles_canonical(s, d):
    """All cycles of the graph of event types, each from its smallest node. The graph has as many nodes as there are types."""
    e = transitions(s, d).select("src", "dst")
    open_, done = e.where("dst > src").select(F.col("src").alias("start"), F.col("dst").alias("node"), F.array("src").alias("path")), None
    for _ in range(12):
        step = open_.where("node <> start").join(F.broadcast(e), F.col("node") == F.col("src")).where("dst >= start and dst <> node").where((F.col("dst") == F.col("start")) | ~F.array_contains("path", F.col("dst")))
        open_ = graph.cut(step.select("start", F.col("dst").alias("node"), F.concat("path", F.array("node")).alias("path")))
        if open_.isEmpty():
            break
        closed = open_.where("node = start").select(F.array_join("path", ">").alias("cycle"))
        done = closed if done is None else done.unionByName(closed)
    return (done if done is not None else e.where("false").select(F.col("src").alias("cycle"))).distinct()


@query(WITH + ", d as (select distinct src, dst from rel where src is not null and dst is not null) select e.id, (select count(*) from d where d.dst = e.id) as in_degree, (select count(*) from d where d.src = e.id) as out_degree from ent e")
def degrees(s, d):
    return graph.degrees(rels(s, d), ents(s, d))


@query(WITH + "select id from ent where id not in (select src from rel where src is not null) and id not in (select dst from rel where dst is not null)")
def isolated(s, d):
    return graph.degrees(rels(s, d), ents(s, d)).where("in_degree = 0 and out_degree = 0").select("id")


@query(
    WITH
    + """, u as (select distinct least(src, dst) as a, greatest(src, dst) as b from rel where src is not null and dst is not null and src <> dst and type <> 'CONTAINS'),
    t as (select x.a as a, x.b as b, y.b as c from u x join u y on x.b = y.a join u z on z.a = x.a and z.b = y.b), n as (select unnest([a, b, c]) as id from t), deg as (select id, count(*) as degree from (select unnest([a, b]) as id from u) group by id)
    select deg.id, coalesce(k.triangles, 0) as triangles, degree, round(case when degree > 1 then 2.0::double * coalesce(k.triangles, 0) / (degree * (degree - 1)) else 0 end, 6) as clustering from deg left join (select id, count(*) as triangles from n group by id) k on k.id = deg.id"""
)
def triangles(s, d):
    return graph.triangles(rels(s, d).where("type <> 'CONTAINS'")).withColumn("clustering", F.round("clustering", 6))


@query("with recursive " + ENT + ", " + REL + INHERIT + ", b as (select src as a, dst as b from g union select dst, src from g), w as (select a as node, a as reach from b union select w.node, b.b from w join b on b.a = w.reach) select node, min(reach) as component from w group by node")
def components(s, d):
    """Components along inheritance, as the SQL has them; graph_components takes all relationships."""
    return hierarchy.components(inherits(s, d).where("src is not null and dst is not null and src <> dst"))


@query(
    WITH.replace("with ", "with recursive ", 1)
    + """, g as (select distinct src, dst from rel where src is not null and dst is not null), b as (select src as a, dst as b from g union select dst, src from g),
    w(node, component) using key (node) as (select a, min(least(a, b)) from b group by a
        union select b.b, min(w.component) from w join b on b.a = w.node join recurring.w r on r.node = b.b where w.component < r.component group by b.b)
    select node, component from w"""
)
def graph_components(s, d):
    """Connected components over all kinds of relationships; an entity related only to itself is a component."""
    return hierarchy.components(graph.cut(graph.adjacency(rels(s, d), True)))


# retrieval on embeddings


def scored(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()
    return retrieval.score_against(e, list(q.embedding) if q else [0.0]).select(F.col("vec_id").alias("id"), "label", F.round("score", 6).alias("score"))


SIM = "with q as (select embedding as v from embeddings where vec_id = 0), s as (select vec_id as id, label, round(list_cosine_similarity(embedding::double[], v::double[]), 6) as score from embeddings, q) "


@query(SIM + "select id, score from s order by score desc, id limit 20")
def sim_topk(s, d):
    return retrieval.top_k(scored(s, d), 20).select("id", "score")


@query(SIM + "select id, score from s where score >= 0.3")
def sim_threshold(s, d):
    return scored(s, d).where("score >= 0.3").select("id", "score")


@query(SIM + "select id, (1 + score) / 2 as score from s")
def sim_normalized(s, d):
    return scored(s, d).select("id", C.normalized_score("score").alias("score"))


@query("with q as (select embedding as v from embeddings where vec_id = 0), s as (select vec_id as id, list_sum(list_transform(list_zip(embedding::double[], v::double[]), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as d from embeddings, q) select id, round(case when d = 0 then 1 else greatest(0.01::double, 1 - least(0.98::double, d / 10)) end, 5) as score from s")
def sim_distance_map(s, d):
    e = table(s, d, "embeddings")
    q = e.where("vec_id = 0").select("embedding").first()
    return retrieval.score_against(e, list(q.embedding) if q else [0.0], score="distance").select(F.col("vec_id").alias("id"), F.round("score", 5).alias("score"))


KIND = "case when label % 3 = 0 then 'FUNCTION' when label % 3 = 1 then 'CLASS' else 'VARIABLE' end"
HYB = SIM + f", h as (select id, label, {KIND} as entity_type, round(least(1.0::double, score + case when {KIND} = 'FUNCTION' then 0.1 else 0 end), 6) as score from s where score >= 0.0) "


def hybrids(s, d):
    kind = F.when(F.col("label") % 3 == 0, "FUNCTION").when(F.col("label") % 3 == 1, "CLASS").otherwise("VARIABLE")
    return retrieval.hybrid(scored(s, d).where("score >= 0").withColumn("entity_type", kind), "which function parses this?").withColumn("score", F.round("score", 6))


@query(HYB + "select id, score, row_number() over (order by score desc, id)::int as rank from h qualify rank <= 20")
def hybrid_rerank(s, d):
    return retrieval.ranked(hybrids(s, d), 20).select("id", "score", "rank")


@query(HYB + ", r as (select *, row_number() over (order by score desc, id) as rk, row_number() over (partition by label order by score desc, id) as rf from h) select id, score, row_number() over (order by score desc, id)::int as rank from r where rk <= 10 or rf <= 4 qualify rank <= 20")
def diversify(s, d):
    return retrieval.diversify(hybrids(s, d), 20, "label").select("id", "score", "rank")


@query(HYB + ", a as (select id, round(case when entity_type in ('FUNCTION', 'CLASS') then least(1.0::double, score + 0.2) else score end, 6) as score from h where score >= 0.3) select id, score, row_number() over (order by score desc, id)::int as task_rank, case when row_number() over (order by score desc, id) <= 9 then 'primary' else 'supporting' end as tier from a qualify task_rank <= 18")
def task_adapt(s, d):
    return retrieval.adapt_to_task(hybrids(s, d), "bug_fix").withColumn("score", F.round("score", 6)).select("id", "score", "task_rank", "tier")


@query(HYB + ", r as (select score, row_number() over (order by score desc, id) as rk from h qualify rk <= 20) select round(sum(score / rk) / sum(1.0::double / rk), 3) as confidence from r")
def overall_confidence(s, d):
    return retrieval.overall_confidence(retrieval.ranked(hybrids(s, d), 20))


@query(HYB + ", r as (select score, row_number() over (order by score desc, id) as rk from h qualify rk <= 20) select round(avg(score), 6) as relevance, least(1.0::double, count(*) filter (where score > 0.7) / 10.0::double) as coverage from r")
def query_quality(s, d):
    return retrieval.quality(retrieval.ranked(hybrids(s, d), 20), 20)


@query()
def retrieve_context(s, d):
    """The whole retrieval on real vectors: score, threshold, multi-hop context, hybrid re-ranking, diversification, task."""
    raw = table(s, d, "code_entities").select(norm_id("id").alias("id"), "updated_at", "embedding_vector").where("id is not null and size(embedding_vector) = 384")
    q = raw.orderBy("id", F.desc("updated_at")).limit(1).first()
    vector = [float(x or 0) for x in q.embedding_vector] if q else [0.0] * 384
    # vectors are scored where they lie; what is shuffled, kept and expanded is (id, score), and only what is shown is looked up
    sc = graph.cut(retrieval.score_against(raw, vector, "embedding_vector").groupBy("id").agg(F.max_by("score", "updated_at").alias("score")))
    seeds = graph.cut(retrieval.top_k(sc.where("score >= 0.3 and not isnan(score)"), 40))
    context = graph.hop_expansion(graph.relationships_near(table(s, d, "relationships")), sc.select("id", C.relevance("score").alias("relevance")), seeds.select("id", "score"))
    found = graph.cut(seeds.unionByName(context.where("hop > 0").select("id", "score")))
    code = table(s, d, "code_entities").withColumn("id", norm_id("id"))
    code = code.join(F.broadcast(found.select("id").distinct()), "id", "left_semi") if graph.few(found) else code.join(found.select("id").distinct(), "id", "left_semi")
    best = retrieval.diversify(retrieval.hybrid(graph.entities(code).join(found, "id"), "fix the function"), 20)
    return retrieval.result_rows(retrieval.adapt_to_task(best.drop("rank"), "bug_fix").withColumnRenamed("task_rank", "rank"), ["FUNCTION"], [])


@query()
def result_insights(s, d):
    e = ents(s, d).withColumn("score", F.round(F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0, 3))
    return retrieval.insights(retrieval.ranked(e, 20), 20)


@query()
def result_summary(s, d):
    e = ents(s, d).withColumn("score", F.round(F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000.0, 3))
    return retrieval.context_summary(retrieval.ranked(e, 20), "debug")


@query()
def embedded_entities(s, d):
    """Vectors of all entities by the default provider."""
    e = graph.entities(table(s, d, "code_entities"), ["entity_type", "name", "signature", "docstring", "content", "language"])
    return embed.embed_column(e.select("id", C.recipe_full("entity_type", "name", "signature", "docstring", "content").alias("text")), "text").select("id", "embedding")


def _hub_context(s, d):
    seeds = hub(s, d).select("id", F.lit(1.0).alias("score"))
    return graph.cut(graph.hop_expansion(rels(s, d), ents(s, d).select("id", F.lit(0.9).alias("relevance")), seeds, hops=1))


@query()
def context_snippets(s, d):
    return retrieval.context_snippets(_hub_context(s, d), ents(s, d), rels(s, d))


@query()
def context_graph_summary(s, d):
    return retrieval.context_graph_summary(_hub_context(s, d), ents(s, d))


@query()
def task_metadata(s, d):
    found = graph.cut(extract.entity_rows(extract.extract_files(_python_files(s, d))).where("entity_type = 'FUNCTION'").dropDuplicates(["id"]))
    return retrieval.task_metadata(found.select("id", "name", "entity_type"), found.select("id", "cyclomatic_complexity", "side_effects", "dependencies"))


@query()
def contextual_chunks(s, d):
    return chunking.contextual_chunks(graph.entities(table(s, d, "code_entities"), ["repository_id", "entity_type", "name", "file_path", "start_line", "end_line", "parent_entity_id", "content", "language"]))


# texts


DOCS = "select doc_id, text from documents"


@query("with l as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where text is not null), c as (select *, sum(length(line)) over (partition by doc_id order by i) as n from l), k as (select doc_id, any_value(text) as text, coalesce(min(i) filter (where n > 200), 1000000000) as stop from c group by doc_id), t as (select k.doc_id, k.text, coalesce(string_agg(l.line, chr(10) order by l.i), '') as part from k left join l on l.doc_id = k.doc_id and l.i < k.stop group by k.doc_id, k.text) select doc_id, part || case when length(text) > length(part) then '...' else '' end as snippet from t union all select doc_id, '' from documents where text is null")
def snippet_200(s, d):
    return table(s, d, "documents").select("doc_id", C.snippet("text").alias("snippet"))


@query("select doc_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10)) || case when len(string_split(text, chr(10))) > 3 then '...' else '' end as summary from documents")
def first_lines(s, d):
    return table(s, d, "documents").select("doc_id", C.first_lines("text").alias("summary"))


def _has(words: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


@query("select doc_id, case when text is null then null " + " ".join(f"when {_has(words)} then '{name}'" for name, words, _ in reversed(K.INTENT_RULES)) + " else 'general' end as category from documents")
def intent(s, d):
    return table(s, d, "documents").select("doc_id", C.intent_category("text").alias("category"))


@query("select doc_id, case when text is null then null else array_to_string(list_concat(" + ", ".join(f"case when {_has(words)} then [{', '.join(repr(t) for t in types)}] else [] end" for _, words, types in K.INTENT_RULES if types) + "), ',') end as types from documents")
def suggested_types(s, d):
    return table(s, d, "documents").select("doc_id", F.when(F.col("text").isNotNull(), F.array_join(C.suggested_types("text"), ",")).alias("types"))


def _task_score(patterns: list[str]) -> str:
    return " + ".join(f"contains(lower(text), '{p}')::int + contains(' ' || lower(text) || ' ', ' {p} ')::int" for p in patterns)


@query("with s as (select doc_id, text, " + ", ".join(f"({_task_score(p)}) as s{n}" for n, p in enumerate(K.TASK_PATTERNS.values())) + " from documents), m as (select *, greatest(" + ", ".join(f"s{n}" for n in range(len(K.TASK_PATTERNS))) + ") as best from s) select doc_id, case when text is null then null when best = 0 then 'implement_feature' " + " ".join(f"when s{n} = best then '{t}'" for n, t in enumerate(K.TASK_PATTERNS)) + " end as task from m")
def task_type(s, d):
    return spread(table(s, d, "documents").select("doc_id", "text")).select("doc_id", C.task_type("text").alias("task"))


@query("select doc_id, a as start, substring(text, a::int + 1, 2048) as chunk from (select doc_id, text, unnest(range(0, greatest(1, length(text) - 256), 1792)) as a from documents where text is not null)")
def fixed_chunks(s, d):
    t = table(s, d, "documents").where("text is not null").select("doc_id", "text", F.explode(C.chunk_starts(F.char_length("text"))).alias("a"))
    return t.select("doc_id", F.col("a").cast("long").alias("start"), F.substring("text", F.col("a") + 1, F.lit(2048)).alias("chunk"))


@query(WITH + "select id, md5(coalesce(nullif(content, ''), coalesce(nullif(signature, ''), name) || case when nullif(docstring, '') is null then '' else chr(10) || '# ' || substring(docstring, 1, 200) || case when length(docstring) > 200 then '...' else '' end end)) as digest from ent where name is not null")
def embed_text_short(s, d):
    return ents(s, d, "content").where("name is not null").select("id", F.md5(C.recipe_short("content", "signature", "name", "docstring")).alias("digest"))


@query(WITH + "select id, md5(concat_ws(chr(10), entity_type || ': ' || coalesce(name, ''), 'Signature: ' || nullif(signature, ''), 'Documentation: ' || nullif(docstring, ''), 'Content: ' || substring(nullif(content, ''), 1, 500))) as digest from ent where entity_type is not null")
def embed_text_full(s, d):
    return ents(s, d, "content").where("entity_type is not null").select("id", F.md5(C.recipe_full("entity_type", "name", "signature", "docstring", "content")).alias("digest"))


@query("select doc_id, md5(concat_ws('|', repository_id, lower(trim(text)), '20', '0.3', 'CLASS|FUNCTION', 'python', 'True')) as key from documents where text is not null")
def cache_key(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", C.cache_key("repository_id", "text", 20, 0.3, ["FUNCTION", "CLASS"], ["python"]).alias("key"))


@query("with l as (select doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))) as lines from documents where text is not null) select doc_id, len(list_filter(lines, lambda x: starts_with(x, 'import ') or starts_with(x, 'from ')))::int as imports, len(list_filter(lines, lambda x: contains(x, 'try:'))) > 0 as has_try, len(list_filter(lines, lambda x: contains(x, 'if ') or contains(x, 'elif ') or contains(x, 'else:'))) > 0 as has_conditionals, len(list_filter(lines, lambda x: contains(x, 'for ') or contains(x, 'while '))) > 0 as has_loops from l")
def text_semantics(s, d):
    t = table(s, d, "documents").where("text is not null").select("doc_id", C.text_semantics("text").alias("x"))
    return t.select("doc_id", F.size("x.imports").alias("imports"), "x.has_try", "x.has_conditionals", "x.has_loops")


@query(WITH + ", e as (select id, unnest([" + ", ".join(f"case when {' or '.join(f'contains(lower(name), {w!r})' for w in words)} then '{fam}: ' || lower(name) end" for fam, words in K.SIDE_EFFECT_WORDS.items()) + "]) as effect from ent where entity_type in ('FUNCTION', 'METHOD') and name is not null) select case when contains(effect, 'io') then 'io_operations' when contains(effect, 'state') then 'state_modifications' else 'external_calls' end as bucket, count(*) as n from e where effect is not null group by bucket")
def side_effect_buckets(s, d):
    e = ents(s, d).where(F.col("entity_type").isin("FUNCTION", "METHOD") & F.col("name").isNotNull()).select(F.explode(C.side_effect_families("name")).alias("effect"))
    return e.groupBy(C.side_effect_bucket("effect").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(WITH + "select id, file_path || ':' || start_line || '-' || end_line as location, greatest(1, end_line - start_line + 1) as line_count from ent where start_line is not null and end_line is not null and file_path is not null")
def locations(s, d):
    e = ents(s, d).where("start_line is not null and end_line is not null and file_path is not null")
    return e.select("id", C.location("file_path", "start_line", "end_line").alias("location"), C.line_count("start_line", "end_line").alias("line_count"))


def _tenths(n: int, unit: str) -> str:
    """n_chars divided by n with one decimal, half up, in whole numbers."""
    return f"(((n_chars * 20 + {n}) // {2 * n}) // 10) || '.' || (((n_chars * 20 + {n}) // {2 * n}) % 10) || '{unit}'"


@query(f"select doc_id, case when n_chars < 1024 then {_tenths(1, ' B')} when n_chars < 1048576 then {_tenths(1024, ' KB')} else {_tenths(1048576, ' MB')} end as size, case when n_chars < 60 then {_tenths(1, 's')} when n_chars < 3600 then {_tenths(60, 'm')} else {_tenths(3600, 'h')} end as duration from documents where n_chars is not null")
def formatted(s, d):
    return table(s, d, "documents").where("n_chars is not null").select("doc_id", C.file_size("n_chars").alias("size"), C.duration("n_chars").alias("duration"))


# files


@query("select doc_id, md5(text) as hash from documents")
def content_hash(s, d):
    return table(s, d, "documents").select("doc_id", F.md5("text").alias("hash"))


@query("with o as (select doc_id, md5(text) as h from documents where text is not null and doc_id % 7 <> 0), n as (select doc_id, md5(case when doc_id % 5 = 0 then text || '!' else text end) as h from documents where text is not null and doc_id % 11 <> 0) select coalesce(o.doc_id, n.doc_id) as doc_id, case when o.doc_id is null then 'added' when n.doc_id is null then 'removed' else 'modified' end as change from o full join n on o.doc_id = n.doc_id where o.doc_id is null or n.doc_id is null or o.h <> n.h")
def changed_files(s, d):
    """Two states of the corpus made from its rows - some left out, some altered - compared by digest."""
    t = table(s, d, "documents").where("text is not null")
    old = t.where("doc_id % 7 <> 0").select("doc_id", F.md5("text").alias("hash"))
    new = t.where("doc_id % 11 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("hash"))
    return source_files.changed_files(old, new, ["doc_id"])


EXT = "lower(regexp_extract(regexp_extract(file_path, '[^/]*$'), '^.+(\\.[^.]+)$', 1))"


@query(WITH + f"select id, case {EXT} " + " ".join(f"when '{k}' then '{v}'" for k, v in K.LANGUAGE_BY_EXTENSION.items()) + " end as detected from ent where entity_type = 'FILE'")
def language_from_ext(s, d):
    return ents(s, d).where("entity_type = 'FILE'").select("id", C.detect_language("file_path").alias("detected"))


def _rules_sql() -> str:
    rules = source_only()
    parts = [glob_regex(p[:-1]) for p in rules.patterns() if p.endswith("/") and p.count("/") == 1]
    names = [glob_regex(p) for p in rules.patterns() if "/" not in p]
    lit = lambda xs: "'" + "|".join(xs).replace("'", "''") + "'"
    return f"len(list_filter(string_split(file_path, '/'), lambda p: regexp_matches(p, {lit(parts)}))) > 0 or regexp_matches(regexp_extract(file_path, '[^/]*$'), {lit(names)})"


@query(WITH + f"select id, case when {_rules_sql()} then 'pattern' when {EXT} <> '' and {EXT} not in ({', '.join(repr(x) for x in K.SOURCE_EXTENSIONS)}) then 'not_source_extension' else 'include' end as reason from ent where entity_type = 'FILE'")
def path_filter(s, d):
    return ents(s, d).where("entity_type = 'FILE'").select("id", source_only().reason("file_path").alias("reason"))


@query(WITH + "select id from ent where entity_type = 'FILE' and regexp_matches(file_path, '^src/.*\\.py$')")
def include_glob(s, d):
    return retrieval.matching(ents(s, d), types=["FILE"], path="src/*.py").select("id")


# spans, checks, imports


@query(WITH + ", c as (select distinct repository_id, file_path, start_line, end_line, id from ent where entity_type = 'CLASS' and start_line is not null and end_line >= start_line), m as (select repository_id, file_path, start_line, end_line, id from ent where entity_type = 'METHOD' and start_line is not null and end_line >= start_line) select m.id as a, c.id as b from m join c on m.repository_id = c.repository_id and m.file_path = c.file_path and m.start_line <= c.end_line and c.start_line <= m.end_line")
def span_overlap(s, d):
    e = ents(s, d).where("start_line is not null and end_line >= start_line")
    m = e.where("entity_type = 'METHOD'").select(F.col("id").alias("a"), "repository_id", "file_path", F.col("start_line").alias("a0"), F.col("end_line").alias("a1"))
    c = e.where("entity_type = 'CLASS'").select(F.col("id").alias("b"), "repository_id", "file_path", F.col("start_line").alias("b0"), F.col("end_line").alias("b1"))
    return m.join(c, ["repository_id", "file_path"]).where(C.overlaps("a0", "a1", "b0", "b1")).select("a", "b")


@query(WITH + f"select 'type' as rule, count(*) as n from ent where entity_type is null or entity_type not in ({', '.join(repr(x) for x in K.ENTITY_TYPES)}) having count(*) > 0 union all select 'lines', count(*) from ent where end_line < start_line having count(*) > 0 union all select 'first_line', count(*) from ent where start_line < 1 having count(*) > 0 union all select 'columns', count(*) from ent where start_line = end_line and end_column < start_column having count(*) > 0 union all select 'name', count(*) from ent where name is null or name = '' having count(*) > 0")
def entity_problems(s, d):
    e = ents(s, d).withColumn("embedding_vector", F.array().cast("array<float>"))
    return e.select(F.explode(C.entity_problems()).alias("rule")).where("rule <> 'path'").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(WITH + f"select 'type' as rule, count(*) as n from rel where type is null or type not in ({', '.join(repr(x) for x in K.RELATIONSHIP_TYPES)}) having count(*) > 0 union all select 'ends', count(*) from rel where src is null or dst is null having count(*) > 0 union all select 'self', count(*) from rel where src = dst having count(*) > 0 union all select 'strength', count(*) from rel where not (strength between 0 and 1) having count(*) > 0")
def relationship_problems(s, d):
    return rels(s, d).select(F.explode(C.relationship_problems()).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


# logs and streams


@query("select event_type, count(*) as queries, round(avg(value), 6) as mean_time, round(count(*) filter (where event_type <> 'error') / count(*)::double, 6) as success_rate from events group by event_type")
def query_stats(s, d):
    return stats.query_statistics(table(s, d, "events").withColumn("ok", F.col("event_type") != "error"), "event_type", "value", "ok")


@query("select user_id, event_id, ts, event_type from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_per_key(s, d):
    return graph.first_per(table(s, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "ts", "event_type")


@query("select user_id, event_id from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) <= 5")
def last_five(s, d):
    t = table(s, d, "events").withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))))
    return t.where("n <= 5").select("user_id", "event_id")


@query("select event_id, event_type from events order by ts, event_id limit 20 offset 40")
def pagination(s, d):
    return table(s, d, "events").orderBy("ts", "event_id").offset(40).limit(20).select("event_id", "event_type")


@query("select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n from events group by all")
def stream_window_counts(s, d):
    return ev.window_counts(table(s, d, "events")).drop("total")


@query("select label, 1000.0::double * count(*) / greatest(1, sum(len(embedding))) as entries_per_second, sum(len(embedding)) / greatest(1, count(*))::double as bytes_per_entry from embeddings group by label")
def index_metrics(s, d):
    built = table(s, d, "embeddings").groupBy("label").agg(F.sum(F.size("embedding")).alias("build_ms"), F.sum(F.size("embedding")).alias("bytes"), F.count(F.lit(1)).alias("entries"))
    return stats.build_metrics(built).select("label", "entries_per_second", "bytes_per_entry")


# extraction


def _python_files(s, d):
    f = table(s, d, "code_entities").where((norm_enum("entity_type") == "FILE") & F.col("content").isNotNull())
    return f.select("repository_id", "file_path", C.detect_language("file_path").alias("language"), "content").distinct()


@query()
def extract_entities(s, d):
    rows = extract.entity_rows(extract.extract_files(_python_files(s, d)))
    return rows.select("repository_id", "file_path", "id", "entity_type", "name", "start_line", "end_line", "parent_entity_id", "cyclomatic_complexity")


@query()
def extract_relationships(s, d):
    return extract.relationship_rows(extract.extract_files(_python_files(s, d)))


@query()
def extract_stats(s, d):
    return extract.parse_stats(extract.extract_files(_python_files(s, d)))


@query()
def ast_metrics(s, d):
    @F.pandas_udf("struct<lines_of_code:int,cyclomatic_complexity:int,mccabe:int,nesting_depth:int,number_of_variables:int,number_of_calls:int>")
    def measure(c):
        import pandas as pd

        empty = dict.fromkeys(["lines_of_code", "cyclomatic_complexity", "mccabe", "nesting_depth", "number_of_variables", "number_of_calls"])
        return pd.DataFrame([flow.metrics(x, compat=False) or empty if x else empty for x in c], columns=list(empty), dtype="Int32")

    e = ents(s, d, "content").where((F.col("language") == "python") & F.col("entity_type").isin("FUNCTION", "METHOD"))
    return e.select("id", measure("content").alias("m")).select("id", "m.*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
