"""Queries of rules, checks and reports on the graph, with equivalent SQL. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..operators import extract, flow, graph, hierarchy, retrieval, stats
from ..sources import files as source_files
from ..sources.filters import filter_stats, glob_regex, source_only
from ..streaming import events as ev
from ..tables import table
from .graph_queries import CALLS, EXT, HUB, REPOS, SIM, WITH, _rules_sql, _task_score, _weights, call_impacts, calls, ents, hub, query, rels, repos, scored

RECURSIVE = WITH.replace("with ", "with recursive ", 1)
NOW = "2026-01-01 00:00:00"


# rules on one row


@query(SIM + "select id, score from s where score >= 0.7")
def highly_relevant(s, d):
    return scored(s, d).where(C.highly_relevant("score")).select("id", "score")


@query("with q as (select embedding as v, label as l from embeddings where vec_id = 0) select vec_id as id, round(list_cosine_similarity(embedding::double[], v::double[]), 6) as similarity, round(list_cosine_similarity(embedding::double[], v::double[]), 6) >= 0.85 as alike, label = l as alike_by_text from embeddings, q")
def entity_similarities(s, d):
    """Similarity of entities, and of queries: by vectors where both have one, else by their texts."""
    e = table(s, d, "embeddings")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("embedding").alias("v"), F.col("label").alias("l")))
    none = F.lit(None).cast("array<float>")
    text = lambda c: F.concat(F.lit(" "), F.col(c).cast("string"))
    return e.crossJoin(q).select(
        F.col("vec_id").alias("id"), F.round(C.entity_similarity("embedding", "v"), 6).alias("similarity"),
        C.is_similar("embedding", "v", text("label"), text("l")).alias("alike"), C.is_similar("embedding", none, text("label"), text("l")).alias("alike_by_text"),
    )


@query(f"with {REPOS} select id, (last_indexed is null or date_diff('second', last_indexed, timestamp '{NOW}') / 3600.0::double > 24) as rebuild from repo")
def index_rebuild(s, d):
    return repos(s, d).select("id", C.needs_rebuild("last_indexed", F.lit(NOW).cast("timestamp")).alias("rebuild"))


@query(WITH + "select id, (10 between start_line and end_line) as has_line from ent where start_line is not null and end_line is not null")
def line_membership(s, d):
    return ents(s, d).where("start_line is not null and end_line is not null").select("id", C.contains_line("start_line", "end_line", 10).alias("has_line"))


@query(WITH + ", r as (select id, file_path, start_line, end_line, entity_type from ent where start_line is not null and end_line >= start_line and file_path is not null) select c.id as a, v.id as b from r c join r v on c.file_path = v.file_path and c.start_line <= v.end_line and v.start_line <= c.end_line where c.entity_type = 'CLASS' and v.entity_type = 'VARIABLE'")
def result_overlap(s, d):
    """Results overlap by file and lines, whatever their repository."""
    e = ents(s, d).where("start_line is not null and end_line >= start_line and file_path is not null")
    side = lambda kind, name: e.where(F.col("entity_type") == kind).select(F.col("id").alias(name), "file_path", F.col("start_line").alias(f"{name}0"), F.col("end_line").alias(f"{name}1"))
    return side("CLASS", "a").join(side("VARIABLE", "b"), "file_path").where(C.overlaps("a0", "a1", "b0", "b1")).select("a", "b")


@query(
    f"with {REPOS} select 'hash' as rule, count(*) as n from repo where not regexp_full_match(lower(trim(git_hash)), '[0-9a-f]{{7,40}}') having count(*) > 0 "
    f"union all select 'future', count(*) from repo where last_indexed > timestamp '{NOW}' or last_modified > timestamp '{NOW}' having count(*) > 0 "
    "union all select 'counts', count(*) from repo where size_bytes < 0 or file_count < 0 or len(list_filter(map_values(language_stats), lambda x: x < 0)) > 0 having count(*) > 0"
)
def repository_rules(s, d):
    return repos(s, d).select(F.explode(C.repository_problems(F.lit(NOW).cast("timestamp"))).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(
    WITH + ", v as (select id, file_path, len(list_filter(embedding_vector, lambda x: abs(x) > 100)) > 0 as far from ent) select 'path' as rule, count(*) as n from v where file_path is null or file_path = '' or starts_with(file_path, '/') or regexp_matches(file_path, '^.:') having count(*) > 0 "
    "union all select 'vector', count(*) from v where far having count(*) > 0"
)
def entity_place_problems(s, d):
    """The rules on paths and vectors; entity_problems has the others."""
    e = ents(s, d, "embedding_vector")
    return e.select(F.explode(C.entity_problems()).alias("rule")).where("rule in ('path', 'vector')").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, " + ", ".join(f"({_task_score(p)})::int as {t}" for t, p in K.TASK_PATTERNS.items()) + " from documents where text is not null")
def task_scores(s, d):
    found = table(s, d, "documents").where("text is not null").select("doc_id", C.task_scores("text").alias("x"))
    return found.select("doc_id", *[F.col("x")[n]["score"].alias(t) for n, t in enumerate(K.TASK_PATTERNS)])


# relationships


@query(WITH + "select id, strength as old_strength, round(strength * 0.5, 6) as strength, 'rarely used' as reason from rel where frequency <= 2 and strength between 0 and 1")
def strength_updates(s, d):
    r = rels(s, d)
    changes = r.where("frequency <= 2").select("id", F.round(F.col("strength") * 0.5, 6).alias("new_strength"), F.lit("rarely used").alias("reason"))
    return graph.update_strengths(r, changes).select("id", F.col("audit.old_strength").alias("old_strength"), "strength", "audit.reason").where("reason is not null")


@query(WITH + ", v as (select max(repository_id) as gone from repositories r join (select distinct repository_id from ent) e on e.repository_id = r.id), x as (select e.id from ent e, v where e.repository_id = v.gone), k as (select id from ent where id not in (select id from x)) select 'entities' as part, count(*) as n from k union all select 'relationships', count(*) from rel, v where rel.repository_id is distinct from v.gone and (src is null or src not in (select id from x)) and (dst is null or dst not in (select id from x))")
def detached_delete(s, d):
    """What is left when a repository is deleted with its entities and all relationships of these."""
    e, r = ents(s, d), rels(s, d)
    gone = table(s, d, "repositories").select(F.col("id").alias("repository_id")).join(e.select("repository_id").distinct(), "repository_id", "left_semi").agg(F.max("repository_id")).first()[0]
    kept, edges = graph.detach_delete(e, r, gone)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count(kept, "entities").unionByName(count(edges, "relationships"))


@query(WITH + "select (select count(*) from ent) as nodes, (select count(*) from rel) as relationships")
def graph_counts(s, d):
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(ents(s, d), "nodes").crossJoin(F.broadcast(count(rels(s, d), "relationships")))


@query("select 'code_entities' as \"table\", lower(trim(id)) as id, count(*) as n from code_entities where id is not null group by all having count(*) > 1 union all select 'relationships', lower(trim(id)), count(*) from relationships where id is not null group by all having count(*) > 1")
def unique_violations(s, d):
    each = [stats.repeated_keys(table(s, d, t).select(F.lower(F.trim("id")).alias("id")), "id").select(F.lit(t).alias("table"), "id", "n") for t in ("code_entities", "relationships")]
    return each[0].unionByName(each[1])


@query(WITH + f", {REPOS}, f as (select repository_id, count(*) as stored from ent where entity_type = 'FILE' group by all) select repo.id, file_count as expected, coalesce(stored, 0) as stored, file_count is not distinct from coalesce(stored, 0) as consistent from repo left join f on f.repository_id = repo.id")
def stored_consistency(s, d):
    stored = ents(s, d).where("entity_type = 'FILE'").groupBy(F.col("repository_id").alias("id")).agg(F.count(F.lit(1)).alias("stored"))
    return stats.consistency(repos(s, d).select("id", F.col("file_count").alias("expected")), stored)


@query(WITH + f", {REPOS}, m as (select id, unnest(map_keys(language_stats)) as language, unnest(map_values(language_stats)) as n from repo union all select repository_id, language, count(*) from ent where language is not null and entity_type = 'FILE' group by all) select id, language, sum(coalesce(n, 0))::bigint as n from m where id in (select id from repo) group by all")
def merged_language_counts(s, d):
    counted = ents(s, d).where("language is not null and entity_type = 'FILE'").groupBy(F.col("repository_id").alias("id"), "language").agg(F.count(F.lit(1)).alias("n"))
    counted = counted.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("language", "n"))).alias("found"))
    none = F.create_map().cast("map<string,bigint>")
    both = repos(s, d).select("id", F.coalesce("language_stats", none).alias("told")).join(counted, "id", "left").withColumn("found", F.coalesce("found", none))
    return both.select("id", F.explode(stats.merged_counts("told", "found")).alias("language", "n"))


@query(WITH + "select repository_id, count(*) as file_count, coalesce(sum(strlen(content)), 0)::bigint as size_bytes from ent where entity_type = 'FILE' group by all")
def repository_sizes(s, d):
    f = ents(s, d, "content").where("entity_type = 'FILE'").select("repository_id", F.octet_length(F.coalesce("content", F.lit(""))).cast("long").alias("size"))
    return source_files.repository_stats(f)


@query(WITH + "select id from ent where entity_type = 'FILE' and (" + " or ".join(f"regexp_full_match(file_path, '{glob_regex(g)}')" for x in ("python", "go") for g in source_files.LANGUAGE_GLOBS[x]) + ")")
def files_by_language(s, d):
    globs = [g for x in ("python", "go") for g in source_files.LANGUAGE_GLOBS[x]]
    return ents(s, d).where((F.col("entity_type") == "FILE") & F.col("file_path").rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))).select("id")


@query(WITH + "select id, md5(concat_ws('\\n', entity_type || ': ' || name, nullif(signature, ''), nullif(docstring, ''), 'Content: ' || case when length(content) > 1000 then substring(content, 1, 1000) || '...' else nullif(content, '') end)) as document from ent where len(embedding_vector) > 0 and entity_type is not null and name is not null")
def vector_documents(s, d):
    e = ents(s, d, "content", "embedding_vector").where("size(embedding_vector) > 0 and entity_type is not null and name is not null")
    return e.select("id", F.md5(C.vector_document("entity_type", "name", "signature", "docstring", "content")).alias("document"))


# call graph

CLOSURE = CALLS + ", g as (select distinct src, dst from c where src <> dst), w as (select dst as id, src as caller from g union select w.id, g.src from w join g on g.dst = w.caller), imp as (select w.id, (select count(*) from g where g.dst = w.id) as direct, count(*) - 1 as transitive from w group by w.id) "
NAMES = (
    ", fn as (select id, name, qualified_name, content from ent where entity_type in ('FUNCTION', 'METHOD')), parts as (select id, string_split(qualified_name, '.') as p from fn where qualified_name is not null), ends as (select id, array_to_string(list_slice(p, i, len(p)), '.') as called from (select id, p, unnest(range(2, len(p) + 1)) as i from parts)), "
    "keys as (select called, min(id) as target_id from (select id, called from ends where called <> '' union all select id, name from fn) group by called), names as (select distinct id as source_id, unnest(regexp_extract_all(content, '([A-Za-z_]\\w*)\\(', 1)) as called from fn where content is not null), "
    "m as (select source_id, called, target_id from names join keys using (called) where source_id <> target_id) "
)


def content_calls(s, d):
    e = ents(s, d, "content").where(F.col("entity_type").isin("FUNCTION", "METHOD"))
    names = e.where("content is not null").select(F.col("id").alias("source_id"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"([A-Za-z_]\w*)\("), 1))).alias("called"))
    return graph.resolve_calls(names, e.select("id", "name", "qualified_name")).where("source_id <> target_id")


@query(WITH + NAMES + "select source_id, called, target_id from m")
def call_name_match(s, d):
    return content_calls(s, d)


@query(WITH + CALLS + NAMES + ", u as (select src, dst from c union select source_id, target_id from m) select f.id, coalesce(o.n, 0) as callees, coalesce(i.n, 0) as callers, coalesce(k.n, 0) as call_count from f left join (select src, count(*) as n from u group by src) o on o.src = f.id left join (select dst, count(*) as n from u group by dst) i on i.dst = f.id left join (select dst, count(*) as n from c group by dst) k on k.dst = f.id")
def full_call_nodes(s, d):
    """Call nodes with the calls found in contents: these widen callers and callees, and leave the count of calls as it is."""
    return graph.with_content_calls(graph.call_nodes(ents(s, d), rels(s, d)), calls(s, d), content_calls(s, d)).select("id", "callees", "callers", "call_count")


@query(RECURSIVE + CLOSURE + "select id, direct, transitive, direct + 0.5::double * transitive as score from imp")
def call_impact(s, d):
    """Impact of called functions over the whole call graph."""
    return call_impacts(s, d)


@query(RECURSIVE + CLOSURE + "select id, direct + 0.5::double * transitive as score, row_number() over (order by direct + 0.5::double * transitive desc, id)::int as rank from imp qualify rank <= 20")
def impact_top(s, d):
    return graph.impact_top(call_impacts(s, d), 20)


@query(RECURSIVE + CLOSURE + "select id from imp where direct > 3 or transitive > 10")
def critical_functions(s, d):
    return graph.critical(call_impacts(s, d)).select("id")


@query(
    RECURSIVE + CLOSURE + ", ring as (select a.id, min(a.caller) as cycle from w a join w b on a.id = b.caller and a.caller = b.id group by a.id), "
    "dep(node, depth) using key (node) as (select distinct src, 0 from c where src not in (select dst from c) union select distinct c.dst, dep.depth + 1 from dep join c on c.src = dep.node where c.dst not in (select node from recurring.dep)) "
    "select round((select count(*) from c) / (select count(*) from f)::double + 2 * (select count(distinct cycle) from ring) + 1.5::double * (select coalesce(max(depth), 0) from dep), 6) as complexity"
)
def call_graph_complexity(s, d):
    """One row: calls by function, cycles (groups of functions that call each other) and the greatest depth."""
    e, r, c = ents(s, d), rels(s, d), calls(s, d)
    one = lambda df, agg, name: F.broadcast(df.agg(agg.alias(name)))
    edges = graph.cut(graph.adjacency(c, True).where("src <> dst"))
    row = one(c, F.count(F.lit(1)), "calls").crossJoin(one(e.where(F.col("entity_type").isin("FUNCTION", "METHOD")), F.count(F.lit(1)), "functions"))
    row = row.crossJoin(one(hierarchy.find_cycles(edges), F.countDistinct("cycle"), "cycles")).crossJoin(one(graph.call_depths(e, r), F.coalesce(F.max("depth"), F.lit(0)), "depth"))
    return row.select(F.round(graph.overall_complexity(F.col("calls"), F.col("functions"), F.col("cycles"), F.col("depth")), 6).alias("complexity"))


@query(RECURSIVE + ", g as (select distinct src, dst from rel where src is not null and dst is not null and type in ('IMPORTS', 'DEPENDS_ON', 'CALLS')), w as (select src as a, dst as b from g union select w.a, g.dst from w join g on g.src = w.b), ring as (select x.a, min(x.b) as cycle from w x join w y on x.a = y.b and x.b = y.a group by x.a) select cycle, count(*) as members from ring group by cycle")
def import_cycles(s, d):
    """Cycles of the dependencies between entities, by strongly connected components."""
    e = rels(s, d).where(F.col("type").isin("IMPORTS", "DEPENDS_ON", "CALLS") & F.col("src").isNotNull() & F.col("dst").isNotNull()).select("src", "dst").distinct()
    return hierarchy.find_cycles(e).groupBy("cycle").agg(F.count(F.lit(1)).alias("members"))


_RANKS = ", ".join(
    f"r{k} as (select n.id, 0.15::double / t.total + 0.85::double * (coalesce(i.got, 0) + l.lost / t.total) as rank from n cross join t cross join (select coalesce(sum(rank), 0) as lost from r{k - 1} where id not in (select src from o)) l left join (select g.dst, sum(r.rank / o.n) as got from g join r{k - 1} r on r.id = g.src join o on o.src = g.src group by g.dst) i on i.dst = n.id)"
    for k in range(1, 11)
)


@query(WITH + f", n as (select id from ent), t as (select count(*)::double as total from n), g as (select distinct src, dst from rel where src is not null and dst is not null), o as (select src, count(*) as n from g group by src), r0 as (select id, 1 / total as rank from n, t), {_RANKS} select id, round(rank, 9) as rank from r10")
def pagerank(s, d):
    return graph.pagerank(rels(s, d), ents(s, d)).select("id", F.round("rank", 9).alias("rank"))


@query(RECURSIVE + ", ways as (select src as a, dst as b from rel where src is not null and dst is not null and src <> dst union select dst, src from rel where src is not null and dst is not null and src <> dst), w(node, part) using key (node) as (select a, min(least(a, b)) from ways group by a union select b.b, min(w.part) from w join ways b on b.a = w.node join recurring.w r on r.node = b.b where w.part < r.part group by b.b), z as (select count(*) as k from w where node in (select id from ent) group by part) select (select count(*) from ent) as entities, (select coalesce(max(k), 0) from z) as largest, (select count(*) from ent) = 0 or (select coalesce(max(k), 0) from z) / (select count(*) from ent)::double > 0.8 as well_connected")
def connectedness(s, d):
    e = ents(s, d)
    comp = hierarchy.components(graph.cut(graph.adjacency(rels(s, d, "src", "dst"), True).where("src <> dst")))
    largest = comp.join(e.select(F.col("id").alias("node")), "node", "left_semi").groupBy("component").agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.max("k"), F.lit(0)).alias("largest"))
    return e.agg(F.count(F.lit(1)).alias("entities")).crossJoin(F.broadcast(largest)).select("entities", "largest", C.well_connected("entities", "largest").alias("well_connected"))


# context and texts


@query(
    WITH + HUB + f""", adj as (select src, dst, type from rel where src is not null and dst is not null and src <> dst union select dst, src, type from rel where src is not null and dst is not null and src <> dst),
    e1 as (select dst as id, type, 0.9 * ({_weights(K.HOP_WEIGHTS)})::double * 0.8 as score from adj where src in (select id from hub) and dst in (select id from ent) and dst not in (select id from hub)),
    h1 as (select id, score, type from e1 where score >= 0.3 qualify row_number() over (partition by id order by score desc, type nulls first) = 1),
    every as (select id, 1.0::double as score, 0 as hop, null as type from hub union all select id, score, 1, type from h1),
    top as (select *, row_number() over (order by score desc, id)::int as rank from every qualify rank <= 20)
    select top.id, rank, round(score, 6) as score, case when hop = 0 then 'semantic_similarity' when type = 'CALLS' then 'direct_dependency' when type = 'CONTAINS' then 'structural_relationship' else 'graph_traversal' end as reason from top join ent on ent.id = top.id"""
)
def context_results(s, d):
    """The best of a context as results: ranked, with the reason that hop and relationship stand for."""
    seeds = hub(s, d).select("id", F.lit(1.0).alias("score"))
    context = graph.hop_expansion(graph.relationships_near(table(s, d, "relationships")), ents(s, d).select("id", F.lit(0.9).alias("relevance")), seeds, hops=1)
    return retrieval.context_results(context, ents(s, d), 20).select("id", "rank", F.round("score", 6).alias("score"), "reason")


@query("with k as (select doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0b\\f\\r]+'), lambda w: length(w) > 3 and regexp_full_match(w, '[\\p{L}\\p{N}]+')) as w from documents) select doc_id, case when w is null then null else array_to_string(list_transform(list_slice(w, 1, 10), lambda x: lower(x)), ' ') end as keywords from k")
def keywords(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(C.keywords("text"), " ").alias("keywords"))


@query("with s as (select doc_id, text, " + ", ".join(f"({_task_score(p)}) as s{n}" for n, p in enumerate(K.TASK_PATTERNS.values())) + " from documents), m as (select *, greatest(" + ", ".join(f"s{n}" for n in range(len(K.TASK_PATTERNS))) + ") as best from s), t as (select doc_id, case when text is null then null when best = 0 then 'implement_feature' " + " ".join(f"when s{n} = best then '{t}'" for n, t in enumerate(K.TASK_PATTERNS)) + " end as task from m) select doc_id, case task " + " ".join("when '{}' then '{}'".format(k, "; ".join(v[:5]).replace("'", "''")) for k, v in K.ACTIONS.items()) + " else '' end as actions from t")
def recommended_actions(s, d):
    return graph_texts(s, d).select("doc_id", F.array_join(C.recommended_actions(C.task_type("text")), "; ").alias("actions"))


def graph_texts(s, d):
    from ..session import spread

    return spread(table(s, d, "documents").select("doc_id", "text"))


@query(
    WITH + ", st as (select id as file_id, unnest(regexp_split_to_array(content, '[\\r\\n]+')) as raw from ent where entity_type = 'FILE' and content is not null), t as (select distinct file_id, trim(raw) as st from st where starts_with(trim(raw), 'from ') or starts_with(trim(raw), 'import ')), "
    "frm as (select file_id, regexp_extract(st, '^from\\s+(\\S+)\\s+import', 1) as module, unnest(regexp_split_to_array(regexp_replace(regexp_extract(st, '\\simport\\s+(.*)$', 1), '[()]', '', 'g'), '\\s*,\\s*')) as sym from t where regexp_matches(st, '^from\\s+\\S+\\s+import\\s+')), "
    "fs as (select file_id, module, regexp_extract(trim(sym), '^(\\w+)', 1) as symbol from frm), pl as (select file_id, unnest(regexp_split_to_array(regexp_extract(st, '^import\\s+(.*)$', 1), '\\s*,\\s*')) as m from t where regexp_matches(st, '^import\\s+')), "
    "ps as (select file_id, regexp_extract(trim(m), '^([\\w.]+)', 1) as module from pl) "
    "select file_id, module, symbol, e.id as target_id, e.entity_type as target_type from fs join ent e on e.name = fs.symbol and e.entity_type in ('FUNCTION', 'CLASS') where symbol <> '' "
    "union all select file_id, module, null, e.id, 'FILE' from ps join ent e on e.entity_type = 'FILE' and regexp_replace(regexp_extract(e.file_path, '[^/]*$'), '\\.py$', '') = ps.module where module <> ''"
)
def import_resolution(s, d):
    """The import statements of files, resolved to functions, classes and files by name."""
    e = ents(s, d, "content")
    lines = e.where("entity_type = 'FILE' and content is not null").select(F.col("id").alias("file_id"), F.explode(F.split("content", r"[\r\n]+")).alias("statement")).withColumn("statement", F.trim("statement"))
    found = lines.where(F.col("statement").startswith("from ") | F.col("statement").startswith("import ")).distinct()
    return graph.resolve_imports(found, e)


# logs and files


@query("with s as (select user_id, ts, event_id, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 30 minute then 0 else 1 end as fresh from events), g as (select *, sum(fresh) over (partition by user_id order by ts, event_id rows unbounded preceding) as k from s) select user_id, min(ts) as session_start, max(ts) + interval 30 minute as session_end, count(*) as n from g group by user_id, k")
def user_sessions(s, d):
    return ev.session_counts(table(s, d, "events"))


@query("select event_id, any_value(event_type) as event_type from (select * from events union all select * from events where event_id % 3 = 0) group by event_id")
def events_once(s, d):
    """Each event once, of a log in which a third is delivered twice."""
    t = table(s, d, "events")
    return ev.once(t.unionByName(t.where("event_id % 3 = 0"))).select("event_id", "event_type")


@query(WITH + f", r as (select case when {_rules_sql()} then 'pattern' when {EXT} <> '' and {EXT} not in ({', '.join(repr(x) for x in K.SOURCE_EXTENSIONS)}) then 'not_source_extension' else 'include' end as reason from ent where entity_type = 'FILE') select reason, count(*) as files from r group by reason")
def path_filter_counts(s, d):
    return filter_stats(ents(s, d).where("entity_type = 'FILE'"), source_only())


# source of functions: by the syntax tree, which SQL does not have


@query()
def flow_analysis(s, d):
    """Of each Python function: control and data flow, calls, error handling and what is said of them, as JSON columns."""
    e = ents(s, d, "content").where((F.col("language") == "python") & F.col("entity_type").isin("FUNCTION", "METHOD", "CLASS"))
    return extract.flow_rows(e.select("id", "name", "content"))
