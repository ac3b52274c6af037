"""Queries of the core operators on the driver's tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, orphans
from ..tables import table


def p2_orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.find_orphans(table(spark, d, "code_entities"), table(spark, d, "relationships"), table(spark, d, "deleted_entities"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_orphans(spark, d).where("table = 'relationships' and kind = 'direct'").select(F.col("record_id").alias("relationship_id"), "endpoint")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p2_orphans(spark, d))


def p7_cycles(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.find_cycles(hierarchy.contains_edges(table(spark, d, "relationships")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_cycles(spark, d).select(F.col("node").alias("entity_id"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    edges = hierarchy.contains_edges(table(spark, d, "relationships"))
    return hierarchy.hierarchy_paths(edges, hierarchy.find_cycles(edges))


def p7_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).withColumn("path", F.array_join("path", ">"))


def p7_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_paths(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_orphans, p2_report, p7_found, p7_cycles, p7_hierarchy, p7_descendants)}


_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)"


def oracle_sql() -> dict[str, str]:
    nid = lambda c: f"nullif(lower(trim({c}, {_BLANKS})), '')"
    trees = f"""
            with recursive e as (select distinct {nid('source_entity_id')} as s, {nid('target_entity_id')} as t from relationships
                                 where upper(trim(relationship_type, {_BLANKS})) = 'CONTAINS'),
                 g as (select s, t from e where s is not null and t is not null),
                 w as (select s as a, t as b from g where s in (select t from g) and t in (select s from g)
                       union select w.a, g.t from w join g on g.s = w.b where g.t in (select s from g)),
                 cyc as (select x.a as node, min(x.b) as cycle from w x join w y on x.a = y.b and x.b = y.a group by x.a),
                 dag as (select s, t from g left join cyc c1 on c1.node = s left join cyc c2 on c2.node = t where c1.cycle is null or c2.cycle is null or c1.cycle <> c2.cycle),
                 nodes as (select s as node from g union select t from g),
                 paths as (select node, node as root, 0 as depth, node as path from nodes where node not in (select t from dag)
                           union all select dag.t, root, depth + 1, path || '>' || dag.t from paths join dag on dag.s = paths.node)"""
    orphans_ = f"""
            with recursive made as (select {nid('id')} as ref, created_at as made, null::timestamp as gone, true as known from code_entities
                          union all select {nid('entity_id')}, null, deleted_at, false from deleted_entities),
                 there as (select ref, min(made) as first_created, min(gone) as first_deleted, bool_or(known) as known from made where ref is not null group by ref),
                 refs as (select 'relationships' as "table", {nid('id')} as record_id, 'source' as endpoint, {nid('source_entity_id')} as ref, created_at as "at" from relationships
                          union all select 'relationships', {nid('id')}, 'target', {nid('target_entity_id')}, created_at from relationships
                          union all select 'code_entities', {nid('id')}, 'parent', {nid('parent_entity_id')}, created_at from code_entities),
                 state as (select "table", record_id, endpoint, refs.ref, max("at") as "at", max(case when not coalesce(known, false) then 'unknown'
                               when first_created is null or "at" is null or first_created > "at" then 'not yet created' when first_deleted <= "at" then 'deleted' end) as reason
                           from refs left join there on there.ref = refs.ref where refs.ref is not null group by "table", record_id, endpoint, refs.ref),
                 up as (select record_id, ref from state where "table" = 'code_entities' and reason is null),
                 seen(ref, depth) using key (ref) as (select distinct record_id, 1 from state where "table" = 'code_entities' and reason is not null
                           union select distinct up.record_id, seen.depth + 1 from seen join up on up.ref = seen.ref where up.record_id not in (select ref from recurring.seen)),
                 orphans as (select *, 'direct' as kind, 0 as depth from state where reason is not null
                             union all select state.*, 'inherited', seen.depth from state join seen on seen.ref = state.ref where reason is null)"""
    return {
        "p7_hierarchy": trees + " select node, root, depth, path from paths",
        "p7_descendants": trees + """, up as (select node, depth, unnest(string_split(path, '>')) as ancestor, unnest(range(0, depth + 1)) as place from paths)
            select ancestor, node as descendant, min(depth - place)::int as distance from up where ancestor <> node group by ancestor, node""",
        "p2_orphans": orphans_ + ' select "table", record_id, endpoint, ref, "at", kind, reason, depth from orphans',
        "p2_report": orphans_ + """ select "table", endpoint, strftime("at", '%Y-%m') as month, count(*) filter (where kind = 'direct') as direct, count(*) filter (where kind = 'inherited') as inherited from orphans group by all""",
        "p2_found": f"""
            with e as (select {nid('id')} as id, min(created_at) as made from code_entities group by 1),
                 t as (select {nid('entity_id')} as id, min(deleted_at) as gone from deleted_entities group by 1),
                 r as (select {nid('id')} as relationship_id, 'source' as endpoint, {nid('source_entity_id')} as ref, created_at from relationships
                       union all select {nid('id')}, 'target', {nid('target_entity_id')}, created_at from relationships)
            select distinct relationship_id, endpoint from r left join e on e.id = ref left join t on t.id = ref
            where ref is not null and (made is null or created_at is null or made > created_at or gone <= created_at)""",
        "p7_found": f"""
            with recursive e as (select distinct {nid('source_entity_id')} as s, {nid('target_entity_id')} as t from relationships
                                 where upper(trim(relationship_type, {_BLANKS})) = 'CONTAINS'),
                 g as (select s, t from e where s is not null and t is not null),
                 w as (select s as start, t as node from g where s in (select t from g) and t in (select s from g)
                       union select w.start, g.t from w join g on g.s = w.node where g.t in (select s from g))
            select distinct start as entity_id from w where start = node""",
    }
