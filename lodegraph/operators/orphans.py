"""References to records that are unknown, already deleted or not yet created, and what hangs below them.

Foreign keys of the graph: relationships.source_entity_id and .target_entity_id, and code_entities.parent_entity_id, all to
code_entities.id. A reference is *direct*ly orphaned if, at its record's created_at, the record referred to was not there: no
row with that id was created at or before it, or a tombstone of that id is dated at or before it. An entity with an orphaned
parent reference is an orphaned record; references to it are *inherited* orphans, and so on down to a fixpoint.

Null or blank references are no references. A record without created_at has no time at which its reference could be there,
so the reference is an orphan. Rows of the referred table without created_at never vouch for an id. Repeated deliveries of a
record count once. Empty tables give empty results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from ..tables import norm_id
from .skew import hot_list, lookup_join


def presence(entities: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(ref, first_created, first_deleted, known): since when an id is there, since when it is deleted, and whether any row,
    with a date or without, has it."""
    made = entities.select(norm_id("id").alias("ref"), F.col("created_at").alias("made"), F.lit(None).cast("timestamp").alias("gone"), F.lit(True).alias("known"))
    gone = tombstones.select(norm_id("entity_id").alias("ref"), F.lit(None).cast("timestamp").alias("made"), F.col("deleted_at").alias("gone"), F.lit(False).alias("known"))
    return made.unionByName(gone).where("ref is not null").groupBy("ref").agg(F.min("made").alias("first_created"), F.min("gone").alias("first_deleted"), F.max("known").alias("known"))


def references(entities: DataFrame, relationships: DataFrame) -> DataFrame:
    """(table, record_id, endpoint, ref, at): one row for each reference that is not blank."""
    rel = relationships.select(
        F.lit("relationships").alias("table"),
        norm_id("id").alias("record_id"),
        F.explode(F.array(F.struct(F.lit("source").alias("endpoint"), norm_id("source_entity_id").alias("ref")), F.struct(F.lit("target").alias("endpoint"), norm_id("target_entity_id").alias("ref")))).alias("x"),
        F.col("created_at").alias("at"),
    ).select("table", "record_id", "x.endpoint", "x.ref", "at")
    ent = entities.select(F.lit("code_entities").alias("table"), norm_id("id").alias("record_id"), F.lit("parent").alias("endpoint"), norm_id("parent_entity_id").alias("ref"), F.col("created_at").alias("at"))
    return rel.unionByName(ent).where("ref is not null")


def find_orphans(entities: DataFrame, relationships: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(table, record_id, endpoint, ref, at, kind, reason, depth), one row per orphaned reference.

    kind: direct or inherited. reason of direct ones: unknown, not yet created, deleted. depth: 0 for direct ones, else the
    number of orphaned records between. The cascade runs level by level: a semi-join of the parent references with the ids
    orphaned in the last level, less those orphaned before; each level is written to the shared folder."""
    there = presence(entities, tombstones)
    every = references(entities, relationships)
    hot = hot_list(every, "ref")  # what is not hot among all references is not hot among some of them
    refs = lookup_join(every, there, "ref", hot=hot)
    missing = F.col("first_created").isNull() | F.col("at").isNull() | (F.col("first_created") > F.col("at"))
    state = cut(
        refs.withColumn(
            "reason",
            F.when(~F.coalesce("known", F.lit(False)), "unknown").when(missing, "not yet created").when(F.col("first_deleted") <= F.col("at"), "deleted"),
        )
        .groupBy("table", "record_id", "endpoint", "ref")
        .agg(F.max("at").alias("at"), F.max("reason").alias("reason"))
    )
    direct = state.where("reason is not null").select("*", F.lit("direct").alias("kind"), F.lit(0).alias("depth"))
    up = state.where("table = 'code_entities' and reason is null").select("record_id", "ref")

    seen = cut(direct.where("table = 'code_entities'").select(F.col("record_id").alias("ref"), F.lit(1).alias("depth")).distinct())
    frontier, depth = seen, 1
    while not frontier.isEmpty():
        depth += 1
        frontier = cut(lookup_join(up, frontier.select("ref"), "ref", "left_semi", hot).select(F.col("record_id").alias("ref")).distinct().join(seen, "ref", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    inherited = lookup_join(state.where("reason is null"), seen.groupBy("ref").agg(F.min("depth").alias("depth")), "ref", "inner", hot).withColumn("kind", F.lit("inherited"))
    columns = ["table", "record_id", "endpoint", "ref", "at", "kind", "reason", "depth"]
    return direct.select(columns).unionByName(inherited.select(columns))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """(table, endpoint, month, direct, inherited): numbers of orphaned references; month is null where the time is."""
    return orphans.groupBy("table", "endpoint", F.date_format(F.date_trunc("month", "at"), "yyyy-MM").alias("month")).agg(F.count_if(F.col("kind") == "direct").alias("direct"), F.count_if(F.col("kind") == "inherited").alias("inherited"))
