"""Retrieval: candidates by vector, thresholds, re-ranking, diversification, task adaptation and result rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K


def score_against(vectors: DataFrame, query: list[float], vector: str = "embedding", score: str = "cosine") -> DataFrame:
    """Adds ``score``: the similarity of each row's vector to one query, by matrix products on Arrow batches. score: cosine,
    normalized ((1 + cosine) / 2) or distance (of the squared Euclidean distance). Null where there is no usable vector."""
    q = np.array(query, np.float64)

    @F.pandas_udf("double")
    def sim(v: pd.Series) -> pd.Series:
        ok = v.map(lambda x: x is not None and len(x) == len(q))
        out = np.full(len(v), np.nan)
        if ok.any():
            x = np.stack(v[ok].to_numpy()).astype(np.float64)
            if score == "distance":
                out[ok.to_numpy()] = ((x - q) ** 2).sum(1)
            else:
                norms = np.linalg.norm(x, axis=1) * np.linalg.norm(q)
                out[ok.to_numpy()] = np.divide(x @ q, norms, out=np.zeros(len(x)), where=norms > 0)
        return pd.Series(out)

    raw = F.nanvl(sim(vector), F.lit(None).cast("double"))
    value = C.distance_score(raw) if score == "distance" else C.normalized_score(raw) if score == "normalized" else raw
    return vectors.withColumn("score", value)


def matching(df: DataFrame, repository: str | None = None, types: list[str] | None = None, languages: list[str] | None = None, path: str | None = None) -> DataFrame:
    """The rows a request allows; applied before any ranking, so the conditions reach the scan. path is a glob."""
    from ..sources.filters import glob_regex

    if repository is not None:
        df = df.where(F.col("repository_id") == repository)
    if types:
        df = df.where(F.col("entity_type").isin(types))
    if languages:
        df = df.where(F.col("language").isin(languages))
    return df.where(F.col("file_path").rlike(glob_regex(path))) if path else df


def top_k(scored: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The k best rows by score; ties by key."""
    return scored.where("score is not null").orderBy(F.desc("score"), key).limit(k)


def ranked(scored: DataFrame, k: int, key: str = "id", threshold: float | None = None) -> DataFrame:
    """The k best rows with their rank from 1. The window has at most k rows."""
    some = scored if threshold is None else scored.where(F.col("score") >= threshold)
    return top_k(some, k, key).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key)))


def hybrid(scored: DataFrame, text: str, kind: str = "entity_type") -> DataFrame:
    return scored.withColumn("score", F.least(F.lit(1.0), F.col("score") + C.type_bonus(kind, text)))


def diversify(scored: DataFrame, k: int, group: str = "file_path", key: str = "id") -> DataFrame:
    """The k best rows of which, past the first half, no more than a fifth of k come from one group; rank counts anew.

    Equivalent to accepting rows greedily in order of score. Of each group only the first k/5 rows and of all rows only the
    first k/2 can be accepted, so only those are kept before they are brought together."""
    half, fifth = k // 2, max(1, k // 5)
    base = scored.where("score is not null")
    own = base.withColumn("_g", F.row_number().over(W.partitionBy(group).orderBy(F.desc("score"), key))).where(F.col("_g") <= fifth).drop("_g").orderBy(F.desc("score"), key).limit(k + half)
    first = top_k(base, half, key)
    both = own.withColumn("_own", F.lit(True)).unionByName(first.withColumn("_own", F.lit(False)))
    one = both.dropDuplicates([key])
    return one.drop("_own").withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), key))).where(F.col("rank") <= k)


def adapt_to_task(results: DataFrame, task: str, kind: str = "entity_type", key: str = "id") -> DataFrame:
    """Results for a task: those under its threshold dropped, its types raised by 0.2, and the best as two tiers: the first
    half of its number primary, the rest supporting."""
    types, _, most, threshold = K.TASK_SETTINGS.get(task, K.TASK_SETTINGS[K.DEFAULT_TASK])
    kept = results.where(F.col("score") >= threshold).withColumn("score", F.when(F.col(kind).isin(types), F.least(F.lit(1.0), F.col("score") + 0.2)).otherwise(F.col("score")))
    out = top_k(kept, most, key).withColumn("task_rank", F.row_number().over(W.orderBy(F.desc("score"), key)))
    return out.withColumn("tier", F.when(F.col("task_rank") <= most // 2, "primary").otherwise("supporting"))


def overall_confidence(results: DataFrame) -> DataFrame:
    """One row: scores weighted by 1/rank, rounded to three places; 0 without results."""
    return results.agg(F.round(F.coalesce(F.sum(F.col("score") / F.col("rank")) / F.sum(F.lit(1.0) / F.col("rank")), F.lit(0.0)), 3).alias("confidence"))


def quality(results: DataFrame, most: int) -> DataFrame:
    """One row: mean score, and how many scores over 0.7 there are for the ten (or most) wanted."""
    return results.agg(F.round(F.avg("score"), 6).alias("relevance"), F.least(F.lit(1.0), F.count_if(F.col("score") > 0.7) / float(min(10, most))).alias("coverage"))


def result_rows(results: DataFrame, types: list[str], languages: list[str], reason: Column | str = "semantic_similarity") -> DataFrame:
    """Results as rows to show: score to three places, location, number of lines and why."""
    why = F.lit(reason) if isinstance(reason, str) else reason
    return results.select(
        "id", "name", "entity_type", "file_path", "language", F.round("score", 3).alias("confidence_score"), C.line_count("start_line", "end_line").alias("line_count"),
        C.location("file_path", "start_line", "end_line").alias("location"), C.explanation(why, "score", "entity_type", types, "language", languages).alias("explanation"), "rank",
    )


def insights(results: DataFrame, most: int) -> DataFrame:
    """One row: numbers by type, language and file, the range of scores, and suggestions."""
    maps = [F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("k"), F.col("n"))))).alias("m")]
    count = lambda c: results.groupBy(F.coalesce(F.col(c), F.lit("unknown")).alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(*maps).select(F.col("m").alias(f"{c}_counts"))
    stats = results.agg(F.count(F.lit(1)).alias("results"), F.min("score").alias("least"), F.max("score").alias("greatest"), F.avg("score").alias("mean"), F.countDistinct("file_path").alias("files"))
    few = F.when(F.col("results") < most // 2, "Consider lowering the confidence threshold for more results")
    near = F.when(F.col("files") < 3, "Results are concentrated in few files - consider broader search")
    out = stats.withColumn("suggestions", F.filter(F.array(few, near), lambda x: x.isNotNull()))
    for c in ("entity_type", "language", "file_path"):
        out = out.crossJoin(count(c))
    return out


def context_summary(results: DataFrame, task: str) -> DataFrame:
    """One row with a sentence about the results."""
    kinds = results.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("r")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "n", "entity_type"))), lambda x: F.concat(x["n"].cast("string"), F.lit(" "), x["entity_type"], F.when(x["n"] > 1, "s").otherwise(""))), ", ").alias("kinds"))
    n = results.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file_path").alias("files"))
    text = F.concat(F.lit("Found "), F.col("n").cast("string"), F.lit(f" relevant entities for {task} task. Spanning "), F.col("files").cast("string"), F.lit(" files. Including: "), F.col("kinds"), F.lit("."))
    return n.crossJoin(kinds).select(F.when(F.col("n") > 0, text).otherwise("No relevant context found.").alias("summary"))


def context_snippets(context: DataFrame, ents: DataFrame, rels: DataFrame) -> DataFrame:
    """(id, snippet): what to show of each entity of a multi-hop context (id, hop, via, type): its signature, how it was found,
    and up to three names it is related to within the context."""
    names = ents.join(context.select("id"), "id", "left_semi").select("id", "name", "signature")
    inner = rels.select(F.col("src").alias("id"), F.col("dst").alias("other")).distinct().join(context.select("id"), "id", "left_semi").join(names.select(F.col("id").alias("other"), F.col("name").alias("other_name")), "other")
    # three names an entity: the least by id, kept while aggregating
    ranked_ = inner.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy("other"))).where("n <= 3").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "other_name"))), lambda x: x["other_name"]), ", ").alias("related"))
    part = lambda label, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{label}: "), c))
    return context.join(names, "id").join(ranked_, "id", "left").select("id", F.concat_ws(" | ", part("Signature", F.col("signature")), F.when(F.col("hop") > 0, part("Found via", F.col("type"))), part("Related", F.col("related"))).alias("snippet"))


#: What a hop and a relationship type stand for as a reason; all others are graph_traversal. Fixed values.
REASONS = {(0, None): "semantic_similarity", (1, "CALLS"): "direct_dependency", (1, "CONTAINS"): "structural_relationship", (2, "CALLS"): "indirect_dependency", (2, "CONTAINS"): "structural_relationship", (3, "CALLS"): "indirect_dependency"}


def context_results(context: DataFrame, ents: DataFrame, n: int = 20) -> DataFrame:
    """The n best of a multi-hop context (id, hop, score, type) that are entities, as results: rank and reason with what is
    known of each."""
    reason = F.lit("graph_traversal")
    for (hop, kind), name in REASONS.items():
        same = F.col("hop") == hop
        reason = F.when(same if kind is None else same & (F.col("type") == kind), name).otherwise(reason)
    best = top_k(context, n).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "id"))).withColumn("reason", reason)
    return F.broadcast(best).join(ents, "id")


def context_graph_summary(context: DataFrame, ents: DataFrame) -> DataFrame:
    """One row: nodes by type, hop and relationship type, nodes with a score over 0.7, and files covered."""
    rows = context.join(ents.select("id", "entity_type", "file_path"), "id")
    count = lambda c, name: rows.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))
    total = rows.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("score") > 0.7).alias("relevant"), F.countDistinct("file_path").alias("files"))
    return total.crossJoin(count("entity_type", "by_type")).crossJoin(count("hop", "by_hop")).crossJoin(count("type", "by_relationship"))


def task_metadata(results: DataFrame, analyses: DataFrame) -> DataFrame:
    """One row about results (id, name): number by type, names of complex functions, side effects by bucket, and dependencies.
    analyses: (id, cyclomatic_complexity, side_effects, dependencies) as extraction gives them."""
    rows = results.join(analyses, "id", "left")
    effects = rows.select("name", F.explode("side_effects").alias("effect")).groupBy(C.side_effect_bucket("effect").alias("k")).agg(F.array_sort(F.collect_set(F.concat("name", F.lit(": "), "effect"))).alias("v")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("side_effects"))
    depends = rows.select(F.explode("dependencies").alias("d")).agg(F.countDistinct("d").alias("total_unique_dependencies"))
    named = lambda cond, name: rows.agg(F.array_sort(F.collect_set(F.when(cond, F.col("name")))).alias(name))
    kinds = results.groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("entity_type", "n")))).alias("entity_distribution"))
    return kinds.crossJoin(named(F.col("cyclomatic_complexity") > 10, "complex_entities")).crossJoin(named(F.size("dependencies") > 5, "high_dependency_entities")).crossJoin(effects).crossJoin(depends)
