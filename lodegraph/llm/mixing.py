"""Mixing sources to target weights by systematic sampling.

Each source gets an expected number of copies of its documents, the same for all of them: its share of the mixture's tokens
over the tokens it has, at most max_repeats. Its documents are put in order of size (ties by a hash), the expected copies are
summed up in that order, one random offset is added, and a document is emitted once for each integer the sum crosses on it. So a
document comes floor or ceil of its expectation times, and sizes are drawn evenly.

Without total_tokens the mixture is the largest whose shares are exact for all sources that have documents. With it, sources
that cannot fill their share at max_repeats are used up and the rest is divided by weight among the others.

Documents without a source, or of a source without a (positive) weight or repeats, are not drawn; null and empty texts count no
tokens but are drawn like others. Sources with a weight but no tokens are reported with share 0. Repeated source rows: the one
with the largest weight counts. Equal doc_ids are treated as different documents."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .tokens import DEFAULT_TOKENIZER, count_tokens

#: Sources are few (a table of weights written by hand); more than this is refused.
MAX_SOURCES = 100_000


def allot(tokens: dict[str, int], weights: dict[str, tuple[float, int]], total_tokens: float | None = None) -> dict[str, float]:
    """Expected copies by source: shares by weight, none above its repeats, what one cannot take going to the others."""
    live = {s: w for s, w in weights.items() if tokens.get(s, 0) > 0 and w[0] > 0 and w[1] > 0}
    if not live:
        return {}
    caps = {s: tokens[s] * live[s][1] for s in live}
    if total_tokens is None:
        scale = min(caps[s] / live[s][0] for s in live)
        return {s: min(live[s][1], scale * live[s][0] / tokens[s]) for s in live}
    out, rest, open_ = {}, float(total_tokens), dict(live)
    while open_:
        scale = rest / sum(w for w, _ in open_.values())
        full = [s for s in open_ if caps[s] <= scale * open_[s][0]]
        if not full:
            return out | {s: scale * open_[s][0] / tokens[s] for s in open_}
        for s in full:
            out[s] = float(live[s][1])
            rest -= caps[s]
            del open_[s]
    return out


def mix_sources(docs: DataFrame, weights: DataFrame, total_tokens: float | None = None, seed: int = 42, tokenizer: str = DEFAULT_TOKENIZER, bucket_rows: int = 100_000) -> DataFrame:
    """(doc_id, source, n_tokens, copies) of the documents drawn, copies >= 1.

    The running sums need no window over a whole source: documents are counted by (source, size, hash bucket) before the
    shuffle, the counts are summed up by source, and only within a bucket of about bucket_rows documents are rows numbered."""
    spark = docs.sparkSession
    plan = {r["source"]: (r["w"], r["m"]) for r in weights.where("source is not null").groupBy("source").agg(F.max(F.struct(F.col("target_weight").alias("w"), F.col("max_repeats").alias("m"))).alias("x")).select("source", F.coalesce("x.w", F.lit(0.0)).alias("w"), F.coalesce("x.m", F.lit(0)).alias("m")).limit(MAX_SOURCES + 1).collect()}
    if len(plan) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} weighted sources")
    names = [s for s, (w, m) in plan.items() if w > 0 and m > 0]
    sized = cut(count_tokens(docs.where(F.col("source").isin(names)), ["doc_id", "source"], tokenizer=tokenizer))
    sums = {r["source"]: (int(r["t"]), r["n"]) for r in sized.groupBy("source").agg(F.sum(F.col("n_tokens").cast("long")).alias("t"), F.count(F.lit(1)).alias("n")).collect()}
    copies = allot({s: t for s, (t, _) in sums.items()}, plan, total_tokens)
    if not copies:
        return sized.where("false").select("doc_id", "source", "n_tokens", F.lit(0).cast("long").alias("copies"))
    rnd = random.Random(seed)
    settings = spark.createDataFrame([(s, float(copies[s]), rnd.random()) for s in sorted(copies)], "source string, each double, shift double")
    buckets = max(1, -(-max(n for _, n in sums.values()) // bucket_rows))
    key = ["source", "n_tokens", "bucket"]
    placed = sized.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    from pyspark.sql import Window as W

    counts = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    # two levels again: a source's sizes are summed up first, then the buckets of one size
    by_size = counts.groupBy("source", "n_tokens").agg(F.sum("n").alias("of_size")).withColumn("below", F.sum("of_size").over(W.partitionBy("source").orderBy("n_tokens").rowsBetween(W.unboundedPreceding, -1))).select("source", "n_tokens", F.coalesce("below", F.lit(0)).alias("below"))
    starts = counts.withColumn("in_size", F.coalesce(F.sum("n").over(W.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).join(by_size, ["source", "n_tokens"]).select(*key, (F.col("below") + F.col("in_size")).alias("start"))
    ranked = placed.withColumn("i", F.row_number().over(W.partitionBy(*key).orderBy("h", "doc_id"))).join(starts, key).join(F.broadcast(settings), "source")
    upto = lambda i: F.floor(i * F.col("each") + F.col("shift") + F.lit(1e-9))
    rank = F.col("start") + F.col("i")
    return ranked.withColumn("copies", upto(rank) - upto(rank - 1)).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def mix_shares(mixture: DataFrame, docs: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, target_weight, max_repeats, documents, drawn_documents, drawn_tokens, share): what was reached, for each
    weighted source; target_weight is as given, share is of the mixture's tokens."""
    w = weights.where("source is not null").groupBy("source").agg(F.max(F.struct("target_weight", "max_repeats")).alias("x")).select("source", "x.target_weight", "x.max_repeats")
    have = docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    got = mixture.groupBy("source").agg(F.sum("copies").alias("drawn_documents"), F.sum(F.col("copies") * F.col("n_tokens")).alias("drawn_tokens"))
    total = got.agg(F.sum("drawn_tokens").alias("all_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return (
        w.join(have, "source", "left")
        .join(got, "source", "left")
        .crossJoin(F.broadcast(total))
        .select("source", "target_weight", "max_repeats", zero("documents"), zero("drawn_documents"), zero("drawn_tokens"), F.round(F.coalesce(F.col("drawn_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("share"))
    )
