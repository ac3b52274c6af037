"""The queries of this package; SQL where SQL can express the operator on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import table
from . import docs, handwritten, mixing, neighbours, parsing, pieces, spans, tokens


BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)"


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces.split_entities(table(spark, d, "code_entities")).withColumnRenamed("item", "entity_id")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pieces(spark, d).select("entity_id").distinct()


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return docs.documented_functions(table(spark, d, "code_entities"), texts=False).select("entity_id")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docs.documented_functions(table(spark, d, "code_entities"))


#: The distance of unit vectors at a cosine of 0.90, and a little for rounding.
RADIUS = (2 - 2 * 0.90) ** 0.5 + 1e-5


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    vectors = neighbours.cut(neighbours.usable_vectors(table(spark, d, "code_entities")))
    found = neighbours.nearest(vectors, 10, radius=RADIUS)
    return neighbours.mutual_pairs(found, 0.90).select(F.col("a").alias("entity_id_a"), F.col("b").alias("entity_id_b"))


def p4_knn(spark: SparkSession, d: str) -> DataFrame:
    vectors = neighbours.cut(neighbours.usable_vectors(table(spark, d, "code_entities")))
    asked = vectors.where(neighbours.divisible_by("id", 20))
    found = neighbours.nearest(vectors, 10, queries=asked, factor=0.7)
    return found.select(F.col("q").alias("entity_id"), F.col("x").alias("neighbour_id"), "rank", F.round("cosine", 6).alias("cosine"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.unparsable(table(spark, d, "code_entities")).select("repository_id", "file_path").distinct()


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse_rates(parsing.check_files(table(spark, d, "code_entities")))


def p5_stages(spark: SparkSession, d: str) -> DataFrame:
    return parsing.parse_stages(parsing.check_files(table(spark, d, "code_entities")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "code_entities")).select("entity_id")


def p6_kinds(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "code_entities"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_corpus(table(spark, d, "documents"), ["doc_id"])


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return tokens.round_trips(table(spark, d, "documents"), ["doc_id"])


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_sources(table(spark, d, "documents"), table(spark, d, "source_weights"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_shares(p9_mix(spark, d), table(spark, d, "documents"), table(spark, d, "source_weights"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents")).select("doc_id").distinct()


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p3_found, p3_pairs, p4_found, p4_knn, p5_found, p5_rates, p5_stages, p6_found, p6_kinds, p8_ids, p8_roundtrip, p9_mix, p9_shares, p10_found, p10_shared)}


def oracle_sql() -> dict[str, str]:
    nid = f"nullif(lower(trim(id, {BLANKS_SQL})), '')"
    return {
        "p1_found": f"select distinct {nid} as entity_id from code_entities where length(content) > 2048 and {nid} is not null",
        "p8_roundtrip": "select doc_id, true as same from documents",
        # by brute force: every pair of usable vectors
        "p4_found": f"""
            with u as (select {nid} as id, embedding_vector::double[] as v, updated_at from code_entities where len(embedding_vector) = {neighbours.DIM} and {nid} is not null
                         and len(list_filter(embedding_vector, lambda x: x is not null and isfinite(x))) = {neighbours.DIM} and len(list_filter(embedding_vector, lambda x: x <> 0)) > 0),
                 e as (select id, v::double[{neighbours.DIM}] as v from u qualify row_number() over (partition by id order by updated_at desc nulls last, v desc) = 1),
                 c as (select a.id as q, b.id as x, array_cosine_similarity(a.v, b.v) as cosine from e a join e b on a.id <> b.id),
                 n as (select q, x from c where cosine >= 0.90 qualify row_number() over (partition by q order by cosine desc, x) <= 10)
            select n.q as entity_id_a, n.x as entity_id_b from n join n m on m.q = n.x and m.x = n.q where n.q < n.x""",
    }
