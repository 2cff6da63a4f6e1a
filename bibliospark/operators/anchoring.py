"""Linking of terms to concepts by vector similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibliospark.operators.vectors import knn

# Thresholds on the search-engine score (1 + cosine) / 2.
LINK_SCORE = 0.885
AMBIGUOUS_SCORE = 0.850


def anchor_tier_a(terms: DataFrame, concepts: DataFrame, dim: int, k: int = 3) -> DataFrame:
    """(id, status, concept_id, candidates) for unlinked terms(id, vec) against concepts(id, vec).

    LINKED carries the top concept, AMBIGUOUS its candidates as ``concept:score`` in rank order, NONE neither.
    """
    hits = knn(concepts, terms.select(F.col("id").alias("query_id"), "vec"), k, dim, in_place="queries")
    # The cosine is rounded already; half of it has seven digits, which are kept.
    scored = hits.withColumn("score", (1 + F.col("cosine")) / 2)
    listed = scored.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("_c"))
    top = F.get(F.col("_c"), F.lit(0))
    status = F.when(top["score"] >= LINK_SCORE, "LINKED").when(top["score"] >= AMBIGUOUS_SCORE, "AMBIGUOUS").otherwise("NONE")
    shown = F.array_join(F.transform("_c", lambda c: F.concat(c["id"].cast("string"), F.lit(":"), F.format_string("%.7f", c["score"]))), ",")
    rows = terms.select("id").join(listed, F.col("id") == F.col("query_id"), "left").withColumn("status", F.coalesce(status, F.lit("NONE")))
    return rows.select(
        "id", "status", F.when(F.col("status") == "LINKED", top["id"]).alias("concept_id"),
        F.when(F.col("status") == "AMBIGUOUS", shown).alias("candidates"))


def anchor_residue(anchored: DataFrame, new_concepts: DataFrame, terms: DataFrame, dim: int) -> DataFrame:
    """Terms left without a link, judged again against newly created concepts."""
    left = anchored.filter("status <> 'LINKED'").select("id")
    return anchor_tier_a(terms.join(left, "id", "left_semi"), new_concepts, dim)


def calibrate_thresholds(terms: DataFrame, concepts: DataFrame, dim: int, seed: str = "", samples: int | None = None) -> DataFrame:
    """Distribution of the top score over all terms, or over a seeded sample of them."""
    sample = terms if samples is None else terms.orderBy(F.md5(F.concat(F.lit(seed), F.col("id").cast("string"))), "id").limit(samples)
    top = knn(concepts, sample.select(F.col("id").alias("query_id"), "vec"), 1, dim, in_place="queries").select(((1 + F.col("cosine")) / 2).alias("s"))
    stats = {"mean": F.avg("s"), "median": F.median("s"), "min": F.min("s"), "max": F.max("s")}
    stats |= {f"p{p}": F.percentile("s", p / 100) for p in (25, 60, 75, 90)}
    return top.agg(*[F.round(v, 6).alias(k) for k, v in stats.items()])


def concept_terms(terms: DataFrame, concept_id: int) -> DataFrame:
    """Terms of a concept as rows (kind, n, name), n being the size of their type."""
    own = terms.filter(F.col("concept_id") == concept_id)
    return own.select("kind", "name").join(own.groupBy("kind").agg(F.count(F.lit(1)).alias("n")), "kind").select("kind", "n", "name")
