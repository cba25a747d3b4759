"""Term and document ranking: weighted zone score, KL-divergence query expansion,
TF-IDF overlap and cosine ranking of documents against queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiflow.functions.text import tokenize
from lexiflow.operators.impact import ImpactIndex
from lexiflow.session import materialise, small_side


def weighted_zone_score(z1, z2, weight: float):
    """``w·z1 + (1-w)·z2`` as a column expression."""
    z1 = F.col(z1) if isinstance(z1, str) else z1
    z2 = F.col(z2) if isinstance(z2, str) else z2
    return F.lit(weight) * z1 + F.lit(1.0 - weight) * z2


def subset_term_frequency(dtm: DataFrame, subset_ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``p_sub(term)`` over the documents of ``subset_ids``."""
    sub = dtm.join(subset_ids.select(id_col).distinct(), id_col, "left_semi")
    counts = materialise(sub.groupBy("term").agg(F.sum("cnt").alias("n")), "term-sums")  # for the total, and for the shares
    total = counts.agg(F.sum("n")).first()[0] or 0  # scalar
    return counts.select("term", (F.col("n") / F.lit(float(total) if total else None)).alias("p_sub"))


def kl_terms(dtm: DataFrame, relevant_ids: DataFrame, word_limit: int = 50, alpha: float = 1e-6,
             n_features: int | None = 5000, id_col: str = "doc_id") -> DataFrame:
    """KL-divergence query expansion (Carpineto et al. 2001).

    ``p_cor`` = corpus term frequency, ``p_sub`` = frequency in the pseudo-relevant
    documents (those that contain a query), ``p = α·p_sub + (1-α)·p_cor`` and
    ``score = p·log2(p / p_cor)``. Only the ``n_features`` most frequent corpus terms are
    scored. Returns the top ``word_limit`` ``(term, score)`` by score.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha has to be within 0 and 1")
    marked = dtm.join(relevant_ids.select(id_col).distinct().withColumn("_in", F.lit(1)), id_col, "left")
    # both frequencies of a term from one pass over the matrix, written once for totals and scores
    counts = materialise(marked.groupBy("term").agg(
        F.sum("cnt").alias("n_cor"), F.sum(F.when(F.col("_in") == 1, F.col("cnt")).otherwise(0)).alias("n_sub")), "term-sums")
    total, total_sub = counts.agg(F.sum("n_cor"), F.sum("n_sub")).first()
    cor = counts
    if n_features:
        cor = cor.orderBy(F.desc("n_cor"), F.asc("term")).limit(n_features)
    j = cor.select("term", (F.col("n_cor") / F.lit(float(total or 0))).alias("p_cor"),
                   F.coalesce(F.col("n_sub") / F.lit(float(total_sub) if total_sub else None), F.lit(0.0)).alias("p_sub"))
    p = weighted_zone_score("p_sub", "p_cor", alpha)
    scored = j.select("term", (p * F.log2(p / F.col("p_cor"))).alias("score"))
    return scored.orderBy(F.desc("score"), F.asc("term")).limit(word_limit)


def rank_tfidf_overlap(weights: DataFrame, docs_tokens: DataFrame, query_terms: DataFrame,
                       id_col: str = "doc_id") -> DataFrame:
    """Overlap score: Σ tf-idf weight of the query terms in a document / document length
    (tokens). ``docs_tokens`` holds ``(id, n_tokens)``."""
    s = (weights.join(small_side(query_terms.select("term").distinct(), "query-terms"), "term", "left_semi")
         .groupBy(id_col).agg(F.sum("weight").alias("overlap")))
    return (s.join(docs_tokens, id_col)
            .select(id_col, (F.col("overlap") / F.col("n_tokens")).alias("score")))


def rank_cosine(doc_weights: DataFrame, query_weights: DataFrame, id_col: str = "doc_id",
                word_limit: int = 50, normalised: bool = False) -> DataFrame:
    """The ``word_limit`` documents closest to each query by cosine similarity (ties by id).

    Inputs ``(id, term, weight)`` and ``(query, term, weight)``, no weight negative; document
    vectors are taken as of length one only with ``normalised``. Scores are ranked with nine
    decimals. Documents that cannot get among the best of a query are never paired with it
    (:class:`ImpactIndex`)."""
    return ImpactIndex(doc_weights, id_col, normalised=normalised).best(query_weights, word_limit)


def query_term_weights(queries: DataFrame, idf: DataFrame) -> DataFrame:
    """Query vectors: term count in the query × idf; ``(query, term, weight)``."""
    qt = (queries.select("query", F.explode(tokenize(F.col("query"))).alias("term"))
          .groupBy("query", "term").agg(F.count(F.lit(1)).alias("cnt")))
    return qt.join(idf, "term").select("query", "term", (F.col("cnt") * F.col("idf")).alias("weight"))


def top_per_group(df: DataFrame, group: str, order_cols, k: int) -> DataFrame:
    """First ``k`` rows per group by ``order_cols`` (window partitioned by the group)."""
    w = Window.partitionBy(group).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k).drop("_rn")
