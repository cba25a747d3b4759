"""Document-term tables in long (sparse) form ``(doc_id, term, cnt)`` and the statistics
computed over them (document counts, term frequencies, idf, tf-idf)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiflow.functions.text import ngrams, tokenize
from lexiflow.session import materialise, small_side

#: Terms in more than this share of the documents are few (mean terms of a document / FREQUENT at most).
FREQUENT = 0.25


def term_counts(docs: DataFrame, n: int = 2, id_col: str = "doc_id",
                text_col: str = "text_clean") -> DataFrame:
    """``(id, term, cnt)`` for whitespace tokens of lower-cased text; ``n`` = n-gram size
    (the reference's matrix uses bigrams)."""
    toks = tokenize(F.lower(F.col(text_col)))
    terms = toks if n == 1 else ngrams(toks, n)
    # no shuffle if the documents are dealt out by id
    return (docs.select(id_col, F.explode(terms).alias("term")).where(F.col("term").isNotNull())
            .groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("cnt")))


def _threshold(value, n_docs: int) -> float:
    return float(value) if isinstance(value, int) and not isinstance(value, bool) \
        else float(value) * n_docs


def _kept_terms(tc: DataFrame, n_docs: int, min_df, max_df) -> DataFrame:
    """``(term, df)`` for terms with ``min_df <= df <= max_df``."""
    lo, hi = _threshold(min_df, n_docs), _threshold(max_df, n_docs)
    df = tc.groupBy("term").agg(F.count_if(F.col("cnt") > 0).alias("df"))
    return df.where((F.col("df") >= lo) & (F.col("df") <= hi))


def doc_term_matrix(docs: DataFrame, min_df=1, max_df=0.9, vocabulary: DataFrame | None = None,
                    n: int = 2, id_col: str = "doc_id", text_col: str = "text_clean",
                    counts: DataFrame | None = None) -> DataFrame:
    """Sparse document-term matrix with document-frequency limits.

    Integer limits are absolute document counts, floats are shares of the number of
    documents; terms kept satisfy ``min_df <= df <= max_df``. With a ``vocabulary``
    (DataFrame with column ``term``) the limits are ignored and only its terms are kept.
    ``counts`` (the :func:`term_counts` of the documents) avoids counting them again.
    """
    tc = term_counts(docs, n, id_col, text_col) if counts is None else counts
    if vocabulary is not None:
        return tc.join(small_side(vocabulary.select("term").distinct(), "vocabulary"), "term", "left_semi")
    no_min = not isinstance(min_df, bool) and isinstance(min_df, int) and min_df <= 1
    no_max = (isinstance(max_df, float) and max_df >= 1.0) or max_df is None
    if no_min and no_max:  # limits that cannot remove a term: no df pass needed
        return tc
    n_docs = docs.count()
    if no_min and isinstance(max_df, float) and max_df >= FREQUENT:
        # documents have few terms above such a limit: the few go to the triples, not the triples to them
        frequent = materialise(tc.groupBy("term").agg(F.count_if(F.col("cnt") > 0).alias("df")).where(F.col("df") > _threshold(max_df, n_docs)).select("term"),
                               "frequent-terms")
        return tc.join(F.broadcast(frequent), "term", "left_anti").select("term", id_col, "cnt")
    # an inner join with the (distinct) kept terms: the triples stay with their documents if those are
    # few, else the terms' own exchange lets AQE split a hot term
    return tc.join(small_side(_kept_terms(tc, n_docs, min_df, max_df).select("term"), "kept-terms"), "term")


def dtm_subset(dtm: DataFrame, doc_ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of the matrix for the given documents (joined by id)."""
    return dtm.join(doc_ids.select(id_col).distinct(), id_col, "left_semi")


def doc_counts(dtm: DataFrame, terms: DataFrame | None = None, target_ids: DataFrame | None = None,
               id_col: str = "doc_id") -> DataFrame:
    """Documents containing each term: ``df`` over all rows and, with ``target_ids``,
    ``df_target`` over the target documents. Terms of ``terms`` absent from the matrix
    get zeros."""
    rows = dtm.where(F.col("cnt") > 0)
    if target_ids is not None:
        tgt = target_ids.select(id_col).distinct().withColumn("_t", F.lit(1))
        rows = rows.join(tgt, id_col, "left")
        out = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"),
                                       F.count("_t").alias("df_target"))
    else:
        out = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    if terms is not None:
        out = terms.select("term").distinct().join(out, "term", "left").na.fill(0)
    return out


def term_frequency_corpus(dtm: DataFrame) -> DataFrame:
    """``p_cor(term) = Σ cnt(term) / Σ cnt`` over the whole matrix."""
    counts = materialise(dtm.groupBy("term").agg(F.sum("cnt").alias("n")), "term-sums")  # for the total, and for the shares
    total = counts.agg(F.sum("n")).first()[0] or 0  # scalar
    return counts.select("term", (F.col("n") / F.lit(float(total) if total else None)).alias("p_cor"))


def term_frequency_document(dtm: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``cnt / Σ cnt of the document``; a document without terms has no rows.

    The triples move once, by document; a document has no more rows than its text has terms."""
    tot = F.sum("cnt").over(Window.partitionBy(id_col))
    return dtm.where(F.col(id_col).isNotNull()).select(id_col, "term", (F.col("cnt") / tot).alias("p_doc"))


def inverse_document_frequency(dtm: DataFrame, n_docs: int, id_col: str = "doc_id") -> DataFrame:
    """``ln(n / (df + 1)) + 1`` per term."""
    df = dtm.groupBy("term").agg(F.count_distinct(id_col).alias("df"))
    return df.select("term", (F.log(F.lit(float(n_docs)) / (F.col("df") + 1)) + 1).alias("idf"))


def tfidf(docs: DataFrame, n: int = 1, min_df=3, max_df=0.95, id_col: str = "doc_id",
          text_col: str = "text_clean") -> DataFrame:
    """TF-IDF weights: raw count × smooth idf ``ln((1+N)/(1+df)) + 1``, L2-normalised per
    document. Returns ``(id, term, weight)``.

    The counted triples stay with their documents if the kept terms are few; else they move
    twice: by term for the weights, and those kept by document for the norms."""
    tc = term_counts(docs, n, id_col, text_col)
    n_docs = docs.count()
    kept = _kept_terms(tc, n_docs, min_df, max_df)
    idf = kept.select("term", (F.log(F.lit(1.0 + n_docs) / (F.col("df") + 1)) + 1).alias("idf"))
    w = (tc.where(F.col(id_col).isNotNull()).join(small_side(idf, "idf"), "term")
         .select(id_col, "term", (F.col("cnt") * F.col("idf")).alias("w")))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(id_col)))
    return w.select(id_col, "term", (F.col("w") / norm).alias("weight"))
