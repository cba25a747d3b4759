"""Supervised keyword discovery (King, Lam & Roberts 2017 style).

reference set R vs search set S -> training set (all R + seeded sample of S, labels
0/1) -> classifier votes on all of S -> target set T -> bigram log-likelihood table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexiflow.functions.mathx import ln_beta
from lexiflow.operators.dtm import doc_term_matrix

HASH_PREFIX = 4  # hex digits of the md5 key used as histogram bucket (65 536 buckets)


def sample_key(id_col: str, seed: int):
    """Seeded, engine-independent sort key: md5 of ``'<seed>:<id>'``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def exact_sample(df: DataFrame, k: int, seed: int, id_col: str = "doc_id") -> DataFrame:
    """The ``k`` rows with the smallest ``(md5(seed:id), id)`` - an exact-size, seeded
    sample without a global sort.

    A histogram over the first hex digits of the key (at most 65 536 counts reach the
    driver) locates the bucket holding the k-th key; rows of lower buckets are taken
    whole and only the boundary bucket (about n/65 536 rows) is sorted for the rest.
    """
    keyed = df.withColumn("_h", sample_key(id_col, seed)) \
        .withColumn("_b", F.substring("_h", 1, HASH_PREFIX))
    if k <= 0:
        return df.limit(0)
    hist = sorted((r["_b"], r["n"]) for r in
                  keyed.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect())
    cum, boundary, rest = 0, None, 0
    for b, n in hist:
        if cum + n >= k:
            boundary, rest = b, k - cum
            break
        cum += n
    if boundary is None:  # k >= number of rows
        return df
    below = keyed.where(F.col("_b") < boundary)
    edge = keyed.where(F.col("_b") == boundary).orderBy("_h", id_col).limit(rest)
    return below.unionByName(edge).drop("_h", "_b")


def training_split(reference: DataFrame, search: DataFrame, ref_frac: float = 1.0,
                   search_frac: float = 0.33, seed: int = 12345, id_col: str = "doc_id"):
    """Training rows ``(id, label)``: ``round(|R|·ref_frac)`` of R (label 0) and
    ``floor(|S|·search_frac)`` of S (label 1); the test set is all of S.
    Returns ``(train, test_ids)``."""
    r_ids = reference.select(id_col).distinct()
    s_ids = search.select(id_col).distinct()
    k_r = int(round(r_ids.count() * ref_frac))
    k_s = int(s_ids.count() * search_frac)
    train = (exact_sample(r_ids, k_r, seed, id_col).withColumn("label", F.lit(0))
             .unionByName(exact_sample(s_ids, k_s, seed, id_col).withColumn("label", F.lit(1))))
    return train, s_ids


def naive_bayes_vote(train: DataFrame, test_ids: DataFrame, dtm: DataFrame,
                     vocab_size: int | None = None, alpha: float = 1.0,
                     id_col: str = "doc_id") -> DataFrame:
    """Multinomial Naive Bayes as aggregations over ``(id, term, cnt)``.

    ``log P(c) = ln(n_c / n)`` (unsmoothed prior), ``log P(t|c) = ln((N_ct + α) /
    (N_c + α·V))`` with V the fitted vocabulary size; a test document's score is
    ``log P(c) + Σ cnt·ln(N_ct + α) - len·ln(N_c + α·V)``. Ties predict class 0.
    Returns ``(id, vote)`` with ``vote = 1 - prediction`` (1 = looks like R).
    """
    from lexiflow.session import materialise
    # One pass: the triples move by term, where sums over a term (at most one row per document)
    # give its class counts, and their scores are added up by document. The rows of a document
    # also carry its share of the totals: V counts the first row of each term.
    t = train.groupBy(id_col).agg(F.count_if(F.col("label") == 0).alias("t0"), F.count_if(F.col("label") == 1).alias("t1"))
    rows = dtm.select(id_col, "term", "cnt").join(t, id_col, "left").na.fill(0, ["t0", "t1"]) \
        .withColumns({"c0": F.col("cnt") * F.col("t0"), "c1": F.col("cnt") * F.col("t1")})
    of_term = Window.partitionBy("term")
    rows = rows.select(id_col, "cnt", "c0", "c1", F.sum("c0").over(of_term).alias("n0"), F.sum("c1").over(of_term).alias("n1"),
                       F.row_number().over(of_term.orderBy("term")).alias("_row"))
    sums = materialise(rows.groupBy(id_col).agg(
        F.sum(F.col("cnt") * F.log(F.col("n0") + alpha)).alias("a0"), F.sum(F.col("cnt") * F.log(F.col("n1") + alpha)).alias("a1"),
        F.sum("cnt").alias("len"), F.sum("c0").alias("c0"), F.sum("c1").alias("c1"),
        F.count_if(F.col("_row") == 1).alias("first")), "term-classes")
    tot = sums.agg(F.sum("first"), F.sum("c0"), F.sum("c1")).first()
    if vocab_size is None:
        vocab_size = int(tot[0] or 0)
    big_n0, big_n1 = float(tot[1] or 0), float(tot[2] or 0)
    pri = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = float(sum(pri.values()))
    lp0 = F.log(F.lit(pri.get(0, 0) / n)) if pri.get(0) else F.lit(float("-inf"))
    lp1 = F.log(F.lit(pri.get(1, 0) / n)) if pri.get(1) else F.lit(float("-inf"))
    s = sums.select(id_col, "a0", "a1", "len")
    s = test_ids.select(id_col).distinct().join(s, id_col, "left").na.fill(0, ["a0", "a1", "len"])
    sc0 = lp0 + F.col("a0") - F.col("len") * F.log(F.lit(big_n0 + alpha * vocab_size))
    sc1 = lp1 + F.col("a1") - F.col("len") * F.log(F.lit(big_n1 + alpha * vocab_size))
    pred = F.when(sc1 > sc0, 1).otherwise(0)
    return s.select(id_col, (1 - pred).alias("vote"))


def vote_counts(votes: Sequence[DataFrame], id_col: str = "doc_id") -> DataFrame:
    """Sum of the classifiers' votes per document (inputs ``(id, vote)``)."""
    u = votes[0]
    for v in votes[1:]:
        u = u.unionByName(v)
    return u.groupBy(id_col).agg(F.sum("vote").alias("votes"))


def target_set(counts: DataFrame, vote_min: int = 1, id_col: str = "doc_id") -> DataFrame:
    """``(id, in_target)``: at least ``vote_min`` votes -> target set T."""
    return counts.select(id_col, (F.col("votes") >= vote_min).alias("in_target"))


def keyword_statistics(search_docs: DataFrame, target_ids: DataFrame, min_df: int = 10,
                       id_col: str = "doc_id", text_col: str = "text_clean",
                       search_terms: DataFrame | None = None) -> DataFrame:
    """Bigram keyword table for the target split of the search set.

    Terms: bigrams with ``df >= min_df`` in S. ``n_t`` = documents of T containing the
    term, ``n_st`` = those of S\\T; with ``|T|`` floored at 1,
    ``ll = ln B(n_t+1, n_st+1) + ln B(|T|-n_t+1, |S\\T|-n_st+1)``,
    ``p_t = 100·n_t/|T|``, ``p_st = 100·n_st/|S\\T|`` (NULL when S\\T is empty),
    ``category = 'S\\T'`` iff ``p_st > p_t`` else ``'T'``. An empty T gives no rows.
    ``search_terms`` (all ``(id, term, cnt)`` bigram triples of S) avoids re-tokenising.
    """
    spark = search_docs.sparkSession
    tgt = target_ids.select(id_col).distinct()
    n_target = tgt.count()
    n_search = search_docs.select(id_col).distinct().count()
    schema = ("term string, n_t bigint, n_st bigint, p_t double, p_st double, ll double, "
              "category string")
    if n_target == 0:
        return spark.createDataFrame([], schema)
    n_t_docs = max(n_target, 1)
    n_st_docs = n_search - n_target
    if search_terms is None:
        dtm = doc_term_matrix(search_docs, min_df=min_df, max_df=1.0, id_col=id_col, text_col=text_col)
    else:
        dtm = search_terms
    flagged = dtm.join(tgt.withColumn("_t", F.lit(1)), id_col, "left")
    # one aggregation counts and limits: no join of a term with its own rows
    dc = flagged.groupBy("term").agg(F.count(F.lit(1)).alias("df_s"), F.count("_t").alias("n_t")) \
        .where(F.col("df_s") >= min_df)
    n1, n0 = F.col("n_t"), F.col("df_s") - F.col("n_t")
    ll = ln_beta(n1 + 1, n0 + 1) + ln_beta(F.lit(n_t_docs) - n1 + 1, F.lit(n_st_docs) - n0 + 1)
    p_t = n1 * 100.0 / F.lit(float(n_t_docs))
    p_st = F.try_divide(n0 * 100.0, F.lit(float(n_st_docs)))
    out = dc.select("term", n1.cast("bigint").alias("n_t"), n0.cast("bigint").alias("n_st"),
                    p_t.alias("p_t"), p_st.alias("p_st"), ll.alias("ll"))
    return out.withColumn("category", F.when(F.col("p_st") > F.col("p_t"), F.lit("S\\T"))
                          .otherwise(F.lit("T")))


def top_keywords(stats: DataFrame, k: int = 1000, categories: Sequence[str] = ("T", "S\\T")) -> DataFrame:
    """Best ``k`` keywords by log-likelihood within each category (distributed top-k per
    category, ties by term)."""
    parts = [stats.where(F.col("category") == c).orderBy(F.desc("ll"), F.asc("term")).limit(k)
             for c in categories]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def klr_keywords(reference: DataFrame, search: DataFrame, classifiers: Sequence[str] | str = ("nbayes",),
                 ref_frac: float = 1.0, search_frac: float = 0.33, seed: int = 12345,
                 vote_min: int = 1, min_df: int = 10, id_col: str = "doc_id",
                 text_col: str = "text_clean"):
    """End to end: training split -> votes -> target set -> keyword table.

    ``reference``/``search`` hold cleaned texts. The classifier vocabulary is fitted on
    R ∪ S (S wins on equal ids). Returns ``(stats, target)``.
    """
    from lexiflow.operators import classifiers as CL
    from lexiflow.session import cut_lineage, materialise_by
    names = [classifiers] if isinstance(classifiers, str) else list(classifiers)
    reference, search = reference.select(id_col, text_col), search.select(id_col, text_col)
    corpus = (reference.join(search.select(id_col), id_col, "left_anti").unionByName(search))
    # the only table that several jobs read; ids come from the sources without their texts
    dtm = materialise_by(doc_term_matrix(corpus, min_df=1, max_df=1.0, id_col=id_col, text_col=text_col), "terms", id_col)
    train, test_ids = training_split(reference, search, ref_frac, search_frac, seed, id_col)
    votes = [CL.vote(name, train, test_ids, dtm, id_col=id_col, seed=seed) for name in names]
    tgt = cut_lineage(target_set(vote_counts(votes, id_col), vote_min, id_col))  # scored once
    t_ids = tgt.where("in_target").select(id_col)
    s_terms = dtm.join(search.select(id_col), id_col, "left_semi")
    stats = keyword_statistics(search, t_ids, min_df=min_df, id_col=id_col, text_col=text_col,
                               search_terms=s_terms)
    return stats, tgt
