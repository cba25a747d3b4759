"""Counted triples stay where their documents are: few shuffles, the same rows."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import dtm as D
from lexiflow.operators import ranking as R
from lexiflow.plans import standins as S
from lexiflow.session import joined_in_place, materialise_by

ROWS = [(1, "a b a b c"), (1, "a b"), (2, "a b d e"), (3, "d e d e"), (4, ""), (5, None), (6, "a b x y")]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def corpus(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return S.corpus(spark, str(tmp_path)).withColumnRenamed("text", "text_clean")


def counted():
    out = Counter()
    for d, text in ROWS:
        words = (text or "").split()
        out.update((d, " ".join(words[i:i + 2])) for i in range(len(words) - 1))
    return out


def test_corpus_is_counted_without_a_shuffle_of_terms(spark, tmp_path):
    tc = D.term_counts(corpus(spark, tmp_path))
    assert exchanges(tc) == 1
    assert {(r["doc_id"], r["term"]): r["cnt"] for r in tc.collect()} == counted()


def moved_to_count(df):
    """Whether any plan step deals counted triples out by document and term."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.search(r"hashpartitioning\(doc_id#\w+, term#", plan) is not None


@pytest.mark.parametrize("lo,hi", [(2, 0.9), (1, 0.3), (2, 3), (1, 1.0)])
def test_limits_do_not_move_triples_to_count_them(spark, tmp_path, lo, hi):
    want = counted()
    df = Counter(t for _, t in want)
    top = hi if isinstance(hi, int) else hi * len(ROWS)
    m = D.doc_term_matrix(corpus(spark, tmp_path), min_df=lo, max_df=hi)
    assert not moved_to_count(m)
    assert {(r["doc_id"], r["term"]): r["cnt"] for r in m.collect()} == {k: c for k, c in want.items() if lo <= df[k[1]] <= top}


def test_shares_and_norms_do_not_move_triples_to_count_them(spark, tmp_path):
    docs = corpus(spark, tmp_path)
    assert not moved_to_count(D.term_frequency_document(D.doc_term_matrix(docs, min_df=2, max_df=0.9)))
    assert not moved_to_count(D.tfidf(docs, min_df=1))


def test_kl_scores_read_the_matrix_once(spark, tmp_path):
    m = D.doc_term_matrix(corpus(spark, tmp_path), min_df=1, max_df=1.0)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def one(n):
        seen.add(1)
        return n
    m = m.withColumn("cnt", one.asNondeterministic()("cnt"))
    rows = R.kl_terms(m, spark.createDataFrame([(1,), (1,), (3,)], "doc_id long"), word_limit=9, alpha=0.5).collect()
    assert len(rows) == len({t for _, t in counted()}) and seen.value == len(counted())


def test_bucketed_rows_join_in_place(spark):
    rows = materialise_by(spark.range(50).select((F.col("id") % 7).alias("d"), F.col("id").alias("x")), "left", "d")
    more = materialise_by(spark.range(50).select((F.col("id") % 5).alias("e"), F.col("id").alias("y")), "right", "e")
    join = rows.hint("merge").join(more, (F.col("d") == F.col("e")) & (F.col("x") == F.col("y")))
    with joined_in_place(spark):
        assert exchanges(join) == 0
        assert {r["x"] for r in join.collect()} == {i for i in range(50) if i % 7 == i % 5}
