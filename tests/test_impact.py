"""Ranked retrieval with pruning against scores of all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import ranking as R
from lexiflow.operators.impact import ImpactIndex


def corpus(seed, n_docs=400, n_terms=60):
    """Vectors with one term in nearly every document, ties and repeated vectors."""
    rng = random.Random(seed)
    docs, vector = [], []
    for d in range(n_docs):
        if d % 9 or not vector:
            size = rng.choice((1, 2, 4, 12, 30))
            vector = [(t, float(rng.choice((1, 1, 1, 2, 3, 9)))) for t in rng.sample(range(1, n_terms), size)]
            vector += [(0, float(rng.choice((1, 2))))] * (rng.random() < 0.9)
        docs += [(d, f"t{t}", w) for t, w in vector]
    queries = [(f"q{q}", f"t{t}", rng.choice((0.5, 1.0, 2.0))) for q in range(40)
               for t in {rng.choice((0, 0, *range(n_terms))) for _ in range(rng.choice((1, 2, 2, 5)))}]
    return docs, queries + [("absent", "none", 1.0), ("zero", "t1", 0.0), ("mixed", "t1", 1.0), ("mixed", "none", 3.0)]


def brute(docs, queries, k):
    vectors, wanted = {}, {}
    for d, t, w in docs:
        vectors.setdefault(d, {})[t] = w
    for q, t, w in queries:
        wanted.setdefault(q, {})[t] = w
    out, shared = {}, 0
    for q, terms in wanted.items():
        qn = math.sqrt(sum(w * w for w in terms.values()))
        scores = []
        for d, v in vectors.items():
            both = [t for t in terms if t in v and terms[t] > 0]
            if both:
                shared += 1
                scores.append((-round(sum(terms[t] * v[t] for t in both) / qn / math.sqrt(sum(w * w for w in v.values())), 9), d))
        out[q] = sorted(scores)[:k]
    return {q: s for q, s in out.items() if s}, shared


@pytest.mark.parametrize("seed,k", [(1, 5), (2, 1), (3, 60), (4, 1000)])
def test_same_as_all_pairs(spark, seed, k):
    docs, queries = corpus(seed)
    got = {}
    for r in R.rank_cosine(spark.createDataFrame(docs, "doc_id long, term string, weight double").repartition(4),
                           spark.createDataFrame(queries, "query string, term string, weight double"), word_limit=k).collect():
        got.setdefault(r.query, []).append((-round(r.score, 9), r.doc_id))
    want, _ = brute(docs, queries, k)
    assert {q: [d for _, d in sorted(s)] for q, s in got.items()} == {q: [d for _, d in s] for q, s in want.items()}


def test_few_pairs_are_scored_and_a_frequent_term_is_many_blocks(spark):
    docs, queries = corpus(5, n_docs=3000)
    index = ImpactIndex(spark.createDataFrame(docs, "doc_id long, term string, weight double"), block=32)
    blocks = index.blocks.groupBy("term").agg(F.count("*").alias("blocks"), F.max("n").alias("largest"),
                                              F.sum("n").alias("n")).collect()
    hot = max(blocks, key=lambda r: r.n)
    assert hot.term == "t0" and hot.blocks > 60 and hot.largest < 100
    terms = index.query_terms(spark.createDataFrame(queries, "query string, term string, weight double"), 10)
    scored = index.candidates(terms).count()
    _, shared = brute(docs, queries, 10)
    assert scored < shared / 4
    assert "postings" not in index.query_terms(spark.createDataFrame(queries, "query string, term string, weight double"), 10).columns


def test_empty_tables(spark):
    docs, queries = corpus(6, n_docs=20)
    d = spark.createDataFrame(docs, "doc_id long, term string, weight double")
    q = spark.createDataFrame(queries, "query string, term string, weight double")
    assert R.rank_cosine(d.limit(0), q).collect() == [] and R.rank_cosine(d, q.limit(0)).collect() == []
