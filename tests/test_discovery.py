"""Seeded exact-size sampling and the Naive Bayes vote on a tiny corpus."""

import hashlib

from pyspark.sql import functions as F

from lexiflow.operators import discovery as DS
from lexiflow.operators.dtm import doc_term_matrix


def test_exact_sample_matches_sorted_md5(spark):
    ids = spark.range(0, 5000).withColumnRenamed("id", "doc_id")
    for k in (0, 1, 37, 4999, 5000, 6000):
        got = sorted(r[0] for r in DS.exact_sample(ids, k, 12345).collect())
        keyed = sorted((hashlib.md5(f"12345:{i}".encode()).hexdigest(), i) for i in range(5000))
        want = sorted(i for _, i in keyed[:k])
        assert got == want


def test_naive_bayes_tiny(spark):
    docs = spark.createDataFrame([
        (1, "lawful interception lawful interception"), (2, "lawful interception handover"),
        (3, "weather report sunny day"), (4, "sunny day weather"), (5, "lawful interception report"),
        (6, "sunny day weather report")], "doc_id long, text_clean string")
    dtm = doc_term_matrix(docs, min_df=1, max_df=1.0)
    train = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "doc_id long, label int")
    test = spark.createDataFrame([(5,), (6,)], "doc_id long")
    votes = {r["doc_id"]: r["vote"] for r in DS.naive_bayes_vote(train, test, dtm).collect()}
    assert votes == {5: 1, 6: 0}
    stats = DS.keyword_statistics(docs, spark.createDataFrame([(1,), (2,), (5,)], "doc_id long"), min_df=2)
    rows = {r["term"]: r for r in stats.collect()}
    assert rows["lawful interception"]["n_t"] == 3 and rows["lawful interception"]["category"] == "T"
    assert rows["sunny day"]["category"] == "S\\T"


def test_empty_target_gives_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text_clean string")
    empty = spark.createDataFrame([], "doc_id long")
    assert DS.keyword_statistics(docs, empty, min_df=1).count() == 0


def _small_problem(spark, seed=3):
    import random
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choice("abcdefgh" if i < 60 else "efghijkl") for _ in range(rnd.randint(3, 12))) for i in range(120)]
    dtm = spark.createDataFrame([(i, t, c) for i, x in enumerate(texts) for t in sorted(set(x.split()))
                                 for c in [x.split().count(t)]], "doc_id long, term string, cnt long")
    train = spark.createDataFrame([(i, 0 if i < 60 else 1) for i in range(0, 120, 2)], "doc_id long, label int")
    test = spark.createDataFrame([(i,) for i in range(1, 120, 2)], "doc_id long")
    import numpy as np
    x = np.array([[t.split().count(c) for c in "abcdefghijkl"] for t in texts], dtype=float)
    y = np.array([0 if i < 60 else 1 for i in range(120)])
    return dtm, train, test, x[::2], y[::2], x[1::2]


def _votes(spark, name, problem):
    from lexiflow.operators import classifiers as CL
    dtm, train, test = problem[:3]
    got = {r["doc_id"]: r["vote"] for r in CL.vote(name, train, test, dtm).collect()}
    return [got[i] for i in range(1, 120, 2)]


def test_discriminant_equals_the_direct_formula(spark):
    import numpy as np
    problem = _small_problem(spark)
    _, _, _, x, y, z = problem
    mu = np.array([x[y == c].mean(axis=0) for c in (0, 1)])
    pooled = sum(np.outer(r - mu[c], r - mu[c]) for r, c in zip(x, y)) / (len(x) - 2)
    w = np.linalg.pinv(pooled) @ (mu[1] - mu[0])
    bias = -0.5 * (mu[1] + mu[0]) @ w
    assert _votes(spark, "LDA", problem) == [int(r @ w + bias <= 0) for r in z]


def test_logit_reaches_the_minimum(spark):
    import numpy as np
    from lexiflow.operators import classifiers as CL
    problem = _small_problem(spark)
    dtm, train, _, x, y, z = problem
    known = CL.Labelled(train, dtm)
    k = known.gram()
    assert np.allclose(k, x @ x.T)
    beta, bias = CL.solve_logit(k, known.label)
    w = x.T @ beta
    p = 1 / (1 + np.exp(-(x @ w + bias)))
    assert np.abs(w + x.T @ (p - y)).max() < 1e-6 and abs((p - y).sum()) < 1e-6  # zero gradient
    assert _votes(spark, "logit", problem) == [int(r @ w + bias <= 0) for r in z]


def test_support_vectors_meet_the_optimality_conditions(spark):
    import numpy as np
    from lexiflow.operators import classifiers as CL
    problem = _small_problem(spark)
    _, _, _, x, y, z = problem
    beta, bias = CL.solve_svm(x @ x.T, y, c=0.5)
    sign = np.where(y == 1, 1, -1)
    margin, alpha = sign * (x @ (x.T @ beta) + bias), beta * sign
    assert (margin[alpha < 1e-9] > 1 - 1e-4).all() and (margin[alpha > 0.5 - 1e-9] < 1 + 1e-4).all()
    assert np.abs(margin[(alpha > 1e-6) & (alpha < 0.5 - 1e-6)] - 1).max() < 1e-4
    votes = _votes(spark, "SVM", problem)
    assert sum(v == int(i < 30) for i, v in enumerate(votes)) >= 45


def test_nearest_equals_brute_force(spark):
    import numpy as np
    problem = _small_problem(spark)
    _, _, _, x, y, z = problem
    want = [int(2 * y[np.argsort(((x - r) ** 2).sum(axis=1), kind="stable")[:5]].sum() <= 5) for r in z]
    assert _votes(spark, "nearest", problem) == want


def test_gram_matrix_in_blocks_whatever_the_partitions(spark, monkeypatch):
    import numpy as np
    from lexiflow.operators import classifiers as CL
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, (300, 90)) * (rng.random((300, 90)) < 0.2)
    dtm = spark.createDataFrame([(i, f"t{j}", int(c)) for i, r in enumerate(x) for j, c in enumerate(r) if c], "doc_id long, term string, cnt long")
    train = spark.range(300).selectExpr("id as doc_id", "cast(id % 2 as int) as label")
    want = x @ x.T
    for rows, fan in ((10 ** 6, 16), (100, 4)):  # one task; many, added in a tree
        monkeypatch.setattr(CL, "GRAM_ROWS", rows)
        monkeypatch.setattr(CL, "GRAM_FAN", fan)
        assert (CL.Labelled(train, dtm.repartition(7)).gram() == want).all()
    assert (CL.Labelled(train, dtm.limit(0)).gram() == 0).all()


def test_sampled_training_rows(spark):
    from lexiflow.operators import classifiers as CL
    dtm, train, test = _small_problem(spark)[:3]
    assert CL.Labelled(train, dtm, max_train=20).n == 20
    assert CL.vote("logit", train, test, dtm, max_train=20).count() == 60


def test_keyword_table_edge_cases(spark):
    import pytest
    from lexiflow.operators import classifiers as CL
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c d"), (4, "a b")], "doc_id long, text_clean string")
    # S\T empty: p_st is NULL (no division error), category T
    allt = DS.keyword_statistics(docs, docs.select("doc_id"), min_df=1)
    row = {r["term"]: r for r in allt.collect()}["a b"]
    assert row["p_st"] is None and row["category"] == "T" and row["n_t"] == 3
    # equal shares in T and S\T -> category T
    half = DS.keyword_statistics(docs, spark.createDataFrame([(1,), (3,)], "doc_id long"), min_df=1)
    rows = {r["term"]: r for r in half.collect()}
    assert rows["a b"]["p_t"] == 50.0 and rows["a b"]["p_st"] == 100.0 and rows["a b"]["category"] == "S\\T"
    assert rows["c d"]["p_t"] == 50.0 and rows["c d"]["p_st"] == 0.0 and rows["c d"]["category"] == "T"
    eq = DS.keyword_statistics(docs.where("doc_id in (1, 2)"), spark.createDataFrame([(1,)], "doc_id long"), min_df=1)
    assert [r["category"] for r in eq.collect()] == ["T"]  # p_t = p_st = 100
    # learner names are exact (no substring matching)
    with pytest.raises(ValueError):
        CL.vote("nb", docs.select("doc_id", F.lit(0).alias("label")), docs.select("doc_id"),
                docs.select("doc_id", F.lit("a b").alias("term"), F.lit(1).alias("cnt")))


def test_logit_learns_from_every_labelled_document(spark, monkeypatch):
    import numpy as np
    from lexiflow.operators import classifiers as CL
    problem = _small_problem(spark, seed=8)
    dtm, train, _, x, y, z = problem
    monkeypatch.setattr(CL, "MAX_TRAIN", 20)  # fewer than the 60 labelled documents
    beta, bias = CL.solve_logit(x @ x.T, y)
    assert _votes(spark, "logit", problem) == [int(r @ x.T @ beta + bias <= 0) for r in z]


def test_packed_triples_multiply_like_the_gram_matrix(spark, monkeypatch):
    import numpy as np
    from lexiflow.operators import classifiers as CL
    from lexiflow.operators import packed as PK
    rng = np.random.default_rng(3)
    x = rng.integers(0, 4, (90, 200)) * (rng.random((90, 200)) < np.r_[np.full(40, 0.5), np.full(160, 0.012)])
    x[7] = x[8] = x[9]  # equal documents: the matrix is singular
    x[11] = 0
    y = rng.integers(0, 2, 90)
    y[7] = y[8]
    dtm = spark.createDataFrame([(i, f"t{j:03d}", int(c)) for i, r in enumerate(x) for j, c in enumerate(r) if c], "doc_id long, term string, cnt long")
    train = spark.createDataFrame([(i, int(c)) for i, c in enumerate(y)], "doc_id long, label int")
    monkeypatch.setattr(PK, "CHUNK", 50)
    monkeypatch.setattr(PK, "BLOCK", 32)  # three blocks, added up by tasks
    known = PK.Packed(train.repartition(3), dtm.repartition(5), "doc_id")
    multiply, diagonal = known.gram()
    k = (x @ x.T).astype(float)
    v = rng.normal(size=90)
    assert (known.label == y).all() and np.allclose(multiply(v), k @ v) and np.allclose(diagonal, np.diag(k))
    w = {r["term"]: r["w"] for r in known.weights(v).collect()}
    assert all(abs(w.get(f"t{j:03d}", 0.0) - x[:, j] @ v) < 1e-9 for j in range(200))
    (a, b), (c, d) = CL.solve_logit(k, y), CL.iterate_logit(lambda u: k @ u, np.diag(k), known.label)
    assert np.abs(k @ (a - c)).max() < 1e-5 and abs(b - d) < 1e-5
