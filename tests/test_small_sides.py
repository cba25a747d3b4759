"""Join sides written once and measured: the other side stays with its documents, with the same rows."""

import pytest
from pyspark.sql import functions as F

from lexiflow.operators import classifiers as CL
from lexiflow.operators import dtm as D
from lexiflow.operators import ngrams as NG
from lexiflow.operators import ranking as RK
from lexiflow.operators import substrings as X
from lexiflow.operators import vocabulary as V
from lexiflow.session import materialise, small_side

TEXTS = [(1, "red fox red fox den"), (2, "red fox runs"), (3, "blue fox runs"), (4, ""), (5, None), (2, "red den")]


@pytest.fixture()
def docs(spark):
    rows = materialise(spark.createDataFrame(TEXTS, "doc_id long, text_clean string"), "test-docs").repartition(4, "doc_id")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")  # as if no size were known when the join is planned
    yield rows
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def by_term(df):
    return "hashpartitioning(term" in plan(df) or "hashpartitioning(token" in plan(df)


def test_small_side_by_bytes(spark):
    side = spark.createDataFrame([("a" * 100,)], "term string")
    assert "Hint broadcast" in small_side(side, "t", 1000)._jdf.queryExecution().logical().toString()
    assert "Hint broadcast" not in small_side(side, "t", 100)._jdf.queryExecution().logical().toString()
    assert small_side(side.limit(0), "t").collect() == []


def test_matrix_of_a_vocabulary_moves_no_triples(spark, docs):
    counts = D.term_counts(docs)
    vocab = D.doc_term_matrix(docs, min_df=2, max_df=1.0, counts=counts).select("term").distinct()
    m = D.doc_term_matrix(docs, vocabulary=vocab, counts=counts)
    assert not by_term(m) and not by_term(D.doc_term_matrix(docs, min_df=2, max_df=1.0))
    assert sorted(map(tuple, m.select("doc_id", "term", "cnt").collect())) == [(1, "red fox", 2), (2, "fox runs", 1), (2, "red fox", 1), (3, "fox runs", 1)]


def test_overlap_moves_no_weights_by_term(spark, docs):
    weights = D.tfidf(docs, n=1, min_df=1, max_df=1.0)
    lengths = docs.select("doc_id", F.size(F.split("text_clean", " ")).alias("n_tokens"))
    terms = materialise(spark.createDataFrame([("red",), ("red",), ("cow",)], "term string"), "test-terms")
    out = RK.rank_tfidf_overlap(weights, lengths, terms)
    assert not by_term(out)
    assert {r[0] for r in out.collect()} == {1, 2}


def test_changed_tokens_are_looked_up_in_place(spark, docs):
    tokens = docs.select("doc_id", F.split("text_clean", " ").alias("tokens"))
    mapping = materialise(spark.createDataFrame([("red", "r"), ("fox", "fox"), ("den", None)], "surface string, normal string"), "test-map")
    out = V.map_vocabulary(tokens, mapping)
    assert not by_term(out)
    assert sorted(map(tuple, out.where("doc_id <> 2").collect())) == [
        (1, ["r", "fox", "r", "fox", "den"]), (3, ["blue", "fox", "runs"]), (4, [""]), (5, [])]


def test_scores_move_no_triples_by_term(spark, docs):
    dtm = D.term_counts(docs, n=1)
    train = spark.createDataFrame([(1, 0), (3, 1)], "doc_id long, label int")
    votes = CL.vote("logit", train, docs.select("doc_id").distinct(), dtm)
    assert not by_term(votes)
    assert dict(map(tuple, votes.collect()))[1] == 1 and dict(map(tuple, votes.collect()))[3] == 0


def test_positions_without_a_gram_of_the_phrases_are_left_out(spark):
    texts = spark.createDataFrame([(1, ["the", "red", "fox", "ran", "off"])], "doc_id long, pieces array<string>")
    phrases = spark.createDataFrame([("red fox",), ("a b",)], "query string")
    search = X.PhraseSearch(texts, phrases, "query")
    rows = search._positions([(1, 1), (3, 3)], search.crossings().cache())
    assert {r["gram"] for r in rows.collect()} >= {"red fox"} and rows.count() < 8
    assert [(r["phrase"], r["pos"]) for r in search.phrase_runs().collect()] == [("red fox", 1)]


@pytest.mark.parametrize("words", [1, 1 << 20])
def test_a_full_bitmap_loses_nothing(spark, monkeypatch, words):
    monkeypatch.setattr(X, "MAX_WORDS", words)
    texts = spark.createDataFrame([(1, "bred foxes ran a  b"), (2, "red  fox"), (None, "a red fox")], "doc_id long, text_clean string")
    phrases = [f"x{i} y{i}" for i in range(200)] + ["red fox", "a  b", "ed foxes ra", "fo", " fox"]
    found = X.PhraseSearch(texts.select("doc_id", F.split("text_clean", " ").alias("pieces")),
                           spark.createDataFrame([(p,) for p in phrases], "query string"), "query")
    got = {(r[0], r[1]) for r in found.phrase_runs().select("doc_id", "phrase").collect()}
    got |= {(r[0], r[1]) for r in found.in_pieces().select("doc_id", "phrase").collect()}
    assert got == {(r[0], p) for r in texts.collect() for p in phrases if p in r[1]}


@pytest.mark.parametrize("mode", ["absent_from_all", "absent_from_any"])
def test_candidates_are_computed_once(spark, mode):
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch
    candidates = spark.createDataFrame([("red fox",), ("big den",), ("fox",)], "ngram string").coalesce(1).mapInArrow(count, "ngram string")
    texts = spark.createDataFrame([(1, "bred foxes"), (2, "a red fox")], "doc_id long, text_clean string")
    kept = NG.offtopic_filter(candidates, texts, mode=mode)
    assert {r[0] for r in kept.collect()} == {"big den"}
    assert seen.value == 3
