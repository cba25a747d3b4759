"""Plan checks: operators that could be written with cross joins plan without them."""

from lexiflow.operators import actors as A
from lexiflow.operators import graph as G
from lexiflow.operators import ngrams as NG

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cross_joins(spark):
    cand = spark.createDataFrame([("ab cd", 3), ("x", 1)], "ngram string, freq long")
    off = spark.createDataFrame([(1, "zab cde x"), (2, "q")], "doc_id long, text_clean string")
    msgs = spark.createDataFrame([("A", 2000), ("B", 2002)], "g string, sent_year int")
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2)], "src string, dst string, weight long")
    attr = spark.createDataFrame([("a", "X"), ("b", "Y")], "node string, attr string")
    dim = spark.createDataFrame([(1, 0, "a.com", "cat")], "row_no int, domain_pos int, domain string, category string")
    m = spark.createDataFrame([("m1", "a.com")], "msg_id string, sender_domain string")
    frames = {
        "offtopic": NG.offtopic_filter(cand, off),
        "yearly": A.yearly_counts(msgs, "g", (2000, 2002)),
        "contract": G.contract(edges, attr),
        "induced": G.induced_subgraph(edges, G.nodes(edges.limit(1))),
        "enrich": A.enrich(m, A.first_match(dim, "category"), "category", "c"),
    }
    for name, df in frames.items():
        plan = _plan(df)
        assert not any(k in plan for k in FORBIDDEN), name
    got = {r["ngram"] for r in frames["offtopic"].collect()}
    assert got == set()  # "ab cd" occurs in "zab cde", "x" is a token of doc 1


def test_checkpoint_folder_must_be_set_on_a_cluster():
    import types

    import pytest

    from lexiflow.session import checkpoint_dir
    conf = types.SimpleNamespace(get=lambda key, default=None: default)
    cluster = types.SimpleNamespace(conf=conf, sparkContext=types.SimpleNamespace(master="yarn"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(cluster)


def test_hot_terms_can_be_split(spark, tmp_path):
    """AQE splits a hot term or document in the sparse matrix joins (sort-merge joins)."""
    from lexiflow.operators import dtm as D
    spark.range(40_000).selectExpr("id AS doc_id", "concat('hot hot w', id % 500, ' v', id % 7) AS text_clean") \
        .repartition(8).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        for frame in (D.tfidf(docs, min_df=2, max_df=1.0), D.doc_term_matrix(docs, min_df=2, max_df=1.0, n=1)):
            frame.collect()
            assert "skew=true" in frame._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
