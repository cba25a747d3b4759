"""The n-gram join plan equals the replace-length expression plan in both modes."""

import random

from pyspark.sql import functions as F

from lexiflow.functions.text import padded_count, token_count
from lexiflow.operators import keyterms as K


def hits_by_expression(texts, queries, mode):
    """Each text counts a literal array of all queries by replacing (no join)."""
    counter = token_count if mode == "token" else padded_count
    arr = F.array(*[F.struct(F.lit(r[0]).alias("query"), counter(F.col("body"), F.lit(r[0])).alias("cnt"))
                    for r in queries.select("query").collect()])
    return (texts.select("doc_id", F.lit("body").alias("field"), F.explode(arr).alias("h"))
            .select("doc_id", "field", "h.*").where("cnt > 0"))


def test_join_plan_equals_expression_plan(spark):
    rnd = random.Random(7)
    vocab = ["li", "x", "y", "ab", "li.", "it's", "a\\b"]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 30)))) for i in range(60)]
    texts = spark.createDataFrame(docs, "doc_id long, body string")
    raw = spark.createDataFrame([("li",), ("li li",), ("x li",), ("li x li",), ("ab",), ("zz",),
                                 ("it's li",), ("a\\b",)], "query string")
    queries = K.prepare_queries(raw, stopwords=())
    for mode in ("token", "padded"):
        a = {tuple(r) for r in K.keyterm_hits(texts, queries, mode=mode).collect()}
        b = {tuple(r) for r in hits_by_expression(texts, queries, mode).collect()}
        assert a == b, mode
        # the same plan with shuffle joins
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
        try:
            c = {tuple(r) for r in K.keyterm_hits(texts, queries, mode=mode).collect()}
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert c == b, mode


def test_long_and_many_queries(spark):
    words = [f"t{i}" for i in range(70)]
    texts = spark.createDataFrame([(1, " ".join(words)), (2, "q59999 x")], "doc_id long, body string")
    raw = (spark.range(60_000).selectExpr("concat('q', id) as query")
           .unionByName(spark.createDataFrame([(" ".join(words[:65]),)], "query string")))
    queries = K.prepare_queries(raw, stopwords=())
    got = {(r["doc_id"], len(r["query"].split()), r["cnt"]) for r in K.keyterm_hits(texts, queries).collect()}
    assert got == {(1, 65, 1), (2, 1, 1)}


def test_trie_of_many_lengths(spark):
    """Queries of 1 to 40 tokens that share long beginnings, ids that repeat, against the expression plan."""
    rnd = random.Random(13)
    def words(n):
        return [rnd.choice(["a1", "b1", "c1"]) for _ in range(n)]
    stems = [words(40) for _ in range(3)]
    raw = {" ".join(s[:n]) for s in stems for n in range(1, 41)} | {" ".join(words(rnd.randint(1, 9))) for _ in range(60)}
    docs = [(i % 50, " ".join(words(rnd.randint(0, 9)) + rnd.choice(stems)[:rnd.randint(0, 40)] + words(rnd.randint(0, 9))))
            for i in range(40)]
    texts = spark.createDataFrame(docs, "doc_id long, body string").repartition(4)
    queries = K.prepare_queries(spark.createDataFrame([(q,) for q in sorted(raw)], "query string"), stopwords=())
    for mode in ("token", "padded"):
        got = {tuple(r) for r in K.keyterm_hits(texts, queries, mode=mode).collect()}
        assert got == {tuple(r) for r in hits_by_expression(texts, queries, mode).collect()}, mode


def test_a_long_query_does_not_widen_the_positions(spark):
    long_query = " ".join(f"w{i}" for i in range(2000))
    texts = spark.createDataFrame([(1, "x y " + long_query), (2, "w0 w1 x"), (None, long_query)], "doc_id long, body string")
    queries = K.prepare_queries(spark.createDataFrame([(long_query,), ("x",)], "query string"), stopwords=())
    got = {(r.doc_id, r.query[:2], r.cnt) for r in K.keyterm_hits(texts, queries).collect()}
    assert got == {(1, "w0", 1), (1, "x", 1), (2, "x", 1), (None, "w0", 1)}
    long = texts.select("doc_id", F.lit("body").alias("field"), F.split("body", " ").alias("toks"), F.lit(0).alias("text"))
    assert "array" not in dict(K.token_positions(long).dtypes).values()
    trie = K.query_trie(queries)
    assert trie.agg(F.max("step")).first()[0] == 2000 - 1024 and trie.count() == 13  # 12 steps of the long one, one of x


def test_profile_and_options(spark):
    raw = spark.createDataFrame([("ETSI-TS 33.107",), ("Li",), ("",)], "query string")
    q = K.prepare_queries(raw, stopwords=())
    prof = K.query_profile(q).first()
    assert prof["has_digits"] is True
    assert prof["min_term_len"] == 2 and prof["max_term_len"] == 7
    assert prof["non_alphanumerics"] == ["-", "."]
    opts = K.search_options(prof)
    assert opts["remove_numbers"] is False
    assert K.search_options(prof, legacy_digits=True)["remove_numbers"] is True


def test_no_cartesian_in_hits_plan(spark):
    texts = spark.createDataFrame([(1, "a b c")], "doc_id long, body string")
    queries = K.prepare_queries(spark.createDataFrame([("a b",)], "query string"), stopwords=())
    plan = K.keyterm_hits(texts, queries)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_raw_keyword_counts(spark):
    texts = spark.createDataFrame([(1, "privacy and Privacy privacy", "d1")], "doc_id long, text string, date string")
    kw = spark.createDataFrame([("privacy",), ("and",), ("zz",)], "query string")
    got = {(r["keyword"], r["cnt"], r["date"]) for r in K.raw_keyword_counts(texts, kw, keep=["date"]).collect()}
    assert got == {("privacy", 2, "d1"), ("and", 1, "d1")}


def test_raw_keyword_counts_equal_str_count(spark):
    rnd = random.Random(11)
    texts = ["".join(rnd.choice("ab  a\n") for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    keys = sorted({"".join(rnd.choice("ab ") for _ in range(rnd.randint(1, 6))) for _ in range(150)} | {"a a", "aa", " ", "a\nb"})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kw = spark.createDataFrame([(k,) for k in keys], "query string")
    got = {(r["doc_id"], r["keyword"]): r["cnt"] for r in K.raw_keyword_counts(docs, kw).collect()}
    assert got == {(i, k): t.count(k) for i, t in enumerate(texts) for k in keys if t.count(k)}


def test_phrases_meet_at_rare_grams_only(spark):
    """Frequent pieces around a rare blank: only positions with the phrase's rarest gram are compared."""
    from lexiflow.operators.substrings import PhraseSearch
    filler = " ".join(["the"] * 3000)
    texts = spark.createDataFrame([(1, f"{filler} cat sat on the mat {filler}"), (2, "scat sat on the matter"), (3, filler),
                                   (2, "cat sat on the mat"), (None, "xcat sat on the mat")], "doc_id long, text string")
    texts = texts.select("doc_id", F.split("text", " ").alias("pieces"))
    phrases = spark.createDataFrame([("cat sat on the mat",), ("the mat",), (" ".join(["the"] * 1500) + " cat",)], "query string")
    found = PhraseSearch(texts, phrases, "query")
    got = {(r.doc_id, r.phrase[:7], r.k) for r in found.phrase_runs().collect()}
    assert got == {(1, "cat sat", 5), (2, "cat sat", 5), (None, "cat sat", 5), (1, "the mat", 2), (2, "the mat", 2),
                   (None, "the mat", 2), (1, "the the", 1501)}
    assert found.single.count() == 0 and found.in_pieces().count() == 0
    rows = found._positions([(3, 3)])
    keys = found.crossings().where("k > 2").join(rows.groupBy("gram").count(), "gram").groupBy("phrase").agg(F.min("count").alias("n"))
    assert max(r.n for r in keys.collect()) <= 4  # of 9000 positions
    assert "array<string>" not in dict(rows.dtypes).values()


def test_observe_counts(spark):
    texts = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, body string")
    observed, obs = K.observe_counts(texts, "texts_loaded")
    observed.write.format("noop").mode("overwrite").save()
    assert obs.get["rows"] == 2


def test_hits_wide_view(spark):
    hits = spark.createDataFrame([(1, "body", "li", 2), (1, "attachment", "x", 1), (2, "body", "x", 3)],
                                 "doc_id long, field string, query string, cnt long")
    wide = {r["doc_id"]: r.asDict() for r in K.hits_wide(hits, ["li", "x"]).collect()}
    assert wide[1]["body-li"] == 2 and wide[1]["attachment-x"] == 1 and wide[1]["body-x"] == 0
    assert wide[2]["body-x"] == 3 and wide[2]["body-li"] == 0
